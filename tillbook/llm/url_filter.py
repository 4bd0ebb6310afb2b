"""URL filters: block and allow rules, and gradient-boosted trees on lexical
features for the URLs that no rule fits.

Rules name a host (and so all its subdomains) and a path prefix; the longest
rule that fits decides. The URLs that rules decide are the labelled URLs: a
bounded sample of them (``sample`` rows, the smallest hashes) trains Spark ML's
gradient-boosted trees on length, depth, digit ratio, entropy, parameter
counts and suffix statistics. The suffix statistics are counted over all
labelled URLs. Everything else is column expressions over all rows.

Defined results: a null URL, or one without "://", has empty host and path, no
rule, and the model's verdict on its (zero) features. Where the rules label no
URL, or one class only, the verdict is that class ("allow" without any).
Repeated rows get a row each; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["length", "host_length", "path_length", "depth", "subdomains", "digit_ratio", "letter_ratio", "hyphens",
            "entropy", "host_entropy", "parameters", "has_fragment", "is_https", "tld_block", "domain_block"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. Ties go
    to the longer host, then to the larger rule text."""
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        by_host.setdefault(name.lower(), []).append((slash + rest, rule, verdict))
    kind = "array<struct<size:int,host_size:int,rule:string,verdict:string,path:string>>"
    entries: list[Column] = []
    for name, own in by_host.items():
        entries += [F.lit(name), F.array(*[F.struct(
            F.lit(len(rule)).alias("size"), F.lit(len(name)).alias("host_size"), F.lit(rule).alias("rule"),
            F.lit(verdict).alias("verdict"), F.lit(prefix).alias("path")) for prefix, rule, verdict in own]).cast(kind)]
    if not entries:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    table = F.create_map(*entries)
    parts = F.split(host, "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)),
                           lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fits = F.flatten(F.transform(suffixes, lambda s: F.filter(
        F.coalesce(F.try_element_at(table, s), F.array().cast(kind)), lambda r: F.startswith(path, r["path"]))))
    best = F.array_max(fits)
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def entropy(text: Column) -> Column:
    """Bits per character of the text's own distribution of characters."""
    chars = F.split(text, "")
    n = F.length(text)
    def bits(c: Column) -> Column:
        p = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return -p * F.log2(p)
    return F.when(n > 0, F.aggregate(F.filter(F.array_distinct(chars), lambda c: c != ""), F.lit(0.0),
                                     lambda acc, c: acc + F.coalesce(bits(c), F.lit(0.0)))).otherwise(F.lit(0.0))


def lexical_features(df: DataFrame, url: str, host: str, path: str) -> DataFrame:
    """The features that a URL has by itself, and its suffixes."""
    u, h, p = F.coalesce(F.col(url), F.lit("")), F.col(host), F.col(path)
    n = F.greatest(F.length(u), F.lit(1))
    parts = F.split(h, "\\.")
    return df.withColumns({
        "length": F.length(u), "host_length": F.length(h), "path_length": F.length(p),
        "depth": F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit(""))),
        "subdomains": F.size(parts),
        "digit_ratio": (F.length(u) - F.length(F.translate(u, "0123456789", ""))) / n,
        "letter_ratio": (F.length(u) - F.length(F.translate(u, UPPER + LOWER, ""))) / n,
        "hyphens": F.length(h) - F.length(F.replace(h, F.lit("-"), F.lit(""))),
        "entropy": entropy(u), "host_entropy": entropy(h),
        "parameters": F.length(u) - F.length(F.translate(u, "=&", "")),
        "has_fragment": F.contains(u, F.lit("#")).cast("int"), "is_https": F.startswith(u, F.lit("https")).cast("int"),
        "tld": F.substring_index(h, ".", -1), "domain": F.substring_index(h, ".", -2)})


def suffix_share(counts: DataFrame, suffix: str, name: str) -> DataFrame:
    """Smoothed share of blocked URLs per suffix, from the counts of all
    labelled URLs."""
    return counts.filter(F.col(suffix).isNotNull()).groupBy(suffix).agg(
        ((F.sum("blocked") + 0.5) / (F.sum("n") + 1)).alias(name))


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
               sample: int = 20_000, trees: int = 10, depth: int = 3, threshold: float = 0.5) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, p_block (null where a
    rule decides). ``rules``: (verdict, "host/path") pairs."""
    host, path = host_and_path(F.col(url_col))
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    src = src.withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules))
    src = lexical_features(src, "url", "host", "path")
    labelled = src.filter("hit is not null").withColumn("label", (F.col("hit.verdict") == "block").cast("double"))
    # per domain (and so its tld): labelled and blocked URLs
    counts = stored(labelled.groupBy("tld", "domain").agg(F.count("*").alias("n"), F.sum("label").alias("blocked")), "url-suffixes")
    n, blocked = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0.0))).first()
    # drawn where the rows lie, at a rate that follows from the count
    share = 1.0 if n <= sample else min(1.0, 1.2 * sample / n + 10 / n)
    taken = labelled.filter(F.pmod(F.xxhash64(F.lit("draw"), "url", "id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    picked = stored(taken.orderBy(F.xxhash64("url", "id"), "id").limit(sample).drop("hit"), "url-sample")
    one_class = n == 0 or blocked in (0, n) or picked.select("label").distinct().count() < 2
    decided = [F.col("hit.rule").alias("rule")]
    if one_class:
        verdict = "block" if 2 * blocked > n else "allow"
        return src.select("id", "host", "path", *decided, F.coalesce("hit.verdict", F.lit(verdict)).alias("verdict"),
                          F.lit(None).cast("double").alias("p_block"))
    prior = blocked / n
    shares = [("tld", "tld_block", suffix_share(counts, "tld", "tld_block")),
              ("domain", "domain_block", suffix_share(counts, "domain", "domain_block"))]

    def with_shares(df: DataFrame) -> DataFrame:
        for key, name, share in shares:
            df = df.join(share, key, "left").withColumn(name, F.coalesce(name, F.lit(prior)))
        return df

    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7).fit(
        assembler.transform(with_shares(picked)).select("features", "label"))
    scored = model.transform(assembler.transform(with_shares(src)))
    from pyspark.ml.functions import vector_to_array
    p = vector_to_array("probability")[1]
    open_ = F.col("hit").isNull()
    return scored.select("id", "host", "path", *decided,
                         F.when(open_, F.when(p >= threshold, "block").otherwise("allow"))
                         .otherwise(F.col("hit.verdict")).alias("verdict"), F.when(open_, p).alias("p_block"))
