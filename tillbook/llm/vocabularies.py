"""Where the public tokenizers' vocabulary files lie. The folder is a
parameter: the setting ``spark.tillbook.tokenizers`` names it; otherwise the
installed ``public_tokenizers`` package says where its files are."""

from __future__ import annotations

import importlib.util
import os
import sys

from pyspark.sql import SparkSession


def vocabulary(spark: SparkSession, name: str) -> str:
    folder = spark.conf.get("spark.tillbook.tokenizers", None)
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
