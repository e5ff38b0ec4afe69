"""Parquet sinks: rehydrated pairs, and the write-once cache of tokenised splits."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from prefweave.sources.csv_edge import write_csv


def write_pairs(pairs: DataFrame, path: str, overwrite: bool = False, format: str = "parquet") -> None:
    """A6. Write rehydrated pairs; existing ones stay, with an error, unless `overwrite` is set."""
    mode = "overwrite" if overwrite else "errorifexists"
    if format == "csv":
        write_csv(pairs, path, mode)
    else:
        pairs.write.mode(mode).format(format).save(path)


def cache_key(model_name: str, max_length: int, split: str, source: str, seed: int, **options) -> str:
    """Folder name of a cached split. The fingerprint covers what model and length do not: where the rows come
    from, the seed that drew them, and the options they were made with."""
    described = json.dumps({"source": source, "seed": seed, **options}, sort_keys=True, default=str)
    fingerprint = hashlib.sha256(described.encode()).hexdigest()[:16]
    return f"processed_{model_name.replace('/', '_')}_{max_length}_{fingerprint}_{split}"


# What a finished copy says of itself, written in one step when it is whole.
MANIFEST = "published double, build string, rows bigint, checksum string"


def _table_mark(df: DataFrame) -> tuple[int, str]:
    """Rows, and a sum of their hashes, which their order and their files do not change."""
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")
    row = df.agg(F.count("*"), F.coalesce(F.sum(hashed), F.lit(0)).cast("string")).first()
    return row[0], row[1]


def published(spark: SparkSession, path: str) -> Row | None:
    """The manifest of the copy that readers of `path` take: the first published, by time and then name; None if there is none."""
    try:
        manifests = spark.read.schema(MANIFEST).parquet(f"{path}/manifests")
        return manifests.orderBy("published", "build").first()
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def publish(df: DataFrame, path: str) -> Row:
    """Write `df` in a folder of its own below `path` and publish it there, unless a copy is published already.

    The manifest is one file, which appears when it is whole; nothing is ever overwritten. So a reader sees the files of one
    builder only, whoever else is building. Of two that publish at once the first by the clock is taken from then on;
    the files of the other, and of builders that failed, stay unread.
    """
    spark, build = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}/build-{build}")
    rows, checksum = _table_mark(spark.read.schema(df.schema).parquet(f"{path}/build-{build}"))
    if published(spark, path) is None:
        manifest = spark.createDataFrame([(time.time(), build, rows, checksum)], MANIFEST)
        manifest.coalesce(1).write.mode("append").parquet(f"{path}/manifests")
    return published(spark, path)


def cached(spark: SparkSession, base: str, key: str, build: Callable[[], DataFrame], check: bool = False) -> DataFrame:
    """A7. The table under `base`/`key`; built and published first if no finished copy is there.

    With `check`, rows and checksum are held against the manifest before the table is handed out.
    """
    path = f"{base.rstrip('/')}/{key}"
    manifest = published(spark, path) or publish(build(), path)
    table = spark.read.parquet(f"{path}/build-{manifest['build']}")
    if check and _table_mark(table) != (manifest["rows"], manifest["checksum"]):
        raise ValueError(f"the table in {path} is not the one that was published")
    return table
