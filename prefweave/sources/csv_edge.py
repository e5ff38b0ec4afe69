"""CSV at the edges: reading what pandas wrote, and writing what pandas would write."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefweave import fixed_values as V
from prefweave import schemas
from prefweave.functions.text import author_text, python_bool_text, python_float_text

# A quote inside a field is doubled, and line breaks inside a field belong to it.
_QUOTING = {"quote": '"', "escape": '"'}
_KEEP_SPACES = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_pairs_csv(spark: SparkSession, path: str) -> DataFrame:
    """A4. Rehydrated pairs from CSV with a header; every word pandas reads as missing becomes null.

    All columns are read as text by name, so their order in the file does not matter. Scores are written as 12.0
    once any of them is missing, hence the way over double. A file without the three required columns, or no file,
    is an error. A CSV with line breaks inside fields can only be read by one task per file: keep it at the edge.
    """
    reader = spark.read.options(header=True, multiLine=True, **_QUOTING, **_KEEP_SPACES)
    try:
        raw = reader.csv(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no rehydrated pairs at {path}; write them first") from error
    schemas.require_columns(raw, V.TRAIN_FIELDS, f"rehydrated pairs in {path}")

    def typed(name: str):
        text = F.col(name)
        value = F.when(text.isin(V.CSV_NULL_WORDS), None).otherwise(text)
        kind = schemas.PAIRS[name].dataType if name in schemas.PAIRS.names else T.StringType()
        if isinstance(kind, T.LongType):
            return value.cast("double").cast(kind).alias(name)
        return value.cast(kind).alias(name)

    return raw.select(*[typed(name) for name in raw.columns])


def csv_ready(df: DataFrame) -> DataFrame:
    """Booleans and doubles as the text pandas writes for them."""
    columns = []
    for field in df.schema.fields:
        col = F.col(field.name)
        if isinstance(field.dataType, T.BooleanType):
            col = python_bool_text(col)
        elif isinstance(field.dataType, T.DoubleType):
            col = python_float_text(col)
        columns.append(col.alias(field.name))
    return df.select(*columns)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    csv_ready(df).write.mode(mode).options(
        header=True, emptyValue="", nullValue="", **_QUOTING, **_KEEP_SPACES
    ).csv(path)


def write_posts_csv(posts: DataFrame, path: str) -> bool:
    """A5. Post records to CSV with a header; without any post nothing is written and the answer is False."""
    records = posts.withColumn("author", author_text(F.col("author")))
    if records.isEmpty():
        return False
    write_csv(records, path)
    return True
