"""Shared plumbing of the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that Python code handles at a time, so that a batch of long texts stays small in memory.
ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, as strings Spark may hand to Python; any other column, whatever its name, stays out."""
    return docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias(text))


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema, rows: int = ROWS) -> DataFrame:
    """mapInArrow over pieces of at most ``rows`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def fresh(name: str, columns: list[str]) -> str:
    """The name, with underscores behind it as long as one of the columns has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir, which all executors share; only where that is unset (tests), under the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_cut"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder as Parquet and read them from there.

    Unlike an RDD checkpoint this keeps column pruning and true sizes, so that
    small tables are broadcast by the optimiser's own size check.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and that no plan will read again."""
    for df in tables:
        remove(df.sparkSession, df._cut)


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
