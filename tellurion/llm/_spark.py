"""What the operators share on the Spark side: columns, cut points, sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is named a temporary one serves on a single machine; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tellurion-checkpoint-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it from there, so that its lineage ends and a lost executor costs nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return int(docs.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0)


def shards(n_bytes: int, per_shard: int = 8 << 20, least: int = 12) -> int:
    """As many parts as hold about per_shard bytes each."""
    return max(least, -(-n_bytes // per_shard))


#: Tables that table() has written and nobody has dropped yet.
_written: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drops, at its end, the tables written since. What was read from them must have been written elsewhere by then."""
    before = len(_written)
    try:
        yield
    finally:
        drop(spark, *_written[before:])
        del _written[before:]


def drop(spark: SparkSession, *paths: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


def table(df: DataFrame) -> DataFrame:
    """Like cut(), as a compressed table: for wide rows."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tellurion-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_small(large: DataFrame, small: DataFrame, on: list[str], most_rows: int, how: str = "inner") -> DataFrame:
    """Sends `small` to every executor if it has most_rows at most, as counted here; else both sides are shuffled."""
    if small.count() <= most_rows:
        small = F.broadcast(small)
    return large.join(small, on, how)
