"""What the training-data operators share: the word pattern, reading a table, and tables written in the shared folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lowered(c: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(c, UPPER, LOWER)


def n_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of this machine only where the cluster names none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_SHELVES: list[list[str]] = []


@contextlib.contextmanager
def shelf(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that stored() writes inside go at the end, but for those that the caller takes off the list.

    with shelf(spark): operator(docs).write.parquet(path) leaves nothing but the result in the shared folder."""
    own: list[str] = []
    _SHELVES.append(own)
    try:
        yield own
    finally:
        _SHELVES.remove(own)
        for path in own:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here and lost executors cost nothing.

    It stays until shelf() removes it: what reads it may be written much later."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    if _SHELVES:
        _SHELVES[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of the right side of spread_join() that are broadcast, at most: that many keys can have a share of 1 / SPREAD.
SPREAD = 10_000


def spread_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with the columns of right, which has each of left's keys once and in ``rows`` how often left has it.

    Keys with a large share of left's rows, SPREAD at most, are broadcast, so that no task gathers such a key; the others meet by shuffle."""
    total = right.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    often = max(1000, -(-total // SPREAD))
    hot, cold = right.filter(F.col("rows") >= often).drop("rows"), right.filter(F.col("rows") < often).drop("rows")
    keys = hot.select(F.col(key).alias("_hot"))
    out = left.join(F.broadcast(hot), key)
    return out.union(left.join(F.broadcast(keys), left[key] == keys["_hot"], "left_anti").join(cold, key).select(*out.columns))
