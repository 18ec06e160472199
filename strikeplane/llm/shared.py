"""What the operators of this subpackage share: words, and tables in the shared folder."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: what lies between ASCII white space. bytes.split() cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where none is named and everything runs on one machine, as in tests, a temporary folder takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it again.

    This cuts the lineage: what follows survives the loss of executors without doing the work before it
    again, and rows that a rerun might order otherwise stay as they are. The files go when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as it takes to be none of df's columns."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def with_row_key(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df with a long that each row has to itself, written with it, and that column's name, which df has not."""
    key = free_name(df, "__row")
    return materialize(df.withColumn(key, F.monotonically_increasing_id()), name), key


def join_unhot(rows: DataFrame, table: DataFrame, on: str, n_col: str, total: int | None = None, most: int = 10_000) -> DataFrame:
    """rows joined to table, which has one row for each key and in n_col how many of rows have it; without n_col.

    Keys that more than one in `most` of all rows has can't be more than `most`. They alone are broadcast, so a
    key that a third of all rows share goes nowhere; what is left has no key with more than that share, and is
    dealt by key. total is the number of rows, or a number above it.
    """
    if total is None:
        total = table.agg(F.sum(n_col)).first()[0] or 0
    hot = F.broadcast(table.filter(F.col(n_col) > total / most))
    cold = table.filter(F.col(n_col) <= total / most)
    spread = rows.join(hot.select(on), on, "left_anti").join(cold, on)
    return rows.join(hot, on).unionByName(spread).drop(n_col)


#: Bits of a bitmap of keys at least and at most, as powers of two: 128 MB, however many keys there are.
LEAST_BITS, MOST_BITS = 20, 30


def bitmap(table: DataFrame, key: str, n: int | None = None) -> np.ndarray:
    """64-bit words in which the places of all keys are set, by their upper bits: for in_bitmap(), in every task.

    Keys are longs that are hashes already. There are about 16 places for a key, but never more than 2**MOST_BITS. Others may share a place, more of them
    the more keys there are beyond that bound, so what passes must be told apart by a join or a count. n is the
    number of keys.
    """
    n = table.count() if n is None else n
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(16 * max(1, n)))))
    place = F.shiftrightunsigned(F.col(key), 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    words = table.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def in_bitmap(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (64-bit) may be among those that bitmap() was made of: all of them, and some others."""
    bits = len(words).bit_length() - 1 + 6
    place = keys.view(np.uint64) >> np.uint64(64 - bits)
    return (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of the given folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
