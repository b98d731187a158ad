"""Shared ground of the operators: the shared folder, written steps, inputs."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six separators of words: space and \t to \r.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a key below which it is never hot.
HOT_ROWS = 1000
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where a session on one machine (tests) names none, a temporary folder is made once; on a
    cluster that would scatter rows over the machines, so it is an error.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spoorline-")
    return _own[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing uses yet; what is there when the driver ends goes."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)  # only a path that exists can be marked
    fs.deleteOnExit(p)
    fs.delete(p, True)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """The same rows, written to the shared folder and read back: lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what written() wrote for these frames, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "written_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now: it does so once the driver has
    collected what names them, which a driver with little to do comes to late. The first round
    frees the names that Python held, the second what they stood for."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """The number of words: each with the blanks around it becomes a letter, what is left are blanks.

    No word is made a string of its own, so a task leaves little behind for each text.
    """
    marks = F.regexp_replace(text, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    return F.coalesce(F.char_length(F.translate(marks, " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hashed(c: Column, bits: int, seed: str) -> Column:
    """The first bits (a multiple of 4, up to 60) of md5(seed:c) as a long; null hashes as ''."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(c.cast("string"), F.lit("")))), 1, bits // 4), 16, 10).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(counts: DataFrame, keys: list[str], total: int, tag: str) -> DataFrame | None:
    """(keys, n) -> the keys that hold over a quarter of a partition's fair share of total rows, as a
    written table; none: None. There are at most four for each partition, whatever the rows."""
    share = max(HOT_ROWS, total // (4 * partitions(counts.sparkSession)))
    hot = written(counts.filter(F.col("n") > share).select(*keys), tag)
    return None if hot.isEmpty() else hot


def join_spread(rows: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows.join(small, keys, how) for inner, left and left_semi, where rows of hot keys stay in the
    tasks that they are in.

    The hot keys' part of small is written, so that Spark knows its size and broadcasts it below
    its threshold; the other rows meet by shuffling as they would.
    """
    if hot is None:
        return rows.join(small, keys, how)
    few = written(hot.join(small, keys, how), "hot-part")  # for left: with nulls where small has none
    cold = rows.join(hot, keys, "left_anti").join(small, keys, how)
    return cold.unionByName(rows.join(few, keys, "inner" if how == "left" else how))
