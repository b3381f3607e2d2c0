"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the text operators split on, besides the space itself.
OTHER_SPACES = "\t\n\x0b\x0c\r"
#: Spark's setting by which a query's shuffles go when it ends.
DELETE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Only a local session, whose executors are the driver, may have none set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="echofield-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the running stage only. So the shuffles
    behind the table aren't needed any more, and Spark is told to delete them. The table
    is removed by ``release``, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(DELETE_SHUFFLES, None)
    spark.conf.set(DELETE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(DELETE_SHUFFLES) if before is None else spark.conf.set(DELETE_SHUFFLES, before)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out), path)
    return out


_paths: dict[int, tuple[weakref.ref, str]] = {}


def release(df: DataFrame) -> None:
    """Remove the table behind a result of ``written`` that nothing reads any more."""
    held = _paths.pop(id(df), None)
    if held and held[0]() is df:
        _remove(df.sparkSession, held[1])


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone by then; the folder is scratch space
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def one_spaced(column: str = "text"):
    """The text with each run of white space as one space; null counts as empty.

    Byte-wise replacements keep the regular expression, several times slower, for the
    texts that hold two spaces in a row.
    """
    text = text_or_empty(column)
    for space in OTHER_SPACES:
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, "  +", " ")).otherwise(text)


def word_count(column: str = "text"):
    """Number of maximal runs of other characters than white space."""
    text = F.trim(one_spaced(column))
    return F.when(text == "", 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key is hot with over this share of all rows (and HOT_ROWS of them).
HOT_SHARE = 1 / 512
HOT_ROWS = 1000
SALTS = 64


def salted_join(rows: DataFrame, facts: DataFrame, keys: list[str], size: str, spread: Column) -> DataFrame:
    """rows with the facts of their key; facts has one row for each key.

    ``size`` is the column of facts with the number of rows of the key, ``spread`` any
    number that differs among rows of a key. Hot keys are dealt over SALTS tasks. There
    are at most 1 / HOT_SHARE of them, so the list of them is broadcast.
    """
    total = facts.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    least = max(HOT_ROWS, int(total * HOT_SHARE))
    hot = F.broadcast(facts.where(F.col(size) > least).select(*keys, F.lit(True).alias("hot")))
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    salted = facts.withColumn("salt", F.explode(F.when(F.col(size) > least, every).otherwise(F.array(F.lit(0)))))
    dealt = rows.join(hot, keys, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(spread, F.lit(SALTS)).cast("int")).otherwise(0))
    return dealt.join(salted, [*keys, "salt"]).drop("salt", "hot")
