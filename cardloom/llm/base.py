"""What the corpus operators share: tables, the shared folder and row keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else the context's own checkpoint folder.

    Where neither is set, a local session, as in tests, gets a temporary folder; a cluster must name one, as its executors don't share theirs.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not root and held.isDefined():
        root = held.get()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


#: With this on, a finished write removes the shuffle files it made; without it they stay until the driver's garbage is collected.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors. `drop` deletes it when nothing reads it any more."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_path_ = path
    return out


def drop(*kept: DataFrame) -> None:
    """Delete tables that `keep` wrote, once all that was made from them is itself written."""
    for df in kept:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_path_)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_turn: dict = {"to": None, "free": None}


def turn_to(what: str, free: Callable[[], None] | None = None) -> None:
    """Says in a task what its Python worker works at. Workers go from one operator's tasks to another's and keep what modules remember:
    one that turns to something else lets go of that first (`free`)."""
    if _turn["to"] != what:
        if _turn["free"]:
            _turn["free"]()
        _turn.update(to=what, free=free)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def text_key(c: Column) -> Column:
    """Tells rows with one id and different texts apart; repeated rows share it."""
    return F.xxhash64(c)


def same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Null-safe equality on columns of both sides."""
    out = a[names[0]].eqNullSafe(b[names[0]])
    for n in names[1:]:
        out = out & a[n].eqNullSafe(b[n])
    return out
