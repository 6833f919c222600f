"""Session helpers: table access, lineage cuts on shared storage, skew-safe joins."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``; only on one machine (``local[...]``, as in tests) and
    where that is unset a folder of our own is used. A cluster without the setting is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    own = getattr(spark.sparkContext, "_lodeweave_dir", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="lodeweave-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext._lodeweave_dir = own
        spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def cut(df: DataFrame, eager: bool = True, loop: bool = False) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    ``loop``: also forget what the planner has derived of the rows (constraints, partitioning); a checkpoint
    keeps that, and in a loop it multiplies with every round until planning takes longer than the work.
    """
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=eager)
    if not loop:
        return out
    jdf = out._jdf
    return DataFrame(jdf.sparkSession().internalCreateDataFrame(jdf.queryExecution().toRdd(), jdf.schema(), False), df.sparkSession)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], salt_by: Column, counts: DataFrame, salts: int = 32, how: str = "inner", least: int = 10_000) -> DataFrame:
    """Equi-join in which one key may hold a third of ``big``.

    ``small`` has one row per key and ``counts(*keys, n)`` the number of rows of ``big`` per key, nulls apart. Keys
    with more than a thousandth of the rows, and more than ``least``, are hot; there are under a thousand of them, whatever the size,
    so their list is broadcast. Only their rows are spread over ``salts`` tasks, and only their row of ``small``
    is repeated. AQE splits what is still too large.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("n") > max(total / 1000, least)).select(*keys, F.lit(True).alias("_hot")))
    left = big.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = small.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def rows_up_to(df: DataFrame, most: int) -> int | None:
    """The number of rows if it is at most ``most``, else None; never reads further than needed."""
    n = df.limit(most + 1).count()
    return n if n <= most else None


def local_master() -> str:
    return f"local[{os.environ.get('BENCH_CPUS', '8')}]"
