"""Session helpers: reading tables, reliable checkpoints and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table `name` below the folder `root`."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where the session names none, one is made if it runs on one machine; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not found and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="citeloom-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """`df` written once to the shared checkpoint folder, so that later stages neither recompute it nor depend on executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared checkpoint folder, for loops: its size is that of its files, where a checkpoint keeps the estimate of its plan,
    which grows with every turn."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side_by_side(spark: SparkSession, *functions: Callable[[], DataFrame]) -> list[DataFrame]:
    """What the functions give, in their order; the jobs that they run meanwhile share the cluster instead of waiting for each other."""
    with ThreadPoolExecutor(max(1, len(functions))) as pool:
        return [made.result() for made in [pool.submit(inheritable_thread_target(spark)(f)) for f in functions]]


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """A broadcast hint where the proven number of rows is at most `limit`; otherwise the plain frame, to be shuffled."""
    return F.broadcast(df) if rows <= limit else df


def broadcast_if_fits(df: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """A broadcast hint where the bytes of all rows, counted over a stored frame, are at most `limit`: of texts and arrays as they are, of others 16 each."""
    size = F.lit(0)
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        own = F.octet_length(f.name) if kind == "string" else 8 * F.size(f.name) if kind == "array" else F.lit(0)
        size = size + 16 + F.greatest(F.coalesce(own, F.lit(0)), F.lit(0))
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` hashed by `keys` into spark.sql.shuffle.partitions parts, none of which AQE joins: for steps whose output is many times their input."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def widen(df: DataFrame, key: str) -> DataFrame:
    """`df` dealt out by `key` if it is a scan of fewer parts than there are cores: for heavy work per row on small files.

    Spark cuts files into parts of the open cost or more, so the parts follow from the size and nothing runs to count them.
    Wider scans, and frames that aren't plain scans of files, stay as they are, unshuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return df
    conf = spark._jsparkSession.sessionState().conf()
    part = min(conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes())
    size = int(str(plan.stats().sizeInBytes()))
    if size < cores * part:  # then the files are few enough to count; each costs as much as a part to open
        size += part * len(plan.relation().location().inputFiles())
    return df.repartition(cores, key) if size < cores * part else df
