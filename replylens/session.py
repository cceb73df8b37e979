"""Session settings and stage tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def build_session(
    app: str = "replylens", master: str | None = None, **conf: str
) -> SparkSession:
    """A session with the settings every operator here assumes.

    Partition counts are left to adaptive execution: the initial count is high and
    small partitions are merged at run time, so one setting serves small and large
    inputs. Values passed in ``conf`` win (underscores stand for dots).
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # generated methods beyond this size are never compiled by the JVM's JIT; Spark
        # then splits the projection into small methods instead
        "spark.sql.codegen.hugeMethodLimit": "8000",
    }
    settings.update({key.replace("_", "."): value for key, value in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stage_root(spark: SparkSession) -> str:
    """Folder for stage tables: ``spark.checkpoint.dir`` where the cluster sets it.

    Without the setting, a local session gets a temporary folder. On a cluster the
    warehouse serves if it is in a shared store; a machine's own folder is refused.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        app_id = spark.sparkContext.applicationId
        if app_id not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[app_id] = tempfile.mkdtemp(prefix="replylens-")
        return _LOCAL_ROOTS[app_id]
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith("file:") or "://" not in warehouse:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return warehouse + "/_stages"


#: folder and number of the next stage table, inside ``reused_stages``
_reused: ContextVar[list | None] = ContextVar("reused_stages", default=None)


@contextmanager
def reused_stages(spark: SparkSession, name: str) -> Iterator[None]:
    """Within this block, stage tables go to one folder of that name, numbered in order,
    and replace those of the block before: work that is repeated for ever leaves no more
    files than one round of it. Results must be stored before the block ends."""
    token = _reused.set([f"{stage_root(spark)}/{name}", 0])
    try:
        yield
    finally:
        _reused.reset(token)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a parquet table and return the table.

    Used where a result is read several times. The table cuts the lineage, survives
    lost executors, keeps column pruning, and gives the planner true sizes.
    """
    spark = df.sparkSession
    slot = _reused.get()
    if slot is None:
        path = f"{stage_root(spark)}/{uuid.uuid4().hex}/{name}"
    else:
        path = f"{slot[0]}/{slot[1]:03d}_{name}"
        slot[1] += 1
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def side_by_side(
    spark: SparkSession, tasks: list[Callable[[], object]], parallelism: int = 6
) -> list:
    """Run independent jobs from several threads, so that short ones share the cluster;
    results come back in order."""
    wrap = inheritable_thread_target(spark)
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        return pool.map(lambda task: task(), [wrap(task) for task in tasks])
