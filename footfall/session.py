"""Session settings the operators count on."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    # event times are stored without a zone; both engines must read them as UTC
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(app: str, master: str | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or get) a session; cluster deployments leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per context, so that they import it wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_footfall_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='footfall-')}/footfall", "zip", package.parent, package.name)
    context.addPyFile(archive)
    context._footfall_shipped = True


# input rows of one task that sorts or groups them in memory; with smaller parts, map tasks would sooner (beyond 200 parts)
# have to sort what they write, which takes more memory than the parts save
TASK_ROWS = 1_500_000


def parts_for(spark: SparkSession, rows: int) -> int:
    """Parts for a shuffle whose number follows the rows, so that the memory of a task does not."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder the cluster names; only a session without one gets a scratch folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="footfall-ckpt-"))


def materialize(df):
    """Write an intermediate result to the checkpoint folder and read on from there.

    Used where a result is consumed several times: later stages neither recompute it nor lose it with an executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder (a local scratch folder only for local sessions)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return f"{(shared or tempfile.mkdtemp(prefix='footfall-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"
