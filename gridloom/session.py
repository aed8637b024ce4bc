"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on.  They are defaults: a cluster session that
# already carries its own values keeps them.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join that feeds an aggregate on the same key must still be allowed to
    # split a hot partition; the extra exchange is cheaper than the straggler.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "gridloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; ``master`` only for local runs."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_defaults(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL defaults above on a session made elsewhere."""
    for key, value in SESSION_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def ship_packages(spark: SparkSession, root: str, packages: tuple[str, ...]) -> None:
    """Send source packages to the Python workers of a session made elsewhere, once per context.

    Workers import the functions they run; they see the driver's folder only when they
    happen to start in it.
    """
    context = spark.sparkContext
    if getattr(context, "_gridloom_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="gridloom-src-"), "gridloom_src.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for package in packages:
            for folder, _, files in os.walk(os.path.join(root, package)):
                for name in sorted(f for f in files if f.endswith(".py")):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    context.addPyFile(archive)
    context._gridloom_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder, read from ``spark.checkpoint.dir``.

    There is no fallback: a folder made here would exist on one machine and be lost with it.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and go on from there.

    A written table is computed once, survives the loss of executors, and carries its
    real size - an iterated ``checkpoint()`` keeps multiplying the size estimates of
    the plan it replaced.  ``replaces`` is a table of an earlier call that nothing needs
    once this one is written; its folder is deleted.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/gridloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._gridloom_path = path
    spent = getattr(replaces, "_gridloom_path", None)
    if spent:
        folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(spent)
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return written
