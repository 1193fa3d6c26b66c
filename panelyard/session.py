"""Session defaults, the shared folder, and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Only settings the operators rely on. Shuffle partition counts, memory and file split sizes belong to
# whoever runs the job.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call-site capture costs more than the rest of building a long plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(
    app: str = "panelyard", master: str | None = None, extra: dict[str, str] | None = None
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_base(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset a private folder is made, but only for a local master: on a cluster a machine-local
    folder would be lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if named is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            named = tempfile.mkdtemp(prefix="panelyard-")
        context.setCheckpointDir(named)
    return named or context.getCheckpointDir()


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, never used before."""
    return f"{checkpoint_base(spark).rstrip('/')}/panelyard/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and go on from there, so a lost executor costs no recomputation."""
    checkpoint_base(df.sparkSession)
    return df.checkpoint(eager=True)
