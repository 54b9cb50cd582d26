"""Session helpers: settings, and checkpointing that is safe on a cluster."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


# The JVM never compiles methods above this bytecode size; a generated stage beyond
# it runs interpreted. Below it Spark falls back to split projections, which compile.
HUGE_METHOD_LIMIT = 8000


def tune(spark: SparkSession) -> None:
    """Settings the wide geometry expressions need, where the session still has the defaults."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(HUGE_METHOD_LIMIT))


def local_session(app: str = "ridelattice", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and single-node benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16KB")
        .config("spark.sql.codegen.hugeMethodLimit", str(HUGE_METHOD_LIMIT))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local checkpoint is lost with its machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ridelattice-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
