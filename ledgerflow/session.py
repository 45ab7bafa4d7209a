"""Session construction and the few cluster-facing helpers every job shares."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Defaults for a session we build ourselves (tests, bench).  On a cluster the
# caller's session wins: nothing here overrides a value that is already set.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # The planner broadcasts a side whose files are small; AQE one whose
    # finished shuffle stage measured small.  The operators mark only frames
    # whose bytes they measured while writing them (cut_for_join).
    "spark.sql.autoBroadcastJoinThreshold": str(8 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Settings for the production scale (~100 TB input, ~1000 executors).  Start
# with many shuffle partitions and let AQE coalesce them to ~256 MiB each;
# split input files into 512 MiB read tasks; split skewed shuffle partitions
# above 5x the median (and 512 MiB); allow the runtime broadcast of a
# finished shuffle stage up to 64 MiB.
CLUSTER_CONF = {
    **DEFAULT_CONF,
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(64 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(512 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.sources.bucketing.enabled": "true",
    "spark.sql.sources.v2.bucketing.enabled": "true",
    "spark.task.maxFailures": "8",
    "spark.stage.maxConsecutiveAttempts": "8",
}


def build_session(master: str | None = None, app: str = "ledgerflow",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the defaults above."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session.  Only where it is unset
    and the master is local (tests) is a folder made under the temp folder; on
    a cluster every executor would write to a disk of its own, so that raises.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # a session without a local SparkContext (Spark Connect)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not configured:
        if not re.match(r"local($|\[)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="ledgerflow-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder, written once.

    Used between the steps of long change chains (cascades) so that a lost
    executor re-reads the checkpoint instead of recomputing the whole chain.
    Never ``localCheckpoint``: its blocks die with the executor.  The files go
    with the DataFrame when ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set, as the defaults above do.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SCRATCH: set[str] = set()


def scratch_folder(spark: SparkSession) -> str:
    """A folder beside the checkpoints for this driver's own tables, removed when the driver ends."""
    folder = f"{ensure_checkpoint_dir(spark)}/tables"
    if folder not in _SCRATCH:
        _SCRATCH.add(folder)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

        def remove():
            path = jvm.org.apache.hadoop.fs.Path(folder)
            try:
                path.getFileSystem(conf).delete(path, True)
            except Exception as e:  # the driver is ending: say so, nothing more can be done
                print(f"could not remove {folder}: {e}")

        atexit.register(remove)
    return folder


def store(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read from there.

    Survives lost executors as a checkpoint does.  Later reads take only the
    columns they need, and the plan goes on from the files' true sizes: a
    checkpoint keeps the estimate of the plan it cuts, which every further
    join multiplies, so loops over checkpoints of joins soon spend their time
    on estimates thousands of digits long.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Bytes (as measured while the rows were written) under which a checkpointed
# frame is broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024


def _row_bytes(df: DataFrame):
    """Bytes of a row, near enough: what its strings hold, and 16 a column."""
    parts = [F.lit(16 * max(1, len(df.columns))).cast("long")]
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if f.dataType.typeName() in ("string", "binary", "varchar", "char"):
            parts.append(F.coalesce(F.octet_length(col), F.lit(0)).cast("long"))
        elif f.dataType.typeName() in ("array", "map", "struct", "variant"):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(col))), F.lit(0)).cast("long"))
    return reduce(add, parts)


def cut_and_measure(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut_lineage`` and the bytes written, observed on that same pass."""
    seen = Observation()
    ensure_checkpoint_dir(df.sparkSession)
    out = df.observe(seen, F.sum(_row_bytes(df)).alias("bytes")).checkpoint(eager=True)
    return out, int(seen.get.get("bytes") or 0)


def cut_for_join(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Checkpointed ``df``, marked for broadcast if it measured small.

    Past the bound the join is left to the planner and AQE.
    """
    out, size = cut_and_measure(df)
    return F.broadcast(out) if size <= max_bytes else out
