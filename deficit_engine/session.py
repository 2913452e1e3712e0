"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every run wants: AQE (runtime coalescing and skew splitting), UTC
# dates, no UI server.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Cluster defaults for ~100 TB inputs, applied only where the launcher has
# not set a value: start shuffles wide and let AQE coalesce them to
# ~256 MB partitions; read files in 256 MB splits.
CLUSTER_CONF = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "16384",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
    "spark.sql.files.maxPartitionBytes": str(256 << 20),
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "deficit_engine", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    ``master`` defaults to ``local[$BENCH_CPUS]`` / ``local[*]`` only when no
    master is configured; on a cluster the launcher's master wins and the
    cluster defaults above fill in what the launcher left unset.
    """
    builder = SparkSession.builder.appName(app)
    launched = "PYSPARK_GATEWAY_PORT" in os.environ or SparkSession.getActiveSession() is not None
    if master is None and not launched:
        cpus = os.environ.get("BENCH_CPUS")
        master = f"local[{cpus}]" if cpus else "local[*]"
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    sc = spark.sparkContext
    sc.setLogLevel("ERROR")
    if not sc.master.startswith("local"):
        explicit = sc.getConf()  # only keys the launcher (or builder) set
        for k, v in CLUSTER_CONF.items():
            if not explicit.contains(k):
                spark.conf.set(k, v)
    checkpoint_dir(spark)
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the launcher to shared storage and is only
    read here; an unset value on a non-local master is an error (a driver-local
    temp folder would silently lose executor output). Only for local masters
    (tests, ad-hoc runs) is a private folder created when it is unset.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        try:
            path = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key raises in some versions
            path = None
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name shared storage on a cluster")
        path = _LOCAL_DIRS.get(sc.applicationId)
        if path is None:
            path = _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="deficit-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path.rstrip("/")
