"""Session construction and the shared scratch folder.

Everything that must outlive one task (lineage cuts, derived files, streaming
checkpoints) goes under the folder the cluster names in ``spark.checkpoint.dir``.
Only when a session has none (local tests) do we create one ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every session of ours wants.  Shuffle partitions are sized for the
# data by AQE (coalescing small ones, splitting skewed ones) so the static
# number only sets the upper bound.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Streaming state (dedup keys, limiter windows, per-run folds) lives in
    # RocksDB: off-heap, spills to local disk, checkpointed incrementally.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "sparkmill", shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # The driver may hand us a session built elsewhere: make the settings
    # that change results (time zone) hold there too.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared lineage/scratch folder of this cluster.

    Read from the session; only when it is unset in local mode (one machine: tests, bench)
    do we create and register a local one.  On a cluster an unset folder is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: only the session setting is visible
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share") from None
        return d
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if d:
            sc.setCheckpointDir(d)
            d = sc.getCheckpointDir()
    if not d:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="sparkmill-ckpt-")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir()
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}") if "://" not in base else \
        f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint (never localCheckpoint): survives executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession | None = None) -> None:
    """Make ``sparkmill`` importable in executor Python workers (once per application).

    Functions that run in Python workers (the BPE counter, the streaming
    limiter's state function) refer to this package.  The package is zipped on
    the driver and distributed with ``addPyFile``, Spark's own code-shipping
    mechanism, which works the same on a cluster as in local mode.
    """
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect ships code through its own artifacts API
        return
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    # The zip goes under the session's shared folder when Python can write
    # there (a local or file: path); on a remote filesystem it is built on the
    # driver and ``addPyFile`` itself uploads it to every executor.
    base = checkpoint_dir(spark)
    local = base[len("file:"):] if base.startswith("file:") else (None if "://" in base else base)
    folder = os.path.join(local, f"pkg-{uuid.uuid4().hex[:12]}") if local else tempfile.mkdtemp(prefix="sparkmill-pkg-")
    os.makedirs(folder, exist_ok=True)
    zpath = os.path.join(folder, "sparkmill.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)
