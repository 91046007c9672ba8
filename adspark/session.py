"""Session settings and the shared working folder.

Lineage cuts and intermediate tables go to the folder named by
``spark.checkpoint.dir`` (a shared filesystem on a cluster). Only a local
session without that setting gets a private temporary folder, as in tests.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Keyed stream state (a lifetime cap keeps a counter per pair for ever) lives outside the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A batch writes what changed in the state, not a snapshot of each store.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "adspark", extra: dict | None = None) -> SparkSession:
    """A session with the settings every operator assumes (UTC, AQE, Arrow)."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(REQUIRED_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give every Python worker this package, as a zip that Spark sends to the executors; done once a context.

    Needed wherever the package is not installed on the workers: the functions
    of the text operators and streams are imported there. ``build_session``
    calls it; call it on a session of your own.
    """
    sc = spark.sparkContext
    if any(os.path.basename(str(f)) == "adspark.zip" for f in sc.listFiles):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="adspark-zip-")
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "adspark"), "zip", os.path.dirname(here), os.path.basename(here)))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; set a private one only for local sessions."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        try:
            conf_dir = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            conf_dir = None
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="adspark-ckpt-", dir="/tmp"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    root = checkpoint_root(spark)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df):
    """Write a (small, fitted) table to the shared checkpoint folder and cut its lineage.

    Used for fitted transforms (encoder, scaler, weights) that many later
    joins read: they are computed once instead of once per join.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df, name: str):
    """Write ``df`` as Parquet under the shared folder and read it back: columnar, pruned by its readers, lineage cut."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_intermediates(spark: SparkSession) -> None:
    """Delete the tables and checkpoints this session wrote under the shared folder.

    Call it when the results that read them have been written: every staged
    table (cleaned rows, fitted transforms, replay logs, stream checkpoints)
    lies in one folder of the session's own, which Spark named.
    """
    folder = spark.sparkContext.getCheckpointDir()
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        spark.sparkContext.setCheckpointDir(os.path.dirname(folder.rstrip("/")))
