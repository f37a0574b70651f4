"""Spark session construction and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import importlib
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every job wants: adaptive execution (runtime coalescing and skew
# splitting of shuffles), UTC session time, Arrow for the few pandas paths,
# and no web UI.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "phonon",
              shuffle_partitions: int | None = None,
              extra_conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    On a cluster, pass ``master=None`` and let spark-submit decide; size
    ``shuffle_partitions`` to the data (AQE coalesces small ones at runtime).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_SHIPPED: set[str] = set()
_RUN = uuid.uuid4().hex


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python once per application, so that
    functions of it run there whatever their working directory."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    name = __name__.split(".")[0]
    root = os.path.dirname(os.path.abspath(importlib.import_module(name).__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join(name, os.path.relpath(path, root)))
    # only the driver reads this file: Spark hands it to the executors itself
    target = os.path.join(tempfile.mkdtemp(prefix="phonon-code-"), f"{name}.zip")
    with open(target, "wb") as out:
        out.write(packed.getvalue())
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def clear_scratch(spark: SparkSession) -> bool:
    """Delete the intermediate tables of this process (also done when it ends)."""
    base = os.path.join(ensure_checkpoint_dir(spark), "tables", _RUN)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath) and fs.delete(jpath, True))


def _clear_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        try:
            clear_scratch(spark)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass


atexit.register(_clear_at_exit)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names a shared file system folder and is used
    as is (and must be set). Only in local mode, when it is unset, a scratch
    folder is created.
    """
    ship_package(spark)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder on shared storage "
                             "(a machine-local folder does not survive executor loss)")
        configured = tempfile.mkdtemp(prefix="phonon-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for intermediate tables of this process under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", _RUN, name)
