"""SparkSession factory and shared-folder helpers.

Everything that must survive executor loss (landed data, cleaned tables,
scratch CSV files, models) goes under the folder the cluster names in
``spark.checkpoint.dir``. We only set one ourselves when the session has
none (local tests).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # CP949 / EUC-KR CSV needs the JVM's extended charsets (see sources.encoding)
    "spark.sql.legacy.javaCharsets": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app_name: str = "qforge",
                shuffle_partitions: int | None = None,
                extra_conf: dict | None = None) -> SparkSession:
    """Return the active session, or build one with the engine defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        configure(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> None:
    """Session-level settings the operators rely on (runtime-settable only)."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    checkpoint_dir(spark)


@contextmanager
def compiled_methods(spark: SparkSession, limit: int = 8000) -> Iterator[None]:
    """Actions inside run wide projections as many small methods: HotSpot interprets a method above ``limit`` bytes."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), limit)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; created under /tmp only when unset in local mode (tests), an error on a cluster."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a shared folder")
        conf_dir = tempfile.mkdtemp(prefix="qforge-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return (sc.getCheckpointDir() or conf_dir).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return f"{base}/qforge-scratch/{name}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when the path (or glob) matches anything on its file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.globStatus(p))


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own on its file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
