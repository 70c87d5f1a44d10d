"""Session helpers: a tuned SparkSession for tests/bench and the shared
checkpoint folder used to cut lineage in iterative operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "repolens") -> SparkSession:
    """Return a SparkSession configured for the operators in this package.

    On a cluster, call with ``master=None`` and let spark-submit decide; the
    settings below are the ones the operators rely on (AQE for skew and
    partition coalescing, UTC, Arrow for the few Python stages).
    """
    b = SparkSession.builder.appName(app_name)
    local = master is not None and master.startswith("local")
    if master is not None:
        b = b.master(master)
    if shuffle_partitions is not None or local:
        # Local runs: about two shuffle partitions per core.  On a cluster the
        # deployment's value stands (size it to ~128-256 MB per partition);
        # AQE coalesces downwards either way.
        cpus = int(os.environ.get("BENCH_CPUS", "8"))
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus * 2))
    if local:
        b = b.config("spark.driver.memory", os.environ.get("REPOLENS_DRIVER_MEM", "16g"))
    b = (b.config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, set at most once.

    A folder that is already set stays.  Otherwise ``spark.checkpoint.dir``
    names a shared (reliable) folder.  Only a single-machine session without
    either gets a scratch folder; on a cluster that would be one machine's
    disk, so it is an error there.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            d = tempfile.mkdtemp(prefix="repolens-ckpt-")
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir()


_scratch: list[str] = []


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the shared checkpoint folder; it is deleted
    when this process ends."""
    if not _scratch:
        atexit.register(_delete_scratch)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def _delete_scratch() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and not spark.sparkContext._jsc.sc().isStopped():
        for path in _scratch:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ship_package(spark: SparkSession) -> None:
    """Make ``repolens`` importable on executors (Python workers run the
    ``mapInPandas`` steps).  Zips the package once per SparkContext, copies
    the zip into the shared checkpoint folder with the Hadoop FileSystem API
    (HDFS, object stores, local) and adds it with ``addPyFile`` -- the
    programmatic form of ``--py-files``.  Executors fetch it from there, not
    from a machine-local folder."""
    import hashlib
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_repolens_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    local = os.path.join(tempfile.mkdtemp(prefix="repolens-pyfiles-"), "repolens.zip")
    digest = hashlib.sha1()
    with zipfile.ZipFile(local, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in sorted(os.walk(pkg)):
            if "__pycache__" in d:
                continue
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
                    with open(full, "rb") as fh:
                        digest.update(fh.read())
    target = local
    ckpt = ensure_checkpoint_dir(spark)
    if ckpt:
        jvm = sc._jvm
        dst = jvm.org.apache.hadoop.fs.Path(f"{ckpt.rstrip('/')}/pyfiles/repolens-{digest.hexdigest()[:16]}.zip")
        fs = dst.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path(local), dst)
        target = dst.toString()
    sc.addPyFile(target)
    sc._repolens_shipped = True
