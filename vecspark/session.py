"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def get_session(app: str = "vecspark", cpus: str | int | None = None,
                shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the cluster's own session."""
    cpus = cpus or os.environ.get("BENCH_CPUS") or "*"
    parts = shuffle_partitions or int(os.environ.get("VECSPARK_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("VECSPARK_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; where it is unset, a local session (tests) gets a folder of its own.

    A cluster without it is refused: executors do not share a machine-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="vecspark-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def shared_dir(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint location for written intermediate tables (any Spark filesystem)."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return base.rstrip("/") + "/tables/" + name


def posix_dir(spark: SparkSession, name: str) -> str:
    """A shared folder written with plain file I/O (binary vector formats): the checkpoint
    location must be a mounted POSIX path (``file:`` or no scheme), e.g. NFS on a cluster."""
    path = shared_dir(spark, name)
    if "://" in path:
        raise ValueError(f"binary formats need a POSIX-mounted shared folder, got {path}")
    os.makedirs(path, exist_ok=True)
    return path


def cut_lineage(df):
    """Checkpoint into the shared checkpoint folder: nothing stays cached.

    Used inside iterative jobs so each round starts from a short plan; a lost
    executor re-reads the checkpoint instead of replaying every round.
    """
    return df.checkpoint()


#: bytes of rows that one Arrow batch brings to a Python worker, about
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches to Python workers end at ``BATCH_BYTES`` (Spark's default: 64 MB and 10 000 rows).

    A task holds a batch in the executor's buffers (which double as they grow), in the worker, and once more as Python
    objects, so wide rows (texts, blocks) cost a multiple of it.  A smaller limit of the session stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size, unit = re.fullmatch(r"(\d+)([kmgt]?)i?b?", spark.conf.get(name).strip().lower()).groups()
    if int(size) << 10 * " kmgt".index(unit or " ") > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``vecspark`` importable in every Python worker (``addPyFile`` of a zip, once per application).

    Functions run by ``mapInPandas`` / ``applyInPandas`` are pickled by reference to
    this package, so executors must be able to import it.  The zip is written to
    the shared checkpoint folder and distributed by Spark.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile

    import vecspark
    pkg = os.path.dirname(os.path.abspath(vecspark.__file__))
    folder = shared_dir(spark, "pyfiles")
    if "://" in folder:        # code only: Spark ships addPyFile content to executors itself
        folder = tempfile.mkdtemp(prefix="vecspark-pyfiles-")
    os.makedirs(folder, exist_ok=True)
    zpath = os.path.join(folder, f"vecspark-{key}.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)
