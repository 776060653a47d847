"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import atexit
import gc
import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings the library assumes.  UTC keeps timestamp arithmetic identical to
# the DuckDB oracle; AQE coalesces small shuffles and splits skewed joins at
# run time.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpointed tables (see ``materialize``) are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "segment_lab", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session for tests and local runs.

    On a cluster the session normally already exists; this helper is for
    tests, the bench and scripts.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder, setting a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is.  Only when nothing is configured on a local master (tests, local
    runs) do we create a scratch folder; a cluster without the setting is an
    error, because its executors would write to their own disks.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="segment_lab_ckpt_")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder, deleted at the end (see ``drop_scratch``)."""
    path = os.path.join(ensure_checkpoint_dir(spark), "tables", f"{name}_{uuid.uuid4().hex[:12]}")
    _SCRATCH.append((spark, path))
    return path


def scratch_mark() -> int:
    """For ``drop_scratch``: the number of paths handed out so far."""
    return len(_SCRATCH)


def _delete(spark: SparkSession, path: str) -> bool:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        return True
    except Exception:  # noqa: BLE001  the session has ended, nothing can be deleted any more
        return False


def drop_scratch(since: int = 0, keep: int = 0) -> None:
    """Delete what ``scratch_path`` handed out (since a mark, but for the last ``keep``); call it once the results that read it are stored."""
    while len(_SCRATCH) > since + keep:
        if not _delete(*_SCRATCH.pop(-1 - keep)):
            return


def drop_paths(*paths: str | None) -> None:
    """Delete some of what ``scratch_path`` handed out."""
    for entry in [e for e in _SCRATCH if e[1] in paths]:
        _SCRATCH.remove(entry)
        _delete(*entry)


atexit.register(drop_scratch)


def stored(df, name: str = "stored", path: str | None = None):
    """``df`` written and read again: a checkpoint keeps its size estimate, and those of the joins of many rounds multiply without bound."""
    path = path or scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def passing_scratch(spark: SparkSession):
    """What is written under paths handed out inside, and shuffled for it, is deleted at the end.

    Shuffle files go when the driver's collector finds that nothing refers to
    them, which on a driver with free memory can be long after they are used.
    """
    first = scratch_mark()
    try:
        yield
    finally:
        drop_scratch(first)
        free_shuffles(spark)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that no DataFrame refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of rows or trees that are sent to the tasks, and held by one of them, at once.
SENT_BYTES = 1 << 25


def opened(broadcast):
    """A broadcast's value, read anew by each call in a task: a worker that uses many holds one of them at a time."""
    path = getattr(broadcast, "_path", None)
    return broadcast.value if path is None else broadcast.load_from_path(path)


def materialize(df):
    """Compute ``df`` once and cut its lineage (reliable checkpoint).

    For a derived table that several branches of a plan read (for example a
    moments table feeding both a test and a pairwise join): without this each
    branch would rescan the source.  The files go to the session's shared
    checkpoint folder, so a lost executor does not force a recomputation.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``segment_lab`` importable in executor Python workers (once per app).

    Pandas UDFs and ``mapInPandas`` functions are pickled by reference to
    this package, so the workers must be able to import it.  The package's
    sources are zipped and added with ``addPyFile`` (what ``--py-files``
    does); a cluster that already ships the package is unaffected.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(pkg_dir)
    fd, path = tempfile.mkstemp(prefix="segment_lab_", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(path)
    _SHIPPED.add(app)
