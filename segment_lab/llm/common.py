"""Helpers shared by the corpus operators: tables, scratch storage, text scans."""

from __future__ import annotations

import atexit
import ctypes
import functools
import inspect
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: ASCII white space that separates words (space and \t \n \v \f \r).
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_SEPARATOR = np.zeros(256, dtype=bool)
IS_SEPARATOR[list(SEPARATORS)] = True

#: Odd multiplier of the polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)

#: Texts are scanned in pieces of about this many bytes (one longer text is one piece).
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- scratch tables

_SCRATCH: list[tuple[SparkSession, str]] = []


def new_scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir`` (shared by all executors)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    It cuts the lineage: a lost executor costs the tasks it ran, not the
    scans behind the table, and every later reader sees the same rows.
    """
    path = new_scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession | None = None) -> None:
    """Delete the scratch tables made so far; call it when their results are stored."""
    while _SCRATCH:
        session, path = _SCRATCH.pop()
        try:
            jvm = session.sparkContext._jvm
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the session has ended: nothing can be deleted any more
            return


atexit.register(drop_scratch)


def width(spark: SparkSession) -> int:
    """The number of shuffle partitions the cluster is set to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_by_size(big: DataFrame, small: DataFrame, key: str, rows: str, total: int, share: int = 1000) -> DataFrame:
    """Left join of ``big`` with ``small``, which has one row a key and in ``rows`` how many rows of ``big`` have it.

    Keys that more than a ``share``-th of all ``total`` rows have are fewer
    than ``share``; they are joined by broadcast, so the rows of one never
    meet in one task.  All others are joined by a shuffle.
    """
    limit = max(1, total // share)
    hot, cold = F.broadcast(small.where(F.col(rows) > limit)), small.where(F.col(rows) <= limit)
    return big.join(hot, key).unionByName(big.join(hot.select(key), key, "left_anti").join(cold, key, "left"))


# ---------------------------------------------------------------- memory of Python workers

_KEPT: dict = {}


def worker_cache(owner: str) -> dict:
    """What ``owner`` keeps between the tasks of a Python worker; another owner's things are dropped first.

    Workers are reused by the stages of a job, so each holds the tables of
    one operator only.
    """
    if owner not in _KEPT:
        _KEPT.clear()
        _KEPT[owner] = {}
    return _KEPT[owner]


def give_back() -> None:
    """Hand freed memory back to the system at the end of a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps its own rules


def giving_back(run):
    """Wrap a batch function (of an iterator, or of tables) so that it ends with ``give_back``."""
    if inspect.isgeneratorfunction(run):
        @functools.wraps(run)
        def wrapped(batches):
            yield from run(batches)
            give_back()
    else:
        @functools.wraps(run)
        def wrapped(*tables):
            out = run(*tables)
            give_back()
            return out
        wrapped.__signature__ = inspect.signature(run)
    return wrapped


# ---------------------------------------------------------------- texts as bytes

def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text (a longer row alone)."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words of each row."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets) - 1, np.int64)
    gap = IS_SEPARATOR[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # a word never continues into the next row
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = gap[:-1]
    starts = np.flatnonzero(~gap & (before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = gap[1:]
    ends = np.flatnonzero(~gap & (after | first[1:])) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (in place)."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_POWERS[0]) < n:
        for k, b in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums P; the hash of data[s:e] is (P[e] - P[s]) * BASE**-s."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=out[1:])
    return out


def hash_spans(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


# ---------------------------------------------------------------- columns

def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front of those that ``df`` already uses."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out
