"""Packing along a space-filling curve: documents that are alike share sequences.

A document's token counts are hashed into a vector, projected to a few
dimensions and standardised by the corpus' own means and deviations; the
Hilbert key of its cell puts alike documents next to each other.  Whole
sequences are cut off a document first; what is left of all documents is
laid end to end in curve order and cut at every ``size`` tokens.  The last
sequence is cut at powers of two, so nothing is padded at all.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..operators.ordered import running_sums
from .common import chunks, giving_back, utf8, worker_cache, written
from .word_tokens import WordTokenizer, byte_level

#: Length of a document's hashed vector, projected dimensions, bits of a cell in each.
BUCKETS, DIMENSIONS, BITS = 256, 6, 10
SEED = 20
#: Documents whose vectors are held at once.
ROWS = 2048


# ---------------------------------------------------------------- vectors and keys

def directions(buckets: int = BUCKETS, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(buckets, dimensions))


def bucket_of(ids: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets


def projected(ids: np.ndarray, offsets: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """One row a document: its hashed vector (roots of counts, length one) along each direction."""
    buckets, n = turn.shape[0], len(offsets) - 1
    out = np.zeros((n, turn.shape[1]))
    for lo in range(0, n, ROWS):
        hi = min(lo + ROWS, n)
        row = np.repeat(np.arange(hi - lo), np.diff(offsets[lo:hi + 1]))
        held = bucket_of(ids[offsets[lo]:offsets[hi]], buckets)
        x = np.sqrt(np.bincount(row * buckets + held, minlength=(hi - lo) * buckets).reshape(hi - lo, buckets))
        size = np.sqrt((x * x).sum(axis=1, keepdims=True))
        out[lo:hi] = (x / np.maximum(size, 1e-300)) @ turn
    return out


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of integer points (rows), each coordinate below ``2**bits``.

    From the highest bit down, the lower bits of a point are inverted or
    exchanged as the sub-cube it lies in is turned; the Gray code of what
    is left, read across the coordinates, is the key.
    """
    x = [np.array(c, np.int64) for c in np.asarray(cells).T]
    for b in range(bits - 1, 0, -1):
        lower = (1 << b) - 1
        for c in x:
            inside = (c >> b) & 1 == 1
            swap = np.where(inside, 0, (x[0] ^ c) & lower)
            x[0] ^= np.where(inside, lower, swap)
            if c is not x[0]:
                c ^= swap
    for a, b in zip(x, x[1:]):
        b ^= a
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ turn) >> b) & 1)
    return key


# ---------------------------------------------------------------- pieces

def _tokenizer(path: str) -> WordTokenizer:
    cache = worker_cache("curve")
    if path not in cache:
        cache[path] = byte_level(path)
    return cache[path]


def document_pieces(docs: DataFrame, path: str, size: int, end_id: int, keep_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """``(id, doc_tokens, start, length, ids_crc32, ids, x)``: whole sequences of a document, then the rest of it.

    The rest carries its ids (below ``size`` of them); whole sequences carry
    theirs with ``keep_ids`` only.  ``x`` is the document's projected vector.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    end = np.array([end_id], "<u4").tobytes()
    turn = directions()

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column("text"))
            keys = b.column("id")
            for lo, hi in chunks(offsets):
                ids, at = _tokenizer(path).encode(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                x = projected(ids, at, turn)
                raw, at = ids.astype("<u4").tobytes(), at.tolist()
                row, tokens, start, length, crc, body = [], [], [], [], [], []
                for k in range(hi - lo):
                    own = raw[4 * at[k]:4 * at[k + 1]] + end
                    n = len(own) // 4
                    for s in range(0, n, size):
                        part = own[4 * s:4 * (s + size)]
                        whole = len(part) == 4 * size
                        row.append(k)
                        tokens.append(n)
                        start.append(s)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        body.append(part if keep_ids or not whole else None)
                index = np.array(row, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(index + lo)), *(pa.array(v, pa.int64()) for v in (tokens, start, length, crc)),
                     pa.array(body, pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(x[index].ravel()), x.shape[1]).cast(pa.list_(pa.float64()))],
                    ["id", "doc_tokens", "start", "length", "ids_crc32", "ids", "x"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(giving_back(run), f"id {kind}, doc_tokens long, start long, length long, ids_crc32 long, ids binary, x array<double>")


def tail_cuts(begin: int, rest: int) -> list[int]:
    """Where the last ``rest`` tokens are cut: sequences of falling powers of two, starting at ``begin``."""
    out, at = [], begin
    for b in range(rest.bit_length() - 1, -1, -1):
        if rest >> b & 1:
            out.append(at)
            at += 1 << b
    return out


# ---------------------------------------------------------------- operator

def with_key(pieces: DataFrame, dimensions: int, bits: int) -> tuple[DataFrame, int]:
    """``pieces`` with the ``curve_key`` of their document, and the number of tokens that no whole sequence holds."""
    own = F.col("start") == 0  # one row a document
    stats = pieces.agg(F.sum(F.when(F.col("length") < F.col("whole"), F.col("length"))).alias("rest"),
                       *[f(F.when(own, F.col("x")[k])).alias(f"{name}{k}") for k in range(dimensions)
                         for name, f in (("mean", F.avg), ("deviation", F.stddev_pop))]).first()
    mean = np.array([stats[f"mean{k}"] or 0.0 for k in range(dimensions)])
    deviation = np.array([stats[f"deviation{k}"] or 1.0 for k in range(dimensions)])

    @pandas_udf("long")
    def key(x: pd.Series) -> pd.Series:
        z = (np.stack(x.to_numpy()) - mean) / deviation if len(x) else np.zeros((0, dimensions))
        cells = np.floor((1 << bits) / (1 + np.exp(-1.702 * np.clip(z, -20, 20)))).astype(np.int64)
        return pd.Series(hilbert_keys(np.minimum(cells, (1 << bits) - 1), bits))

    return pieces.withColumn("curve_key", key("x")).drop("x"), int(stats["rest"] or 0)


def pack_along_curve(docs: DataFrame, path: str, size: int = 1024, id_col: str = "doc_id", text_col: str = "text",
                     end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Token pieces of all documents and their places in sequences of at most ``size`` tokens.

    ``(<id_col>, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    curve_key[, ids])``.  ``path`` is a byte-level BPE file, ``end_id`` ends
    every document.  Null and empty texts are the end id alone.  Documents of
    equal keys (copies among them) lie in order of a hash of their id, so a
    large group of them is spread over all blocks of the scan.  Repeated
    rows and rows without an id are packed one by one.  All sequences hold
    ``size`` tokens but the last few, which hold powers of two.  An empty
    table gives an empty one; other columns are not read.
    """
    pieces = written(document_pieces(docs, path, size, end_id, keep_ids, id_col, text_col), "curve_pieces") \
        .withColumn("whole", F.lit(size))
    pieces, rest = with_key(pieces, DIMENSIONS, BITS)
    last = rest - rest % size
    tails = tail_cuts(last, rest % size)
    whole = F.col("length") == size
    placed = running_sums(pieces.withColumn("tie", F.xxhash64("id")), None, ["curve_key", "tie", "id", "start", "doc_tokens", "ids_crc32"],
                          {"end": F.when(whole, F.lit(0)).otherwise(F.col("length")).cast("long"),
                           "wholes": F.when(whole, F.lit(1)).otherwise(F.lit(0)).cast("long")})
    keep = [F.col("id").alias(id_col)]
    body = ["ids"] if keep_ids else []
    full = placed.where(whole).select(
        *keep, "start", "length", "ids_crc32", "doc_tokens",
        (F.col("wholes") + (last // size + len(tails) - 1)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "curve_key", *body)
    begin = F.col("end") - F.col("length")
    tail = F.array(*[F.lit(t).cast("long") for t in tails]) if tails else F.array().cast("array<bigint>")
    marks = F.concat(F.array(F.col("end") - 1 - (F.col("end") - 1) % size), tail)
    cut = placed.where(~whole).withColumn("begin", begin) \
        .withColumn("marks", F.array_sort(F.array_distinct(F.filter(marks, lambda m: (m > F.col("begin")) & (m < F.col("end")))))) \
        .withColumn("part", F.explode(F.arrays_zip(F.concat(F.array("begin"), "marks").alias("a"), F.concat("marks", F.array("end")).alias("z"))))
    cut = cut.withColumn("a", F.col("part.a")).withColumn("n", F.col("part.z") - F.col("part.a")) \
        .withColumn("own", F.expr("substring(ids, cast(4 * (a - begin) + 1 AS int), cast(4 * n AS int))"))
    before = F.size(F.filter(tail, lambda m: m <= F.col("a")))  # sequences of the tail begun by then
    rest_of = cut.select(
        *keep, (F.col("start") + F.col("a") - F.col("begin")).alias("start"), F.col("n").alias("length"), F.crc32("own").alias("ids_crc32"),
        "doc_tokens", F.when(before == 0, F.floor(F.col("a") / size)).otherwise(before + (last // size - 1)).cast("long").alias("sequence_id"),
        F.when(before == 0, F.col("a") % size).otherwise(F.col("a") - F.get(tail, before - 1)).cast("long").alias("offset"), "curve_key",
        *([F.col("own").alias("ids")] if keep_ids else []))
    return full.unionByName(rest_of)
