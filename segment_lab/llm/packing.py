"""Best-fit packing of token pieces by exact-complement hashing over length counts.

Where a piece goes depends only on its length, so the plan is made from the
histogram of lengths (at most ``size`` numbers whatever the corpus): fill
each gap exactly with one, two or three available lengths, then best-fit
what is left.  The plan is a list of patterns with repeat counts; a piece
finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, giving_back, utf8, width, worker_cache, written
from .word_tokens import TABLE_BITS, IdTable, WordTokenizer, word_level

#: Words a worker remembers at most: half the slots of its table.
REMEMBERED_WORDS = 1 << (TABLE_BITS - 1)


# ---------------------------------------------------------------- tokens

def _tokenizer(path: str) -> WordTokenizer:
    cache = worker_cache("packing")
    if (path, REMEMBERED_WORDS) not in cache:
        cache[path, REMEMBERED_WORDS] = word_level(path)
        cache[path, REMEMBERED_WORDS].table = IdTable((2 * REMEMBERED_WORDS).bit_length() - 1)
    return cache[path, REMEMBERED_WORDS]


def token_bytes(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text, four bytes each."""
    data, offsets = utf8(pa.array(texts, pa.string()))
    ids, at = _tokenizer(path).encode(data[offsets[0]:offsets[-1]], offsets - offsets[0])
    every, at = ids.astype("<u4").tobytes(), (4 * at).tolist()
    return [every[lo:hi] for lo, hi in zip(at, at[1:])]


def token_pieces(docs: DataFrame, path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """``(<id_col>, piece, start, length, ids_crc32[, ids])``: every document cut into pieces of ``size`` tokens."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        for b in batches:
            ids = b.column("id")
            data, offsets = utf8(b.column("text"))
            for lo, hi in chunks(offsets):
                row, piece, start, length, crc, body = [], [], [], [], [], []
                found, at = _tokenizer(path).encode(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                every, at = found.astype("<u4").tobytes(), at.tolist()
                for k in range(lo, hi):
                    raw = every[4 * at[k - lo]:4 * at[k - lo + 1]] + end
                    for p, s in enumerate(range(0, len(raw), 4 * size)):
                        part = raw[s:s + 4 * size]
                        row.append(k)
                        piece.append(p)
                        start.append(s // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            body.append(part)
                cols = [ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols, names = [*cols, pa.array(body, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = source.schema["id"].dataType.simpleString()
    more = ", ids binary" if keep_ids else ""
    return source.mapInArrow(giving_back(run), f"id {kind}, piece int, start long, length long, ids_crc32 long{more}") \
        .withColumnRenamed("id", id_col)


# ---------------------------------------------------------------- plan

class LengthSums:
    """Index of single, pair and triple sums of the lengths still available.

    A sum leads to the pairs (by their larger length) and the triples (by one
    length, the other two being a pair of what is left) that make it, the
    largest length first.  Counts only fall, so an entry that lacks pieces
    is dropped when it is met; a sum's entries are made when it is first
    asked for.
    """

    def __init__(self, count: list[int]):
        self.count, self.held = count, [0] * len(count)
        self.pairs: dict[int, list[int]] = {}
        self.triples: dict[int, list[int]] = {}

    def _available(self, least: int, most: int, total: int | None = None) -> list[int]:
        """Ascending lengths in a range that have pieces (and what they lack to ``total`` too)."""
        return [x for x in range(least, most + 1) if self.count[x] and (total is None or self.count[total - x])]

    def _free(self, x: int) -> int:
        return self.count[x] - self.held[x]

    def pair(self, total: int) -> tuple[int, int] | None:
        if total not in self.pairs:
            self.pairs[total] = self._available((total + 1) // 2, total - 1, total)
        entries = self.pairs[total]
        for at in range(len(entries) - 1, -1, -1):
            b, c = entries[at], total - entries[at]
            need = 2 if b == c else 1
            if min(self.count[b], self.count[c]) < need:
                del entries[at]
            elif min(self._free(b), self._free(c)) >= need:
                return b, c
        return None

    def triple(self, total: int) -> tuple[int, int, int] | None:
        if total not in self.triples:
            self.triples[total] = self._available((total + 2) // 3, total - 2)
        entries = self.triples[total]
        for at in range(len(entries) - 1, -1, -1):
            a = entries[at]
            if self._free(a) > 0:
                self.held[a] += 1
                rest = self.pair(total - a)
                self.held[a] -= 1
                if rest:
                    return a, *rest
            if not self.count[a] or total - a in self.pairs and not self.pairs[total - a]:
                del entries[at]
        return None

    def complement(self, piece: int, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill the gap beside a piece exactly."""
        self.held[piece] += 1  # what is beside it cannot be the piece itself
        found = (gap,) if self._free(gap) > 0 else self.pair(gap) or self.triple(gap)
        self.held[piece] -= 1
        return found


def plan_patterns(histogram: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ``({length: times in a sequence}, sequences)`` that use up the histogram."""
    count = [0] * (size + 1)
    for length, n in histogram.items():
        count[length] = n
    plan, sums = [], LengthSums(count)

    def use(lengths, times):
        pattern = {}
        for x in lengths:
            pattern[x] = pattern.get(x, 0) + 1
        times = times or min(count[x] // k for x, k in pattern.items())
        for x, k in pattern.items():
            count[x] -= k * times
        plan.append((pattern, times))

    if count[size]:
        use([size], None)
    for a in range(size - 1, 0, -1):
        while count[a] and (fill := sums.complement(a, size - a)):
            use([a, *fill], None)
    # best fit for the rest, longest first; open sequences are grouped by the gap they have left
    groups: dict[int, list[tuple[dict[int, int], int]]] = {}
    for a in range(size - 1, 0, -1):
        while left := count[a]:
            gap = min((g for g in groups if g >= a), default=None)
            if gap is None:
                each = size // a
                full, rest = divmod(left, each)
                for k, times in ((each, full), (rest, 1)):
                    if k and times:
                        groups.setdefault(size - k * a, []).append(({a: k}, times))
                count[a] = 0
                continue
            pattern, times = groups[gap].pop()
            if not groups[gap]:
                del groups[gap]
            used = min(times, left)
            if used < times:
                groups.setdefault(gap, []).append((pattern, times - used))
            groups.setdefault(gap - a, []).append(({**pattern, a: pattern.get(a, 0) + 1}, used))
            count[a] -= used
    return plan + [entry for g in sorted(groups) for entry in groups[g]]


def places(plan: list[tuple[dict[int, int], int]], size: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length the rank ranges of its pieces: first rank, first sequence, times in a sequence, offset."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    used = [0] * (size + 1)
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for length in sorted(pattern, reverse=True):
            each = pattern[length]
            found.setdefault(length, []).append((used[length], sequence, each, offset))
            used[length] += each * times
            offset += each * length
        sequence += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in found.items()}


# ---------------------------------------------------------------- operator

def pack(pieces: DataFrame, size: int, order_cols: list[str], length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; lengths are 1 to ``size``.

    The rank of a piece among those of its length is the number of such
    pieces in lower hash buckets plus its place in its own bucket, so a
    length that a third of all pieces have is spread over all buckets.
    Repeated rows are packed one by one; an empty table gives an empty one.
    """
    histogram = {r[0]: r[1] for r in pieces.groupBy(length_col).agg(F.count("*")).collect()}  # at most ``size`` rows
    where = places(plan_patterns(histogram, size), size)
    buckets = width(pieces.sparkSession)
    dealt = pieces.withColumn("_bucket", F.expr(f"cast(pmod(xxhash64({', '.join(f'`{c}`' for c in order_cols)}), {buckets}) as int)"))
    base = dealt.groupBy(F.col(length_col).alias("_l"), F.col("_bucket").alias("_b")).agg(F.count("*").alias("n")) \
        .withColumn("_base", F.sum("n").over(Window.partitionBy("_l").orderBy("_b")) - F.col("n")).drop("n")
    own = Window.partitionBy(length_col, "_bucket").orderBy(*order_cols)
    ranked = dealt.withColumn("_rank", F.row_number().over(own) - 1) \
        .join(base, (F.col(length_col) == F.col("_l")) & (F.col("_bucket") == F.col("_b"))) \
        .select(*pieces.columns, (F.col("_rank") + F.col("_base")).cast("long").alias("_rank"))

    def place(batches):
        for b in batches:
            length = b.column(length_col).to_numpy(zero_copy_only=False)
            rank = b.column("_rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cut = np.flatnonzero(np.diff(length[order])) + 1
            for at in np.split(order, cut):
                if len(at):
                    n = int(length[at[0]])
                    first, begin, each, start = where[n]
                    k = np.searchsorted(first, rank[at], side="right") - 1
                    inside = rank[at] - first[k]
                    sequence[at] = begin[k] + inside // each[k]
                    offset[at] = start[k] + inside % each[k] * n
            keep = [c for c in b.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sequence), pa.array(offset)],
                                             [*keep, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text",
                   keep_ids: bool = False) -> DataFrame:
    """Tokenise and pack whole documents: one row per piece with its sequence and its place there.

    Null and empty texts are the end id alone.  Only documents longer than
    ``size`` tokens are cut.  Rows with repeated or null ids are packed one
    by one.  With ``keep_ids`` a row also holds its ids (little-endian
    unsigned 32-bit).  Other columns are not read.
    """
    pieces = written(token_pieces(docs, path, size, id_col, text_col, keep_ids=keep_ids), "pieces")
    return pack(pieces, size, [id_col, "piece"])
