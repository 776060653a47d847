"""SimHash near-duplicates found through Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments.  Two fingerprints that
differ in at most two bits agree on at least one segment (pigeonhole), and
every other segment then differs in at most two bits.  The perfect binary
Golay code of length 23 maps a segment to a codeword index; the indices of
the segment and of its one-bit neighbours are its key set, and two segments
at distance two or less always share a key (the word between them is a
neighbour of both).  A join key is therefore one exact segment plus one
Golay index of the next segment: candidates that can be verified cheaply.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fresh, giving_back, utf8, words_of, worker_cache, written
from .graph import components
from .xxh import xxh64_slices

SEED = 42
#: Lowest bit and number of bits of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1 of the binary Golay code of length 23.
GOLAY = 0b110001110101
MAX_BITS = 2
#: A candidate bucket up to this size is compared inside one task; larger ones take the neighbour join.
SMALL_BUCKET = 64


# ---------------------------------------------------------------- fingerprints

def _lower_ascii(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return data + (upper.astype(np.uint8) << 5)


#: For each byte value its eight bits, most significant first, as eight byte-wide counters.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64).ravel()


def count_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in each run of ``sizes`` hashes (no empty run)."""
    counters = LANES[hashes.astype(">u8").view(np.uint8).reshape(-1, 8)]
    pieces = -(-sizes // 255)  # a byte counter holds up to 255
    last = np.cumsum(pieces)
    rank = np.arange(last[-1]) - np.repeat(last - pieces, pieces)
    heads = np.repeat(np.cumsum(sizes) - sizes, pieces) + 255 * rank
    sums = np.add.reduceat(counters, heads, axis=0).view(np.uint8).reshape(-1, 64)
    return np.add.reduceat(sums, last - pieces, axis=0, dtype=np.int64)


def simhash_rows(data: np.ndarray, offsets: np.ndarray, ngram: int) -> np.ndarray:
    """Fingerprint of each row of a string column given as bytes and offsets."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    for lo, hi in chunks(offsets):
        part = _lower_ascii(data[offsets[lo]:offsets[hi]])
        at = offsets[lo:hi + 1] - offsets[lo]
        starts, ends, counts = words_of(part, at)
        if not len(starts):
            continue
        # one space between words: shingles are then slices of this text
        sizes = ends - starts
        new_ends = np.cumsum(sizes + 1) - 1
        new_starts = new_ends - sizes
        text = np.full(int(new_ends[-1]) + 1, 32, np.uint8)
        inside = np.zeros(len(part) + 1, np.int8)
        inside[starts] += 1
        inside[ends] -= 1
        kept = part[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
        spaces = np.zeros(len(text), bool)
        spaces[new_ends] = True
        text[~spaces] = kept
        last = np.cumsum(counts)
        first = last - counts
        grams = np.where(counts == 0, 0, np.maximum(counts - ngram + 1, 1))
        total = np.cumsum(grams)
        rank = np.arange(total[-1]) - np.repeat(total - grams, grams)
        begin = np.repeat(first, grams) + rank
        end = np.minimum(begin + ngram, np.repeat(last, grams)) - 1
        hashes = xxh64_slices(text, new_starts[begin], new_ends[end], SEED)
        rows = np.flatnonzero(grams)
        ones = count_bits(hashes, grams[rows])
        set_bits = (2 * ones > grams[rows][:, None]).astype(np.uint8)
        out[lo + rows] = np.packbits(set_bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3) -> DataFrame:
    """``(id, fp, text_key)`` per row; no word gives fingerprint zero, fewer than ``ngram`` words one shingle."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                         F.xxhash64(text_col).alias("text_key"))

    def run(batches):
        for b in batches:
            fp = simhash_rows(*utf8(b.column("text")), ngram)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp.view(np.int64)), b.column("text_key")],
                                             ["id", "fp", "text_key"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(giving_back(run), f"id {kind}, fp long, text_key long")


# ---------------------------------------------------------------- Golay keys

def golay_index() -> np.ndarray:
    """Index (its 12 data bits) of the one codeword within three bits of each 23-bit word."""
    cache = worker_cache("golay")
    if "index" not in cache:
        data = np.arange(4096, dtype=np.int64)
        code = np.zeros(4096, np.int64)
        for k in range(12):
            code ^= np.where(data >> k & 1, GOLAY << k, 0)
        table = np.zeros(1 << 23, np.int16)
        one = [1 << i for i in range(23)]
        errors = [0, *one, *(a | b for i, a in enumerate(one) for b in one[:i]),
                  *(a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j])]
        for e in errors:
            table[code ^ e] = data
        cache["index"] = table
    return cache["index"]


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All join keys of each fingerprint: positions in ``fp`` and keys."""
    table = golay_index()
    at, keys = [], []
    parts = [(fp >> np.uint64(low) & np.uint64((1 << n) - 1)).astype(np.int64) for low, n in SEGMENTS]
    flips = np.array([0] + [1 << i for i in range(23)], np.int64)
    for i, exact in enumerate(parts):
        near = np.sort(table[parts[(i + 1) % 3][:, None] ^ flips].astype(np.int64), axis=1)
        new = np.ones(near.shape, bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        row, col = np.nonzero(new)
        at.append(row)
        keys.append((i << 40) | (exact[row] << 12) | near[row, col])
    return np.concatenate(at), np.concatenate(keys)


def _bucket_links(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges that connect what is linked inside one small bucket."""
    value = fps.view(np.uint64)
    far = np.bitwise_count(value[:, None] ^ value[None, :])
    a, b = np.nonzero(np.triu(far <= max_bits, 1))
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[q] = p
            out.append((int(fps[x]), int(fps[y])))
    return out


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all pairs at ``max_bits`` or less.

    ``fps`` holds distinct fingerprints (``fp``).  A bucket of up to
    SMALL_BUCKET fingerprints is compared in one task and gives a spanning
    forest.  Fingerprints of larger buckets are joined on their one-bit
    neighbours instead: two of them differ in two bits or less exactly when
    they share such a word, and no word has more than 65 neighbours, so the
    work stays linear however large the bucket is.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the Golay keys find pairs of at most two differing bits")

    def key_rows(batches):
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            at, keys = golay_keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[at])], ["key", "fp"])

    keys = fps.select("fp").mapInArrow(giving_back(key_rows), "key long, fp long")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sized = written(keys.join(sizes, "key"), "golay_keys")

    def compare(batches):
        for b in batches:
            flat, offsets = b.column("fps").flatten().to_numpy(zero_copy_only=False), b.column("fps").offsets.to_numpy()
            offsets = offsets - offsets[0]
            found = [e for s, t in zip(offsets[:-1], offsets[1:]) for e in _bucket_links(flat[s:t], max_bits)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()),
                                              pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    small = sized.where(f"n <= {SMALL_BUCKET}").groupBy("key").agg(F.collect_list("fp").alias("fps")) \
        .select("fps").mapInArrow(giving_back(compare), "a long, b long")

    def around(batches):
        flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            word = (fp.view(np.uint64)[:, None] ^ flips).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word.ravel()), pa.array(np.repeat(fp, 65))], ["word", "fp"])

    crowded = sized.where(f"n > {SMALL_BUCKET}").select("fp").distinct().mapInArrow(giving_back(around), "word long, fp long") \
        .groupBy("word").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1").select("fps") \
        .mapInArrow(giving_back(compare), "a long, b long")
    return small.union(crowded)


# ---------------------------------------------------------------- operator

def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """``(<id_col>, fingerprint, component_id, text_key, root)``, one row per input row.

    ``root`` is the smallest fingerprint of the component, which tells
    components with one ``component_id`` apart.  ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the
    smallest id whose fingerprint can be reached over links of at most
    ``max_bits`` differing bits.  Null and wordless texts have fingerprint
    zero and are linked like any other.  Rows with a null id are linked too
    but never name a component unless all its ids are null (then null).
    Repeated rows and ids each keep their row; an empty table gives an empty
    one; other columns are not read.
    """
    prints = written(fingerprints(docs, id_col, text_col, ngram), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct_fp")
    roots = components(links(distinct, max_bits))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left") \
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    label = named.join(groups, "root").select("fp", "component_id", "root")
    return prints.join(label, "fp").select(F.col("id").alias(id_col),
                                           F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                                           "component_id", "text_key", "root")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3,
               max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` with one row left of each group of near-duplicates.

    The row with the smallest id stays (of several with that id the one
    with the smallest text key; of equal rows one).  Groups are told apart
    by their root, as different ones may share a smallest id or have none.
    """
    found = near_duplicates(docs, id_col, text_col, ngram, max_bits)
    missing = F.col(id_col).isNull()
    best = found.groupBy("root").agg(F.min(F.struct(missing.alias("none"), F.col(id_col).alias("id"), "text_key")).alias("w"))
    # an id is compared by its text so that a null id finds itself
    id_key, text_key = fresh(docs, "_id", "_key")
    named = best.select(F.coalesce(F.col("w.id").cast("string"), F.lit("")).alias(id_key), F.col("w.text_key").alias(text_key))
    left = docs.withColumn(id_key, F.coalesce(F.col(id_col).cast("string"), F.lit(""))).withColumn(text_key, F.xxhash64(text_col))
    return left.join(named.distinct(), [id_key, text_key], "left_semi").dropDuplicates([id_key, text_key]).select(*docs.columns)
