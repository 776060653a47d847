"""Removal of repeated word windows by Rabin-Karp hashes counted in Spark.

Documents are dealt into batches by ranges of their id.  Each batch hashes
every window of its texts and sends each distinct hash once, as sorted and
packed blocks, to the bucket its leading bits name; a bucket counts how many
batches hold a hash and tells all but the first.  A window that a hundred
million documents share thus arrives once per batch, never once per
document.  The texts meet the answers in the same batches (one exchange of
the texts serves both passes) and overlapping windows merge into maximal
intervals.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..operators.ordered import cut_points, sample_values
from .common import BASE, chunks, giving_back, hash_spans, mix, prefix_hashes, utf8, width, words_of


def window_hashes(words: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling polynomial hash of each window of word hashes, and its first word.

    The sums of a prefix array give each window in constant time; windows
    that would run over the end of their row are left out.
    """
    n = len(words)
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(n - window + 1, np.uint64)
    for k in range(window):  # Horner's rule, one vector operation per place
        value *= np.uint64(BASE)
        value += words[k:n - window + 1 + k]
    last = np.repeat(np.cumsum(counts), counts)
    first = np.flatnonzero(np.arange(n - window + 1) + window <= last[:n - window + 1])
    return mix(value[first]), first


def row_windows(data, offsets, window):
    """Word spans of all rows, words per row, and each window's hash and first word."""
    parts = []
    base_word = 0
    for lo, hi in chunks(offsets):
        part = data[offsets[lo]:offsets[hi]]
        starts, ends, counts = words_of(part, offsets[lo:hi + 1] - offsets[lo])
        h, first = window_hashes(hash_spans(prefix_hashes(part), starts, ends), counts, window)
        parts.append((starts + offsets[lo], ends + offsets[lo], counts, h, first + base_word))
        base_word += len(starts)
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64), z
    return tuple(np.concatenate(x) for x in zip(*parts))


def pack(values: np.ndarray) -> bytes:
    """Sorted distinct 64-bit values as differences of the fewest bytes that hold them."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=values[:1] - values[:1])
    first, steps = steps[0], steps[1:]
    size = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    body = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T  # by place: alike bytes lie together
    return bytes([size]) + int(first).to_bytes(8, "little") + np.ascontiguousarray(body).tobytes()


def unpack(block) -> np.ndarray:
    block = bytes(block)
    if not block:
        return np.zeros(0, np.uint64)
    size, first = block[0], int.from_bytes(block[1:9], "little")
    body = np.frombuffer(block, np.uint8, offset=9).reshape(size, -1)
    steps = np.zeros((body.shape[1] + 1, 8), np.uint8)
    steps[1:, :size] = body.T
    values = steps.view("<u8").ravel().astype(np.uint64)
    values[0] = first
    return np.cumsum(values, dtype=np.uint64)


def batches_by_id(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """``(batch, id, text)`` with batches of ascending id ranges; null ids come last."""
    n = 2 * width(docs.sparkSession)
    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    cuts = np.array(cut_points([r[0] for r in sample_values(ids, [F.col("id")], n)], n), np.int64)

    @pandas_udf("int")
    def batch_of(x: pd.Series) -> pd.Series:
        known = x.notna()
        out = np.full(len(x), len(cuts) + 1, np.int32)
        out[known.to_numpy()] = np.searchsorted(cuts, x[known].to_numpy(np.int64), side="left")
        return pd.Series(out)

    return ids.select(batch_of("id").alias("batch"), "id", "text"), n


def _ranks(table: pa.Table):
    """The batch's rows in ascending id order (null last) and their dense id ranks."""
    ids = table.column("id").to_pandas()
    known = ids.notna().to_numpy()
    value = np.where(known, ids.fillna(0).to_numpy(np.int64), np.iinfo(np.int64).max)
    order = np.lexsort((value, ~known))
    v, k = value[order], known[order]
    rank = np.cumsum(np.r_[True, (v[1:] != v[:-1]) | (k[1:] != k[:-1])]) if len(v) else np.zeros(0, np.int64)
    return order, rank


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """``(<id_col>, n_words, n_removed, removed, kept_text)``, one row per input row.

    A word is removed if a window of ``window`` consecutive words that
    covers it also starts in a document with a smaller id; windows are
    judged on the input.  ``removed`` holds the maximal removed runs as
    (first word, word after the last); ``kept_text`` the other words joined
    by one space.  Words are runs of other characters than ASCII white
    space.  Null and empty texts have no words.  Rows that share an id are
    one document (they never remove from each other); a null id counts as
    larger than every id.  Ids are integers.  Other columns are not read;
    an empty table gives an empty one.  Windows are told apart by 64-bit
    hashes.
    """
    batched, n = batches_by_id(docs, id_col, text_col)
    grouped = batched.groupBy("batch")

    def send(table: pa.Table) -> pa.Table:
        data, offsets = utf8(table.column("text"))
        hashes = [window_hashes_of(data, offsets, lo, hi, window) for lo, hi in chunks(offsets)]
        h = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        h.sort()
        if len(h):
            h = h[np.r_[True, h[1:] != h[:-1]]]
        edges = np.array([((k << 64) // n) for k in range(1, n)], np.uint64)
        cut = np.r_[0, np.searchsorted(h, edges), len(h)]
        full = np.flatnonzero(np.diff(cut))
        batch = table.column("batch")[0].as_py()
        return pa.table({"bucket": pa.array(full.astype(np.int32)), "batch": pa.array(np.full(len(full), batch, np.int32)),
                         "hashes": pa.array([pack(h[cut[k]:cut[k + 1]]) for k in full], pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        batches = table.column("batch").to_numpy()
        order = np.argsort(batches, kind="stable")
        blocks = table.column("hashes")
        runs = [unpack(blocks[int(k)].as_buffer()) for k in order]
        h = np.concatenate([*runs, np.zeros(0, np.uint64)])
        source = np.repeat(batches[order], [len(x) for x in runs])
        del runs
        by = np.argsort(h, kind="stable")
        again = np.zeros(len(h), bool)
        again[by[1:]] = h[by[1:]] == h[by[:-1]]
        del by
        h, source = h[again], source[again]
        heads = np.flatnonzero(np.r_[True, source[1:] != source[:-1]]) if len(source) else np.zeros(0, np.int64)
        ends = np.r_[heads[1:], len(source)] if len(heads) else heads
        return pa.table({"batch": pa.array(source[heads].astype(np.int32)),
                         "hashes": pa.array([pack(h[s:e]) for s, e in zip(heads, ends)], pa.binary())})

    def cut_out(texts: pa.Table, told: pa.Table) -> pa.Table:
        order, rank = _ranks(texts)
        texts = texts.take(pa.array(order))
        data, offsets = utf8(texts.column("text"))
        starts, ends, counts, h, first = row_windows(data, offsets, window)
        known = np.sort(np.concatenate([*(unpack(x.as_buffer()) for x in told.column("hashes")), np.zeros(0, np.uint64)]))
        dead = np.zeros(len(h), bool)
        if len(known):
            at = np.searchsorted(known, h)
            dead = known[np.minimum(at, len(known) - 1)] == h
        word_row = np.repeat(np.arange(len(counts)), counts)
        mine = rank[word_row[first]] if len(first) else first
        by = np.argsort(h, kind="stable")  # windows come in id order: the first of a run has the smallest id
        if len(by):
            run = np.cumsum(np.r_[False, h[by[1:]] != h[by[:-1]]])
            lead = mine[by[np.r_[0, np.flatnonzero(np.diff(run)) + 1]]]
            dead[by] |= mine[by] > lead[run]
        covered = np.zeros(len(starts) + 1, np.int64)
        np.add.at(covered, first[dead], 1)
        np.add.at(covered, first[dead] + window, -1)
        gone = np.cumsum(covered[:-1]) > 0
        return kept_rows(texts.column("id"), data, starts, ends, counts, gone)

    blocks = grouped.applyInArrow(giving_back(send), "bucket int, batch int, hashes binary")
    told = blocks.groupBy("bucket").applyInArrow(giving_back(count), "batch int, hashes binary")
    out = grouped.cogroup(told.groupBy("batch")).applyInArrow(
        giving_back(cut_out), "id long, n_words long, n_removed long, removed array<struct<first:long,last:long>>, kept_text string")
    return out.withColumnRenamed("id", id_col)


def window_hashes_of(data, offsets, lo, hi, window):
    part = data[offsets[lo]:offsets[hi]]
    starts, ends, counts = words_of(part, offsets[lo:hi + 1] - offsets[lo])
    return window_hashes(hash_spans(prefix_hashes(part), starts, ends), counts, window)[0]


def kept_rows(ids, data, starts, ends, counts, gone) -> pa.Table:
    """Result rows: word counts, maximal removed runs and the kept words of each row."""
    row = np.repeat(np.arange(len(counts)), counts)
    n_removed = np.bincount(row, gone, len(counts)).astype(np.int64)
    heads = np.cumsum(counts) - counts
    # runs of removed words, cut at row borders
    before = np.r_[False, gone[:-1] & (row[1:] == row[:-1])] if len(gone) else gone
    after = np.r_[gone[1:] & (row[1:] == row[:-1]), False] if len(gone) else gone
    run_first, run_last = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after)
    run_row = row[run_first]
    runs = pa.StructArray.from_arrays([pa.array(run_first - heads[run_row]), pa.array(run_last + 1 - heads[run_row])],
                                      ["first", "last"])
    list_at = np.r_[0, np.cumsum(np.bincount(run_row, minlength=len(counts)))].astype(np.int32)
    keep = np.flatnonzero(~gone)
    left = counts - n_removed
    sizes = ends[keep] - starts[keep]
    last_of_row = np.zeros(len(keep), bool)
    last_of_row[(np.cumsum(left) - 1)[left > 0]] = True
    stop = np.cumsum(sizes + ~last_of_row)  # a space after each word but the last of its row
    begin = stop - sizes - ~last_of_row
    total = int(stop[-1]) if len(stop) else 0
    marks = np.zeros(len(data) + 1, np.int8)
    marks[starts[keep]] += 1
    marks[ends[keep]] -= 1
    text = np.full(total, 32, np.uint8)
    inside = np.zeros(total + 1, np.int8)
    inside[begin] += 1
    inside[begin + sizes] -= 1
    text[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)] = data[np.cumsum(marks[:-1], dtype=np.int8).astype(bool)]
    at = np.r_[0, stop][np.r_[0, np.cumsum(left)]].astype(np.int32)
    kept = pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(text.tobytes())])
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    return pa.table({"id": ids, "n_words": pa.array(counts.astype(np.int64)), "n_removed": pa.array(n_removed),
                     "removed": pa.ListArray.from_arrays(pa.array(list_at), runs), "kept_text": kept})
