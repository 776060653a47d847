"""Removal of repeated byte strings by suffix sorting the places where they can occur.

Every ``length``-byte window of a text has one anchor: the token start with
the smallest hash of the MARGIN bytes before and after it, among those at
least MARGIN bytes inside the window.  Equal windows have equal anchors, so
only windows whose anchor hash occurs twice are compared, and only with
windows of the same anchor hash.  Consecutive windows with one anchor form a
context.  The distinct contexts of an anchor are suffix sorted by linear
grouping and windows with a common prefix of ``length`` bytes marked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SEPARATOR, chunks, giving_back, hash_spans, mix, prefix_hashes, utf8, width
from .suffix_groups import suffix_order
from .substrings import pack, unpack

MARGIN = 32
#: A run of this many bytes without a separator is followed by one-byte tokens.
LONG_WORD = 32


def token_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places after a separator, and after LONG_WORD other bytes, inside each row."""
    stops = np.flatnonzero(IS_SEPARATOR[data])
    heads = offsets[:-1][np.diff(offsets) > 0]
    begin = np.concatenate([heads, stops + 1])  # where a word may begin
    begin.sort(kind="stable")
    begin = begin[np.r_[True, begin[1:] != begin[:-1]]] if len(begin) else begin
    size = np.diff(np.r_[begin, len(data) + 1]) - 1  # up to the separator or the next row
    long = np.flatnonzero(size >= LONG_WORD)
    inner = np.zeros(0, np.int64)
    if len(long):
        more = size[long] - LONG_WORD + 1
        inner = np.repeat(begin[long] + LONG_WORD, more) + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
    out = np.concatenate([stops + 1, inner])
    out.sort(kind="stable")
    out = out[np.r_[True, out[1:] != out[:-1]]] if len(out) else out
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a row's own start is no token start: what stood before it is not known
    return out[~first[out]]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, margin: int):
    """``(hash, anchor, first, last)``: the contexts of all rows, as ranges of window starts."""
    empty = np.zeros(0, np.int64)
    rows = np.flatnonzero(np.diff(offsets) >= length)
    if not len(rows):
        return np.zeros(0, np.uint64), empty, empty, empty, None
    prefix = prefix_hashes(data)
    low, high = offsets[rows], offsets[rows + 1]
    q = token_starts(data, offsets)
    row = np.searchsorted(offsets, q, side="right") - 1
    q = q[(q - margin >= offsets[row]) & (q + margin <= offsets[row + 1])]
    h = hash_spans(prefix, q - margin, q + margin)
    # places where the range of candidates changes
    events = np.concatenate([q - (length - margin), q - margin + 1, low])
    events.sort(kind="stable")  # three ascending runs
    events = events[np.r_[True, events[1:] != events[:-1]]]
    r = np.searchsorted(low, events, side="right") - 1
    ok = (r >= 0) & (events <= high[np.maximum(r, 0)] - length)
    events, r = events[ok], r[ok]
    i = np.searchsorted(q, events + margin)
    j = np.searchsorted(q, events + length - margin, side="right")
    # leftmost smallest hash of q[i:j] from minima over power-of-two runs
    best = np.zeros(len(events), np.int64)
    level, table = 0, np.arange(len(q))
    size = j - i
    while True:
        here = (size >> level) == 1
        a, b = table[i[here]], table[j[here] - (1 << level)]
        best[here] = np.where(h[a] <= h[b], a, b)
        if not (size >> (level + 1)).any():
            break
        a, b = table[:-(1 << level)], table[1 << level:]
        table = np.where(h[a] <= h[b], a, b)
        level += 1
    new = np.r_[True, (best[1:] != best[:-1]) | (r[1:] != r[:-1])]
    first = events[new]
    last = np.r_[first[1:] - 1, 0]
    end = high[r[new]] - length
    last = np.minimum(np.where(np.r_[r[new][1:] != r[new][:-1], True], end, last), end)
    k = best[new]
    # chosen hashes are small ones: spread them again before they name buckets
    return mix(h[k] + np.uint64(1)), q[k], first, last, prefix


# ---------------------------------------------------------------- inside one task

def _common(data: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at ``a`` and ``b`` share, up to ``limit``."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))
    shared = np.zeros(len(a), np.int64)
    live = np.flatnonzero(limit > 0)
    while len(live):
        at = shared[live]
        x, y = np.minimum(a[live] + at, len(data)), np.minimum(b[live] + at, len(data))
        diff = eight[x] ^ eight[y]
        low = diff & (~diff + np.uint64(1))  # lowest differing bit
        equal = np.where(diff == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64)
        shared[live] = np.minimum(at + equal, limit[live])
        live = live[(equal == 8) & (at + 8 < limit[live])]
    return shared


def repeated_windows(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``(place, repeated)`` of every ``length``-byte window inside the rows: does it occur at another place too?

    The rows are split into words (each with the separator that ends it) and
    the suffixes that begin with a word are sorted.  The window at p first
    meets a word start d bytes on, at s: it is repeated if another window is
    also d bytes before a word start whose suffix shares ``length - d``
    bytes with that of s, with the same d bytes before.
    """
    n = len(data)
    rows = np.diff(offsets)
    inner = token_starts(data, offsets)
    tokens = np.concatenate([offsets[:-1][rows > 0], inner])
    tokens.sort(kind="stable")
    token_end = np.r_[tokens[1:], n]
    # symbols: words in byte order from 1, and 0 at the end of each row
    prefix = prefix_hashes(data)
    h = hash_spans(prefix, tokens, token_end)
    _, index, inverse = np.unique(h, return_index=True, return_inverse=True)
    raw = data.tobytes()
    words = [raw[s:e] for s, e in zip(tokens[index].tolist(), token_end[index].tolist())]
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(1, len(words) + 1)
    row = np.searchsorted(offsets, tokens, side="right") - 1
    symbols = np.zeros(len(tokens) + len(offsets) - 1, np.int64)
    spot = np.arange(len(tokens)) + row
    symbols[spot] = rank[inverse]
    place = np.full(len(symbols), -1, np.int64)
    place[spot] = tokens
    order = place[suffix_order(symbols)]
    order = order[order >= 0]
    rest = offsets[1:][np.searchsorted(offsets, order, side="right") - 1] - order
    shared = np.r_[0, _common(data, order[:-1], order[1:], np.minimum(length, np.minimum(rest[:-1], rest[1:])))]
    where = np.full(n + 1, -1, np.int64)
    where[order] = np.arange(len(order))

    fit = rows >= length
    count = rows[fit] - length + 1
    p = np.repeat(offsets[:-1][fit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    stops = np.r_[np.flatnonzero(IS_SEPARATOR[data]), n + LONG_WORD]
    s = np.minimum(stops[np.searchsorted(stops, p)] + 1, p + LONG_WORD)
    d = s - p
    key = np.empty(len(p), np.uint64)
    before = hash_spans(prefix, p, s)
    for k in range(1, LONG_WORD + 1):
        mine = np.flatnonzero(d == k)
        if len(mine):
            run = np.cumsum(shared < length - k)
            key[mine] = (run[where[s[mine]]] * (LONG_WORD + 1) + k).astype(np.uint64)
    key = mix(mix(key) + before)
    by = np.argsort(key, kind="stable")
    same = key[by[1:]] == key[by[:-1]]
    repeated = np.zeros(len(p), bool)
    repeated[by[1:]] |= same
    repeated[by[:-1]] |= same
    return p, repeated


def _runs(flags: np.ndarray, offsets: np.ndarray):
    """Maximal runs of set flags inside the rows: row, first place and last place."""
    inner = offsets[1:-1][offsets[1:-1] < len(flags)] if len(offsets) > 2 else offsets[:0]
    open_before = np.zeros(len(flags), bool)
    open_before[1:] = flags[:-1]
    open_before[inner] = False
    first = np.flatnonzero(flags & ~open_before)
    del open_before
    open_after = np.zeros(len(flags), bool)
    open_after[:-1] = flags[1:]
    open_after[inner[inner > 0] - 1] = False
    last = np.flatnonzero(flags & ~open_after)
    return np.searchsorted(offsets, first, side="right") - 1, first, last


# ---------------------------------------------------------------- messages between batches and buckets

#: Contexts of one anchor hash that a task compares; beyond, its windows are counted by hash instead.
CROWD = 50_000
#: Bytes of contexts that are suffix sorted together.
SORT_BYTES = 1 << 20
MESSAGE = "bucket int, batch int, kind int, hashes binary, more binary, sizes binary, body binary"
ANCHORS, CONTEXTS, WINDOWS, CROWDED = 0, 1, 2, 3
KINDS = {"bucket": pa.int32(), "batch": pa.int32(), "kind": pa.int32(), "hashes": pa.binary(), "more": pa.binary(),
         "sizes": pa.binary(), "body": pa.binary()}


def _table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[] for _ in KINDS]
    return pa.table({name: pa.array(list(c), kind) for (name, kind), c in zip(KINDS.items(), cols)})


def _by_bucket(h: np.ndarray, n: int):
    """Parts of an ascending hash array that fall into each of ``n`` buckets."""
    edges = np.array([((k << 64) // n) for k in range(1, n)], np.uint64)
    cut = np.r_[0, np.searchsorted(h, edges), len(h)]
    return [(k, slice(cut[k], cut[k + 1])) for k in np.flatnonzero(np.diff(cut)).tolist()]


def _buffers(column):
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]


class Scan:
    """The contexts of one batch of texts, found piece by piece."""

    def __init__(self, column, length: int, margin: int):
        self.data, self.offsets = utf8(column)
        self.length, self.margin = length, margin

    def __iter__(self):
        for lo, hi in chunks(self.offsets):
            start = self.offsets[lo]
            part = self.data[start:self.offsets[hi]]
            h, _, first, last, prefix = anchors(part, self.offsets[lo:hi + 1] - start, self.length, self.margin)
            if len(h):
                yield start, part, prefix, h, first, last


def _distinct(h: np.ndarray, c: np.ndarray):
    """Distinct (h, c) pairs in ascending order: their first index and count."""
    by = np.lexsort((c, h))
    new = np.r_[True, (h[by[1:]] != h[by[:-1]]) | (c[by[1:]] != c[by[:-1]])] if len(by) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    return by[heads], np.diff(np.r_[heads, len(by)])


def send_anchors(column, batch: int, n: int, length: int, margin: int) -> list[tuple]:
    """Each distinct anchor hash once, with its contexts in the batch (all, and distinct ones)."""
    pairs = [(h, hash_spans(prefix, first, last + length)) for _, _, prefix, h, first, last in Scan(column, length, margin)]
    if not pairs:
        return []
    h, c = (np.concatenate(x) for x in zip(*pairs))
    at, times = _distinct(h, c)
    h = h[at]
    heads = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    total, kinds = np.add.reduceat(times, heads), np.diff(np.r_[heads, len(h)])
    h = h[heads]
    return [(k, batch, ANCHORS, pack(h[s]), (total[s] > 1).astype(np.uint8).tobytes(), kinds[s].astype("<u4").tobytes(), b"")
            for k, s in _by_bucket(h, n)]


def count_anchors(table: pa.Table) -> list[tuple]:
    """Tells each batch which of its anchor hashes occur again, here or elsewhere, and which are crowded."""
    batches = table.column("batch").to_pylist()
    parts = [unpack(x) for x in _buffers(table.column("hashes"))]
    many = np.concatenate([np.frombuffer(x, np.uint8) for x in _buffers(table.column("more"))])
    kinds = np.concatenate([np.frombuffer(x, "<u4") for x in _buffers(table.column("sizes"))]).astype(np.int64)
    h = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    by = np.argsort(h, kind="stable")
    heads = np.flatnonzero(np.r_[True, h[by[1:]] != h[by[:-1]]])
    sizes = np.diff(np.r_[heads, len(h)])
    again, crowd = np.empty(len(h), bool), np.empty(len(h), bool)
    again[by] = np.repeat((sizes > 1) | (np.add.reduceat(many[by].astype(np.int64), heads) > 0), sizes)
    crowd[by] = np.repeat(np.add.reduceat(kinds[by], heads) > CROWD, sizes)
    out = []
    for k, b in enumerate(batches):
        mine = owner == k
        for kind, flags in ((ANCHORS, again & ~crowd & mine), (CROWDED, again & crowd & mine)):
            if flags.any():
                out.append((-1, b, kind, pack(h[flags]), b"", b"", b""))
    return out


def _known(table: pa.Table, kind: int) -> np.ndarray:
    found = [unpack(x) for x, k in zip(_buffers(table.column("hashes")), table.column("kind").to_pylist()) if k == kind]
    return np.sort(np.concatenate([*found, np.zeros(0, np.uint64)]))


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _spread(first: np.ndarray, last: np.ndarray):
    """All values of the ranges first..last and the range each belongs to."""
    count = last - first + 1
    owner = np.repeat(np.arange(len(first)), count)
    return np.repeat(first, count) + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count), owner


def send_contexts(column, told: pa.Table, batch: int, n: int, length: int, margin: int) -> list[tuple]:
    """The batch's distinct contexts of repeated anchors, and window hashes of crowded ones."""
    again, crowd = _known(told, ANCHORS), _known(told, CROWDED)
    hs, cs, counts, bodies, windows = [], [], [], [], []
    for _, part, prefix, h, first, last in Scan(column, length, margin):
        mine = np.flatnonzero(_among(h, again))
        if len(mine):
            raw, ids = part.tobytes(), hash_spans(prefix, first[mine], last[mine] + length)
            keep, times = _distinct(h[mine], ids)
            hs.append(h[mine][keep])
            cs.append(ids[keep])
            counts.append(times)
            bodies += [raw[a:b] for a, b in zip(first[mine][keep].tolist(), (last[mine][keep] + length).tolist())]
        theirs = np.flatnonzero(_among(h, crowd))
        if len(theirs):
            p, _ = _spread(first[theirs], last[theirs])
            windows.append(hash_spans(prefix, p, p + length))
    out = []
    if hs:
        h, c, times = np.concatenate(hs), np.concatenate(cs), np.concatenate(counts)
        by = np.lexsort((c, h))
        heads = np.flatnonzero(np.r_[True, (h[by[1:]] != h[by[:-1]]) | (c[by[1:]] != c[by[:-1]])])
        at, times = by[heads], np.add.reduceat(times[by], heads)
        h, c, text = h[at], c[at], [bodies[k] for k in at.tolist()]
        for k, s in _by_bucket(h, n):
            rows = text[s]
            out.append((k, batch, CONTEXTS, h[s].astype("<u8").tobytes(),
                        c[s].astype("<u8").tobytes() + (times[s] > 1).astype(np.uint8).tobytes(),
                        np.fromiter(map(len, rows), "<u4", len(rows)).tobytes(), b"".join(rows)))
    if windows:
        w = np.sort(np.concatenate(windows))
        heads = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        times, w = np.diff(np.r_[heads, len(w)]), w[heads]
        out += [(k, batch, WINDOWS, pack(w[s]), (times[s] > 1).astype(np.uint8).tobytes(), b"", b"") for k, s in _by_bucket(w, n)]
    return out


def resolve(table: pa.Table, length: int) -> list[tuple]:
    """Tells each batch the repeated window ranges of its contexts, and its repeated window hashes."""
    kinds = table.column("kind").to_numpy()
    out = []
    some = table.filter(pa.array(kinds == WINDOWS))
    if some.num_rows:
        parts = [unpack(x) for x in _buffers(some.column("hashes"))]
        many = np.concatenate([np.frombuffer(x, np.uint8) for x in _buffers(some.column("more"))])
        h = np.concatenate(parts)
        by = np.argsort(h, kind="stable")
        heads = np.flatnonzero(np.r_[True, h[by[1:]] != h[by[:-1]]])
        sizes = np.diff(np.r_[heads, len(h)])
        again = np.empty(len(h), bool)
        again[by] = np.repeat((sizes > 1) | (np.add.reduceat(many[by].astype(np.int64), heads) > 0), sizes)
        ends = np.cumsum([len(x) for x in parts])
        for b, x, e in zip(some.column("batch").to_pylist(), parts, ends.tolist()):
            if (mine := again[e - len(x):e]).any():
                out.append((-1, b, WINDOWS, pack(x[mine]), b"", b"", b""))
    some = table.filter(pa.array(kinds == CONTEXTS))
    if not some.num_rows:
        return out
    hs = [np.frombuffer(x, "<u8").astype(np.uint64) for x in _buffers(some.column("hashes"))]
    rest = _buffers(some.column("more"))
    h = np.concatenate(hs)
    c = np.concatenate([np.frombuffer(x, "<u8", len(k)).astype(np.uint64) for x, k in zip(rest, hs)])
    many = np.concatenate([np.frombuffer(x, np.uint8, offset=8 * len(k)) for x, k in zip(rest, hs)])
    sizes = np.concatenate([np.frombuffer(x, "<u4") for x in _buffers(some.column("sizes"))]).astype(np.int64)
    data = np.frombuffer(b"".join(_buffers(some.column("body"))), np.uint8)
    start = np.cumsum(sizes) - sizes
    by = np.lexsort((c, h))
    new = np.r_[True, (h[by[1:]] != h[by[:-1]]) | (c[by[1:]] != c[by[:-1]])]
    heads = np.flatnonzero(new)
    copies = np.diff(np.r_[heads, len(by)])
    everywhere = (copies > 1) | (np.add.reduceat(many[by].astype(np.int64), heads) > 0)
    one = by[heads]  # a copy of each distinct context, in order of anchor hash
    group_heads = np.flatnonzero(np.r_[True, h[one][1:] != h[one][:-1]])
    group_sizes = np.diff(np.r_[group_heads, len(one)])
    group = np.repeat(np.arange(len(group_heads)), group_sizes)
    # only anchors with several contexts, one of them not yet known to be repeated, need sorting
    open_group = (group_sizes > 1) & (np.add.reduceat((~everywhere).astype(np.int64), group_heads) > 0)
    found = [(np.flatnonzero(everywhere), np.zeros(int(everywhere.sum()), np.int64), sizes[one[everywhere]] - length)]
    todo = np.flatnonzero(open_group[group])
    weight = np.cumsum(sizes[one[todo]])
    lo = 0
    while lo < len(todo):
        hi = int(np.searchsorted(weight, (weight[lo - 1] if lo else 0) + SORT_BYTES, side="right"))
        hi = max(hi, lo + 1)
        while hi < len(todo) and group[todo[hi]] == group[todo[hi - 1]]:
            hi += 1  # never cut a group
        mine = todo[lo:hi]
        src = one[mine]
        off = np.r_[0, np.cumsum(sizes[src])]
        spots, _ = _spread(start[src], start[src] + sizes[src] - 1)
        p, flag = repeated_windows(data[spots], off, length)
        # runs of window starts: the windows of a context are consecutive places
        starts = np.r_[0, np.cumsum(sizes[src] - length + 1)]
        flag &= ~np.repeat(everywhere[mine], np.diff(starts))
        r, a, z = _runs(flag, starts)
        found.append((mine[r], a - starts[r], z - starts[r]))
        lo = hi
    k, a, z = (np.concatenate(x) for x in zip(*found))
    # back to every copy of each context, batch by batch
    order = np.argsort(k, kind="stable")
    k, a, z = k[order], a[order], z[order]
    slot = np.empty(len(h), np.int64)
    slot[by] = np.repeat(np.arange(len(heads)), copies)
    left, right = np.searchsorted(k, slot, side="left"), np.searchsorted(k, slot, side="right")
    ends = np.cumsum([len(x) for x in hs])
    for b, x, e in zip(some.column("batch").to_pylist(), hs, ends.tolist()):
        at = np.arange(e - len(x), e)
        at = at[right[at] > left[at]]
        if len(at):
            pick, owner = _spread(left[at], right[at] - 1)
            out.append((-1, b, CONTEXTS, c[at][owner].astype("<u8").tobytes(), a[pick].astype("<u4").tobytes(), z[pick].astype("<u4").tobytes(), b""))
    return out


def covered(column, told: pa.Table, length: int, margin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of the batch's texts, and which bytes a repeated window covers."""
    scan = Scan(column, length, margin)
    kinds = told.column("kind").to_pylist()
    some = told.filter(pa.array([k == CONTEXTS for k in kinds], pa.bool_()))
    ids = np.concatenate([*(np.frombuffer(x, "<u8") for x in _buffers(some.column("hashes"))), np.zeros(0, "<u8")]).astype(np.uint64) \
        if some.num_rows else np.zeros(0, np.uint64)
    a, z = (np.concatenate([np.frombuffer(x, "<u4") for x in _buffers(some.column(name))]).astype(np.int64) if some.num_rows else np.zeros(0, np.int64)
            for name in ("more", "sizes"))
    order = np.argsort(ids, kind="stable")
    ids, a, z = ids[order], a[order], z[order]
    hot = _known(told, WINDOWS)
    edge = np.zeros(len(scan.data) + 1, np.int32)
    for start, _, prefix, h, first, last in scan:
        if len(ids):
            c = hash_spans(prefix, first, last + length)
            left, right = np.searchsorted(ids, c, side="left"), np.searchsorted(ids, c, side="right")
            mine = np.flatnonzero(right > left)
            if len(mine):
                pick, owner = _spread(left[mine], right[mine] - 1)
                base = start + first[mine][owner]
                np.add.at(edge, base + a[pick], 1)
                np.add.at(edge, base + z[pick] + length, -1)
        if len(hot):
            p, _ = _spread(first, last)
            p = p[_among(hash_spans(prefix, p, p + length), hot)]
            np.add.at(edge, start + p, 1)
            np.add.at(edge, start + p + length, -1)
    np.cumsum(edge, out=edge)
    return scan.data, scan.offsets, edge[:-1] > 0


# ---------------------------------------------------------------- operator

#: Columns of the result besides those of the input.
RESULT = ("n_bytes", "n_removed", "removed", "kept")


def _whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone`` widened to every byte of a character that lost one (a character has at most four bytes)."""
    later = (data & 0xC0) == 0x80  # not the first byte of its character
    out = gone.copy()
    for _ in range(3):  # back to the first byte, then on to the last
        out[:-1] |= later[1:] & out[1:]
    for _ in range(3):
        out[1:] |= later[1:] & out[:-1]
    return out


def _nullable(kind: pa.DataType) -> pa.DataType:
    """The type with every nested field nullable, as a result schema states it."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _nullable(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(pa.field(kind.value_field.name, _nullable(kind.value_type)))
    return kind


def _removed(docs: DataFrame, text_col: str, length: int, margin: int, as_text: bool) -> DataFrame:
    """``(row, n_bytes, n_removed, removed, kept)`` with the other columns of ``docs`` in ``row``."""
    n = 2 * width(docs.sparkSession)
    text = F.col(text_col).cast("string")
    hashed = [f"`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    batched = docs.select(F.expr(f"cast(pmod(xxhash64({', '.join(hashed)}), {n}) as int)").alias("batch"), text.alias("text"),
                          F.struct(text.isNull().alias("_null"), *[c for c in docs.columns if c != text_col]).alias("row"))
    grouped = batched.groupBy("batch")  # one exchange of the texts serves all three passes

    def first(texts: pa.Table) -> pa.Table:
        return _table(send_anchors(texts.column("text"), texts.column("batch")[0].as_py(), n, length, margin))

    def second(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows or not told.num_rows:
            return _table([])
        return _table(send_contexts(texts.column("text"), told, texts.column("batch")[0].as_py(), n, length, margin))

    def finish(texts: pa.Table, told: pa.Table) -> pa.Table:
        data, offsets, gone = covered(texts.column("text"), told, length, margin)
        r, a, z = _runs(gone, offsets)
        n = len(offsets) - 1
        removed = np.bincount(r, z + 1 - a, n).astype(np.int64)
        spans = pa.StructArray.from_arrays([pa.array(a - offsets[r]), pa.array(z + 1 - offsets[r])], ["first", "last"])
        spans_at = np.r_[0, np.cumsum(np.bincount(r, minlength=n))].astype(np.int32)
        lost, out = gone, removed
        if as_text:
            lost = _whole_characters(data, gone)
            r, a, z = _runs(lost, offsets)
            out = np.bincount(r, z + 1 - a, n).astype(np.int64)
        left = np.r_[0, np.cumsum(np.diff(offsets) - out)].astype(np.int32)
        kept = pa.Array.from_buffers(pa.string() if as_text else pa.binary(), len(removed),
                                     [None, pa.py_buffer(left.tobytes()), pa.py_buffer(data[~lost].tobytes())])
        whole = texts.column("row")
        return pa.table({"row": whole.cast(_nullable(whole.type)), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed),
                         "removed": pa.ListArray.from_arrays(pa.array(spans_at), spans), "kept": kept})

    told = grouped.applyInArrow(giving_back(first), MESSAGE).groupBy("bucket").applyInArrow(giving_back(lambda t: _table(count_anchors(t))), MESSAGE)
    contexts = grouped.cogroup(told.groupBy("batch")).applyInArrow(giving_back(second), MESSAGE)
    answers = contexts.groupBy("bucket").applyInArrow(giving_back(lambda t: _table(resolve(t, length))), MESSAGE)
    row_type = batched.schema["row"].dataType.simpleString()
    return grouped.cogroup(answers.groupBy("batch")).applyInArrow(
        giving_back(finish), f"row {row_type}, n_bytes long, n_removed long, removed array<struct<first:long,last:long>>, kept {'string' if as_text else 'binary'}")


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = 200, margin: int = MARGIN) -> DataFrame:
    """The columns of ``docs`` but the text, plus ``n_bytes``, ``n_removed``, ``removed`` and ``kept``.

    Texts are UTF-8 bytes (null: empty).  A byte goes if a ``length``-byte
    string that covers it also starts anywhere else, in this text or
    another; strings are judged on the input and never cross texts.
    ``removed`` holds the maximal removed runs as (first byte, byte after
    the last) and ``kept`` the other bytes in order.  Of equal texts of at
    least ``length`` bytes nothing is left.  Ids are not read, so repeated
    and null ids change nothing; columns of the result's names are replaced;
    an empty table gives an empty one.

    Anchors and contexts are told apart by 64-bit hashes of their bytes; the
    suffix sort compares the bytes themselves.
    """
    found = _removed(docs, text_col, length, margin, as_text=False)
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in (text_col, *RESULT)], *RESULT)


def keep_unrepeated(docs: DataFrame, text_col: str = "text", length: int = 200, margin: int = MARGIN) -> DataFrame:
    """``docs`` with repeated bytes taken out of the texts; ``n_chars``, if there, counts what is left.

    A character that a cut leaves in part is dropped whole.  Every row
    stays, also one that is left empty; null texts stay null.
    """
    found = _removed(docs, text_col, length, margin, as_text=True)
    text = F.when(~F.col("row._null"), F.col("kept"))
    new = {text_col: text, "n_chars": F.char_length(text).cast("long")}
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
