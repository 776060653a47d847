"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

The field is fitted on a bounded sample of labelled documents (a line takes
its document's label) and on splices of two of them with unlike labels, which
teach it where labels change, with exact gradients from forward and backward sums.
Viterbi decoding then labels the lines of every document; the share of words
in content lines decides whether the document stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SEPARATOR, chunks, giving_back, hash_spans, mix, prefix_hashes, utf8, words_of
from .substrings import window_hashes

#: Bounds of the labelled sample that fits the field: documents, and lines of each.
SAMPLE_DOCS = 2_000
SAMPLE_LINES = 64
#: Least share of words in content lines of a document that stays.
CONTENT_SHARE = 0.5
REPEAT_WINDOW = 5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True
LETTER[128:] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
CLOSING = np.zeros(256, bool)
CLOSING[list(b".!?:;\"')")] = True

FEATURES = ("bias", "first", "last", "short", "long", "repeated line", "repeated words", "symbols > 1 %",
            "symbols > 4 %", "bars", "upper case > 30 %", "digits > 20 %", "exclamations > 4 %", "closed")


def base_rows(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Base counts of each row, and its lines with their features."""
    n = len(offsets) - 1
    starts, ends, counts = words_of(data, offsets)
    row = np.repeat(np.arange(n), counts)
    h, first = window_hashes(hash_spans(prefix_hashes(data), starts, ends), counts, REPEAT_WINDOW)
    # a window is told apart from those of other rows by the row's number
    h = mix(h + row[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if len(first) else h
    by = np.argsort(h, kind="stable")
    same = h[by[1:]] == h[by[:-1]]
    twice = np.zeros(len(h), bool)
    twice[by[1:]] |= same
    twice[by[:-1]] |= same
    covered = np.zeros(len(starts) + 1, np.int64)
    np.add.at(covered, first[twice], 1)
    np.add.at(covered, first[twice] + REPEAT_WINDOW, -1)
    repeated = np.cumsum(covered[:-1]) > 0

    def total(flags):
        sums = np.r_[0, np.cumsum(flags, dtype=np.int64)]
        return lambda a, b: sums[b] - sums[a]

    head = (data & 0xC0) != 0x80
    chars = total(head & ~IS_SEPARATOR[data])
    symbols = total(SYMBOLS[data])
    # lines: pieces between \n, none of them over the end of a row
    newline = np.flatnonzero(data == 10)
    line_row = np.searchsorted(offsets, newline, side="right") - 1
    per_row = np.bincount(line_row, minlength=n) + 1
    line_start = np.sort(np.r_[offsets[:-1], newline + 1], kind="stable") if n else newline
    # an empty row has one empty line at its start; the stable sort keeps rows in order
    owner = np.repeat(np.arange(n), per_row)
    last = np.cumsum(per_row) - 1
    line_end = np.r_[line_start[1:] - 1, 0][:len(line_start)]
    line_end[last] = offsets[1:]
    word_at = np.searchsorted(starts, line_start)
    words = np.searchsorted(starts, line_end) - word_at
    text = data.tobytes()
    dup = np.zeros(len(owner), bool)
    seen: set = set()
    current = -1
    for k in np.flatnonzero(words > 0).tolist():
        if owner[k] != current:
            current, seen = owner[k], set()
        line = text[line_start[k]:line_end[k]]
        if line in seen:
            dup[k] = True
        else:
            seen.add(line)
    size = np.maximum(1, total(head)(line_start, line_end))
    line_symbols, letters = symbols(line_start, line_end), np.maximum(1, total(LETTER[data])(line_start, line_end))
    rep = total(repeated)(word_at, word_at + words)
    last_byte = np.where(words > 0, ends[np.maximum(0, word_at + words - 1)] - 1 if len(ends) else 0, 0)
    ordinal = np.arange(len(owner)) - np.repeat(last + 1 - per_row, per_row)
    x = np.stack([
        np.ones(len(owner)), ordinal == 0, ordinal == per_row[owner] - 1, words < 4, words > 25, dup,
        rep * 5 > words, line_symbols * 100 > size, line_symbols * 25 > size,
        total(data == 124)(line_start, line_end) * 100 > size,
        total(UPPER[data])(line_start, line_end) * 10 > 3 * letters,
        total(DIGIT[data])(line_start, line_end) * 5 > size,
        total(data == 33)(line_start, line_end) * 25 > size,
        CLOSING[data[last_byte]] & (words > 0) if len(data) else words > 0], axis=1).astype(np.float64)
    with_word = words > 0
    return {"n_words": counts, "word_chars": chars(offsets[:-1], offsets[1:]), "n_symbols": symbols(offsets[:-1], offsets[1:]),
            "n_dup_lines": np.bincount(owner, dup, n).astype(np.int64),
            "n_repeat_words": np.bincount(row, repeated, n).astype(np.int64),
            "owner": owner[with_word], "words": words[with_word], "x": x[with_word]}


# ---------------------------------------------------------------- the field

class Field:
    """Weights of the boilerplate label per feature and of moves between labels (0 content, 1 boilerplate)."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def viterbi(self, x: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The best label of each line; ``owner`` (ascending) names its document."""
        if not len(owner):
            return np.zeros(0, bool)
        score = x @ self.emit
        heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sizes = np.diff(np.r_[heads, len(owner)])
        order = np.argsort(-sizes, kind="stable")
        heads, sizes = heads[order], sizes[order]
        active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")
        best = np.stack([np.zeros(len(heads)), score[heads]])
        came = np.zeros((2, len(owner)), bool)  # whether the best way to a label comes from boilerplate
        for t in range(1, int(sizes[0])):
            m = active[t]
            at = heads[:m] + t
            a, b = best[0, :m].copy(), best[1, :m].copy()
            for label in (0, 1):
                from0, from1 = a + self.move[0, label], b + self.move[1, label]
                came[label, at] = from1 > from0
                best[label, :m] = np.maximum(from0, from1) + (score[at] if label else 0)
        labels = np.zeros(len(owner), bool)
        now = best[1] > best[0]
        for t in range(int(sizes[0]) - 1, -1, -1):
            m = active[t]
            at = heads[:m] + t
            labels[at] = now[:m]
            now[:m] = np.where(now[:m], came[1, at], came[0, at])
        return labels


def fit_field(sequences: list[np.ndarray], labels: list, rounds: int = 200, penalty: float = 1e-3) -> Field:
    """Maximum likelihood with a squared penalty, by Adam on exact gradients.

    ``labels`` holds a label per sequence, or an array of a label per line.
    Sequences are walked together, longest first, so short ones cost their own lines only.
    """
    by = sorted(range(len(sequences)), key=lambda k: -len(sequences[k]))
    sizes = np.array([len(sequences[k]) for k in by])
    x = np.concatenate([sequences[k] for k in by])
    gold = np.concatenate([np.broadcast_to(np.asarray(labels[k]), len(sequences[k])) for k in by]).astype(int)
    n, width = len(sizes), x.shape[1]
    heads = np.r_[0, np.cumsum(sizes)[:-1]]
    tails = heads + sizes - 1
    owner = np.repeat(np.arange(n), sizes)
    active = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(int(sizes[0]))]  # sequences longer than t
    later = np.ones(len(x), bool)
    later[heads] = False
    later = np.flatnonzero(later)
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (gold[later - 1], gold[later]), 1)
    theta = np.zeros(width + 4)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        emit, move = theta[:width], theta[width:].reshape(2, 2)
        e = np.zeros((len(x), 2))
        e[:, 1] = x @ emit
        ahead, back = e.copy(), np.zeros((len(x), 2))
        for t in range(1, len(active)):
            at = heads[:active[t]] + t
            old = ahead[at - 1]
            ahead[at] += np.logaddexp(old[:, 0, None] + move[0], old[:, 1, None] + move[1])
        for t in range(len(active) - 1, 0, -1):
            at = heads[:active[t]] + t
            come = e[at] + back[at]
            back[at - 1] = np.logaddexp(come[:, 0, None] + move[:, 0], come[:, 1, None] + move[:, 1])
        z = np.logaddexp(ahead[tails, 0], ahead[tails, 1])[owner]
        grad = np.zeros_like(theta)
        grad[:width] = x.T @ (gold - np.exp(ahead[:, 1] + back[:, 1] - z))
        both = np.exp(ahead[later - 1, :, None] + move + (e[later] + back[later])[:, None, :] - z[later, None, None])
        grad[width:] = (seen_moves - both.sum(axis=0)).ravel()
        grad = grad / n - penalty * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad ** 2
        theta = theta + 0.1 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
    return Field(theta[:width], theta[width:].reshape(2, 2))


FIRST, LAST = FEATURES.index("first"), FEATURES.index("last")


def spliced(sequences: list[np.ndarray], bad: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sequences that change label: each document followed by one of the other label, as many as there are documents.

    Partners are taken in turn, so all documents of the rarer label are used about equally often.
    """
    kinds = [[s for s, b in zip(sequences, bad) if b == label] for label in (0, 1)]
    xs, labels, turn = [], [], [0, 0]
    for s, b in zip(sequences, bad):
        others = kinds[1 - b]
        other = others[turn[b] % len(others)]
        turn[b] += 1
        x = np.concatenate([s, other])
        x[:, [FIRST, LAST]] = 0
        x[0, FIRST] = x[-1, LAST] = 1
        xs.append(x)
        labels.append(np.repeat([b, 1 - b], [len(s), len(other)]))
    return xs, labels


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample_docs: int = SAMPLE_DOCS, seed: int = 11) -> Field | None:
    """Fit on up to ``sample_docs`` labelled documents drawn by a seeded hash and as many splices; None unless both labels occur."""
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) / float(1 << 53)
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id is not null and label is not null")
    total = marked.count()
    drawn = marked.withColumn("u", place).where(F.col("u") * total <= 2.0 * sample_docs + 50).orderBy("u", "id").limit(sample_docs)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null") \
        .join(F.broadcast(drawn), "id")  # at most sample_docs rows

    def lines(batches):
        for b in batches:
            found = base_rows(*utf8(b.column("text")))
            rows = [found["x"][found["owner"] == k][:SAMPLE_LINES].astype(np.float32).tobytes() for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label").cast(pa.int32()), pa.array(rows, pa.binary())], ["id", "label", "x"])

    kind = texts.schema["id"].dataType.simpleString()
    got = sorted(texts.mapInArrow(lines, f"id {kind}, label int, x binary").collect(), key=lambda r: (r["id"], r["x"]))
    got = [r for r in got if r["x"]][:sample_docs]
    bad = [int(r["label"] == 0) for r in got]
    if len(set(bad)) < 2:
        return None
    whole = [np.frombuffer(r["x"], np.float32).reshape(-1, len(FEATURES)).astype(np.float64) for r in got]
    mixed, turned = spliced(whole, bad)
    return fit_field(whole + mixed, bad + turned)


# ---------------------------------------------------------------- operator

def judge(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text",
          content_share: float = CONTENT_SHARE) -> DataFrame:
    """Base counts and verdict of each row: ``base_failed``, ``kept``, and the words of content lines.

    ``base_failed``: fewer than ten words, or over 20 % of them in 5-word
    windows that the text repeats.  ``kept`` is false then, else whether at
    least ``content_share`` of the words lie in lines that the field calls
    content (all lines if ``field`` is None).  A null text has no words.
    Rows with repeated or null ids are judged one by one; other columns are
    not read; an empty table gives an empty one.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column("text"))
            for lo, hi in chunks(offsets):
                f = base_rows(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                junk = field.viterbi(f["x"], f["owner"]) if field else np.zeros(len(f["owner"]), bool)
                content = np.bincount(f["owner"], f["words"] * ~junk, hi - lo).astype(np.int64)
                failed = (f["n_words"] < 10) | (100 * f["n_repeat_words"] > 20 * f["n_words"])
                kept = ~failed & (content >= content_share * f["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(lo, hi - lo), *(pa.array(f[c].astype(np.int64)) for c in names), pa.array(failed), pa.array(kept), pa.array(content)],
                    ["id", *names, "base_failed", "kept", "content_words"])

    kind = source.schema["id"].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in names)
    return source.mapInArrow(giving_back(run), f"id {kind}, {longs}, base_failed boolean, kept boolean, content_words long").withColumnRenamed("id", id_col)
