"""Language identification by cross-parsing entropy over suffix automata.

For each language a suffix automaton of a bounded sample of labelled text
knows all its substrings.  A text is cut greedily into the longest phrases
that occur there; the fewer phrases a language needs (normalised by the
sample's size), the better it explains the text.  The automata are laid out
as one transition table, and all texts of a batch are walked together, one
symbol per step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizing import checked_collect
from .common import fresh, giving_back, utf8, worker_cache

#: Labelled text that is learned for each language (the stated bounds of the training sample).
SAMPLE_CHARS = 20_000
SAMPLE_DOCS = 200
MAX_LANGUAGES = 1_000
#: A longer text is parsed in blocks of this many symbols; no phrase runs over the end of a block.
BLOCK = 16_384
#: Texts walked together, in bytes.
WALK_BYTES = 8 << 20
UNKNOWN = "und"
#: The top two bits of a table entry: phrases that end with the step.
PHRASE_SHIFT = np.uint32(30)
STATE_MASK = np.uint32((1 << 30) - 1)


def held_out(id_col: str) -> Column:
    """Whether a document is never learned from: CRC-32 of its id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def normalise(text: str) -> str:
    """Lower case, every run of other characters than letters one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


# ---------------------------------------------------------------- learning

def training_samples(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int = SAMPLE_DOCS,
                     sample_chars: int = SAMPLE_CHARS, seed: int = 5) -> dict[str, str]:
    """Up to ``sample_chars`` normalised characters of learnable text per language.

    Rows are drawn by a seeded hash of the id, at a rate that leaves about
    twice ``sample_docs`` of each language before the exact cut, so no
    language is gathered or sorted whole.
    """
    usable = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")) \
        .where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("id"))
    place = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) / float(1 << 53))
    # one model per language must fit into each worker, so their number is small; more is an error
    counts = {r["lang"]: r["n"] for r in checked_collect(usable.groupBy("lang").agg(F.count("*").alias("n")), 2 * MAX_LANGUAGES, "languages", 2)}
    if not counts:
        return {}
    rate = F.try_element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, (2.0 * sample_docs + 50) / n)]), F.col("lang"))
    drawn = usable.withColumn("u", place).where(F.col("u") <= rate)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", "id", F.xxhash64("text")))
    rows = drawn.select("lang", "id", "u", F.left("text", F.lit(sample_chars)).alias("text")).withColumn("r", rank) \
        .where(F.col("r") <= sample_docs).orderBy("lang", "r").select("lang", "text").collect()  # at most sample_docs per language
    found: dict[str, str] = {}
    for r in rows:
        had = found.get(r["lang"], "")
        if len(had) < sample_chars:
            found[r["lang"]] = (had + " " + normalise(r["text"])).strip()[:sample_chars]
    return {k: v for k, v in sorted(found.items()) if v}


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring (state 0 is the start)."""
    step, link, length = [{}], [-1], [0]
    last = 0
    for c in codes:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[new] = twin
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
        last = new
    return step


class Model:
    """All automata as one table: an entry is the next state (times the row width) and the phrases that end."""

    def __init__(self, samples: dict[str, str]):
        self.languages = list(samples)
        letters = sorted(set("".join(samples.values())) - {" "})
        self.symbols = len(letters) + 2  # 0: a letter never seen, 1: a run of other characters
        self.code = np.ones(0x110000, np.uint16)
        every = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.code[every] = 0
        for k, c in enumerate(letters):
            self.code[ord(c)] = k + 2
        tables, self.start = [], []
        base = 0
        for text in samples.values():
            trie = suffix_automaton([1 if c == " " else int(self.code[ord(c)]) for c in text])
            # a symbol that never occurs is a phrase of its own, after the one it cuts short
            root = np.full(self.symbols, base + (1 << 30), np.uint32)
            for c, q in trie[0].items():
                root[c] = base + q * self.symbols
            rows = np.tile(root + np.uint32(1 << 30), (len(trie), 1))
            rows[0] = root
            state = np.repeat(np.arange(len(trie)), [len(t) for t in trie])
            symbol = np.fromiter((c for t in trie for c in t), np.int64, len(state))
            target = np.fromiter((q for t in trie for q in t.values()), np.int64, len(state))
            rows[state, symbol] = base + target * self.symbols
            tables.append(rows.ravel())
            self.start.append(base)
            base += rows.size
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.uint32)
        self.bits = np.log2([max(2, len(t)) for t in samples.values()])

    def symbols_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts, their number and the number of letters per text."""
        flat, sizes, letters = [], [], []
        for t in texts:
            c = self.code[np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
            other = c == 1
            letters.append(len(c) - int(other.sum()))
            if len(c):
                keep = ~other
                keep[1:] |= ~other[:-1]  # one space after each word
                keep[0] = not other[0]
                c = c[keep]
            flat.append(c)
            sizes.append(len(c))
        return np.concatenate(flat) if flat else np.zeros(0, np.uint16), np.array(sizes, np.int64), np.array(letters, np.int64)

    def phrases(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Number of phrases of each text in each language (languages by texts)."""
        blocks = np.maximum(1, -(-sizes // BLOCK))
        owner = np.repeat(np.arange(len(sizes)), blocks)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = np.repeat(np.cumsum(sizes) - sizes, blocks) + rank * BLOCK
        length = np.minimum(sizes[owner] - rank * BLOCK, BLOCK)
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        start = np.array(self.start, np.uint32)[:, None]
        state = np.repeat(start, len(order), axis=1)
        count = np.zeros(state.shape, np.int32)
        active = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")
        for t, m in enumerate(active.tolist()):
            move = self.table[state[:, :m] + flat[begin[:m] + t]]
            count[:, :m] += move >> PHRASE_SHIFT
            state[:, :m] = move & STATE_MASK
        count += state != start  # the phrase that the end of the block cut short
        out = np.zeros((len(self.languages), len(sizes)), np.int64)
        for k in range(len(self.languages)):
            out[k] = np.bincount(owner[order], count[k], len(sizes))
        return out

    def classify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        flat, sizes, letters = self.symbols_of(texts)
        known = (letters > 0) & bool(self.languages)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        cost = self.phrases(flat, sizes) * self.bits[:, None] / np.maximum(1, sizes)
        best = cost.argmin(axis=0)
        least = cost.min(axis=0)
        if len(self.languages) > 1:
            second = np.partition(cost, 1, axis=0)[1]
            score = np.where(second > 0, 1 - least / np.maximum(second, 1e-300), 0.0)
        else:
            score = np.ones(len(texts))
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())], np.where(known, score, 0.0)


def model_of(samples: tuple[tuple[str, str], ...]) -> Model:
    """The model of a sample, built once in each Python worker."""
    cache = worker_cache("language")
    if samples not in cache:
        cache.clear()
        cache[samples] = Model(dict(samples))
    return cache[samples]


# ---------------------------------------------------------------- operator

def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             samples: dict[str, str] | None = None, carry: bool = False) -> DataFrame:
    """``(<id_col>, held_out, lang_pred, score)`` of every row, or all columns plus the last two with ``carry`` (with
    underscores in front where ``docs`` has columns of these names).

    ``lang_pred`` is the learned language with the smallest normalised number
    of phrases (ties: the first in alphabetical order) and ``score`` one
    minus its cost over the next best (0 if that is equal, 1 if only one
    language is known).  A null text or one without a letter is ``und`` with
    score 0, as is every text if nothing could be learned.  Rows with a null
    id or language are predicted but not learned from.  Repeated rows each
    get their row; an empty table gives an empty one.
    """
    learned = tuple(sorted((samples if samples is not None else training_samples(docs, id_col, text_col, lang_col)).items()))
    if carry:
        body, lang_name, score_name = fresh(docs, "_text", "lang_pred", "score")
        source = docs.withColumn(body, F.col(text_col).cast("string"))
    else:
        body, lang_name, score_name = "_text", "lang_pred", "score"
        source = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias(body))
    kept = [f for f in source.schema.fields if f.name != body]

    def run(batches):
        model = model_of(learned)
        for b in batches:
            _, offsets = utf8(b.column(body))
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + WALK_BYTES, side="right")) - 1)
                part = b.slice(lo, hi - lo)
                lang, score = model.classify(part.column(body).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                                 [*(f.name for f in kept), lang_name, score_name])
                lo = hi

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return source.mapInArrow(giving_back(run), f"{schema}, `{lang_name}` string, `{score_name}` double")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose text has a language, with the language found in place of the given one.

    Null texts and texts without a letter go, as do all if nothing could be
    learned.
    """
    found = identify(docs, id_col, text_col, lang_col, carry=True)
    predicted = F.col(fresh(docs, "_text", "lang_pred")[1])
    return found.where(predicted != UNKNOWN).withColumn(lang_col, predicted).select(*docs.columns)
