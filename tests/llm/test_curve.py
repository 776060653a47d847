"""Operator 11: word table, Hilbert keys, and packing against the tokenizer itself."""
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from segment_lab.llm import curve, word_tokens
from segment_lab.llm.queries import vocabulary

BYTE_LEVEL = "byte_bpe_50k.json"


def plain(path):
    tokenizer = word_tokens.load_tokenizer(path)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    marks = list("aZ9é÷×ßñ.,;'\"!?-_() \u0085 　\x1c\t\n\r\x0b ́日本🙂Ж") + \
        ["  ", "\n\n", "'s", "'ll", "<|endoftext|>", " the", "İ", "Σ", "abc", " abc", "É.", "  x", "  y"]
    return ["".join(rng.choice(marks) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("bits", [21, 5])
def test_word_table_equals_the_tokenizer(bits):
    path = vocabulary(BYTE_LEVEL)
    want, words = plain(path), word_tokens.byte_level(path)
    words.table = word_tokens.IdTable(bits)  # a small one forgets and grows
    for part in range(4):
        texts = odd_texts(400, part) + ["", "x" * 5000, "a b " * 900]
        raw = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        ids, at = words.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
        for k, t in enumerate(texts):
            assert ids[at[k]:at[k + 1]].tolist() == want(t), t


def test_hilbert_neighbours_touch():
    for d, bits in ((2, 4), (3, 3), (4, 2), (6, 1)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        keys = curve.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_tail_is_cut_at_powers_of_two():
    assert curve.tail_cuts(2048, 0) == [] and curve.tail_cuts(2048, 512) == [2048]
    assert curve.tail_cuts(0, 700) == [0, 512, 640, 672, 688, 696]


def check(got, data, size, ids_of):
    """Pieces cover each row's ids once; sequences are gapless, of ``size`` tokens or a power of two."""
    want = Counter((i, len(ids_of(t)) + 1) for i, t in data)
    sequences, tokens = defaultdict(list), Counter()
    texts = defaultdict(list)
    for i, t in data:
        texts[i].append(np.array(ids_of(t) + [0], "<u4"))
    for r in got:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for x in texts[r.doc_id])
        sequences[r.sequence_id].append((r.offset, r.length))
        tokens[(r.doc_id, r.doc_tokens)] += r.length
    assert tokens == Counter({(i, n): n * k for (i, n), k in want.items()})
    lengths = []
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= size and end & (end - 1) == 0
        lengths.append(end)
    assert sum(n < size for n in lengths) <= size.bit_length()
    return sequences


def test_packing_along_the_curve(edge):
    path = vocabulary(BYTE_LEVEL)
    data = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    out = curve.pack_along_curve(edge, path, size=256, keep_ids=True).collect()
    check(out, data, 256, plain(path))
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in out)


def test_empty_table(nothing):
    assert curve.pack_along_curve(nothing, vocabulary(BYTE_LEVEL)).count() == 0


def test_a_third_of_equal_texts(spark):
    """Copies share a key; they are spread over the blocks and packed like any other."""
    rng = random.Random(1)
    data = [(k, "the very same text of a copy") for k in range(400)] + \
        [(k, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(0, 90)))) for k in range(400, 1200)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    path = vocabulary(BYTE_LEVEL)
    check(curve.pack_along_curve(docs, path, size=128).collect(), data, 128, plain(path))


def test_neighbours_on_the_curve_are_alike(spark, small_dir):
    import __spark_entry__ as E
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    rows = sorted((r.curve_key, r.doc_id) for r in E.queries()["op11_curve"](spark, small_dir).collect() if r.start == 0)
    alike = sum(lang[a] == lang[b] for (_, a), (_, b) in zip(rows, rows[1:])) / (len(rows) - 1)
    share = Counter(lang.values())
    by_chance = sum(n * n for n in share.values()) / len(lang) ** 2
    assert alike > by_chance + 0.25
