"""Operator 12: carry-save counts, and the audit against filters applied one by one."""
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from segment_lab.llm import survival
from segment_lab.llm.common import join_by_size

NAMES = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute_force(data, labels):
    """The filters applied left to right in every order; ``data`` has (id, text, lang), ``labels`` (id, quality, toxic)."""
    ids = defaultdict(list)
    for i, t, _ in data:
        ids[t or ""].append(i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rank = lambda i: (i is None, i or 0)
    parts = defaultdict(list)
    for i, t, lang in data:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": any(rank(j) < rank(i) for j in ids[t])}
        parts[lang or ""].append(({k for k, v in fails.items() if v}, i in good, i in toxic))
    out = []
    for part, docs in parts.items():
        rows, shapley = [], Counter()
        for order in permutations("ABCDE"):
            alive, gone = list(docs), []
            for step, f in enumerate(order, 1):
                lost = [d for d in alive if f in d[0]]
                redundant = sum(f in d[0] for d in gone)
                gone += lost
                alive = [d for d in alive if f not in d[0]]
                shapley[f] += len(lost)
                rows.append((part, "".join(order), step, len(alive), len(lost), redundant, sum(d[0] == {f} for d in docs),
                             sum(d[1] for d in lost), sum(d[2] for d in lost)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows]
    return Counter(out)


def test_carry_save_counts():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 4, 8, 9, 100, 4097):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        want = [int(((words >> np.uint32(k)) & 1).sum()) for k in range(32)]
        assert survival.positional_popcount(words).tolist() == want
    assert survival.positional_popcount(np.full(1000, 0xFFFFFFFF, np.uint32)).tolist() == [1000] * 32


def test_words_hold_the_subsets_survived():
    words = survival.survival_words()
    assert int(words[0]) == 0xFFFFFFFF and int(words[31]) == 1
    for failed in range(32):
        for subset in range(32):
            assert (int(words[failed]) >> subset & 1) == (failed & subset == 0)


def test_audit_of_edge_rows(spark, edge):
    more = [(200, "Word " * 120, "en"), (201, "WORD " * 20 + "#", "en"), (None, "WORD " * 20 + "#", None), (None, "WORD " * 20 + "#", ""),
            (202, " ".join(f"w{k}" for k in range(150)), "de"), (203, " ".join(f"w{k}" for k in range(150)), "de"), (204, "%", "fr")]
    docs = edge.select("doc_id", "text", "lang", "id", "kept", "label", "n_words") \
        .unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"), allowMissingColumns=True)
    marks = [(1, 1, 0), (1, 0, 1), (2, 1, None), (3, 0, 1), (None, 1, 1), (203, 1, 1), (7, 1, 0), (204, None, 1), (999, 1, 1)]
    labels = spark.createDataFrame([(*m, "x") for m in marks], "doc_id long, quality int, toxic int, failed string")
    data = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
    got = survival.audit(docs, labels).collect()
    assert Counter(tuple(r[c] for c in NAMES) for r in got) == brute_force(data, marks)
    without = survival.audit(docs, labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(without) == (0, 0)


def test_nothing_to_audit(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = survival.audit(nothing, labels)
    assert out.count() == 0 and tuple(out.columns) == NAMES


def test_large_groups_of_copies(spark):
    data = [(k, "the same text", "en" if k % 2 else None) for k in range(1500)] + [(5000 + k, f"text {k // 3}", "en") for k in range(1500)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2, k % 3 % 2) for k in range(0, 6000, 7)], "doc_id long, quality int, toxic int")
    got = survival.audit(docs, labels).collect()
    assert Counter(tuple(r[c] for c in NAMES) for r in got) == brute_force(data, [tuple(r) for r in labels.collect()])


def test_join_by_size_keeps_every_row(spark):
    big = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"k{i // 2}", i) for i in range(100)] + [("alone", 1)], "k string, i long")
    small = big.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("least")).where("n > 1")
    got = join_by_size(big, small, "k", "n", 1001, share=100)
    assert got.count() == 1001 and got.where("least IS NULL").count() == 1
    assert got.where("k = 'hot' AND least = 0").count() == 900 and got.where("k LIKE 'k%' AND least = i").count() == 50
