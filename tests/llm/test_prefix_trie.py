"""Operator 13: the trie of rebuilt conversations against one built turn by turn."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from segment_lab.llm import prefix_trie

NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, key string, d string, n string"


def brute_force(rows):
    """``rows`` of (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(re.findall("[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def talks(seed, n=120, copies=0):
    rng = random.Random(seed)
    say = lambda: rng.choice([None, "", " ", "hello there", "a b  c", "yes\nno", "\u0085x", "ok"])
    rows = []
    for c in range(n):
        if rng.random() < 0.2:
            continue
        for t in range(rng.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), say()))
        if rng.random() < 0.2:
            rows.append(rows[-1])
    rows += [(None, 0, "user", "nobody"), (None, None, None, None)]
    rows += [(1000 + c, t, "user", f"same turn {t}") for c in range(copies) for t in range(4)]
    rows += [(20 * 999, t, "user", f"turn {t} " * (t % 5)) for t in range(150)]  # a long one, and another that begins like it
    rows += [(20 * 999 + 7, t, "user", f"turn {t} " * (t % 5)) for t in range(149)] + [(20 * 999 + 7, 200, "user", "end")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("bits", [22, 3])
def test_trie_equals_brute_force(spark, monkeypatch, bits):
    """Also with a sketch so small that it proves next to nothing."""
    monkeypatch.setattr(prefix_trie, "SKETCH_BITS", bits)
    rows = talks(1)
    got = prefix_trie.trie(frame(spark, rows)).collect()
    assert Counter(tuple(r[n] for n in NAMES) for r in got) == brute_force(rows)


def test_many_copies_of_a_conversation(spark):
    rows = talks(2, 60, copies=700)
    got = prefix_trie.trie(frame(spark, rows)).collect()
    assert Counter(tuple(r[n] for n in NAMES) for r in got) == brute_force(rows)


def test_few_and_no_conversations(spark):
    for rows in ([(5, 0, "user", "hi")], [(3, 0, "user", "hi")], [(40, None, None, None)]):
        got = prefix_trie.trie(frame(spark, rows)).collect()
        assert Counter(tuple(r[n] for n in NAMES) for r in got) == brute_force(rows)
    empty = prefix_trie.trie(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and tuple(empty.columns) == NAMES
    assert prefix_trie.trie(frame(spark, [(None, 0, "user", "hi")])).count() == 0


def test_sketch_never_counts_too_few(spark, monkeypatch):
    rng = np.random.default_rng(4)
    keys = [rng.bytes(16) for _ in range(3000)]
    rows = keys + keys[:1000] + keys[:500]
    df = spark.createDataFrame([(bytearray(k),) for k in rows], "key binary").repartition(5)
    true = Counter(rows)
    for limit in (22, 9):
        monkeypatch.setattr(prefix_trie, "SKETCH_BITS", limit)
        monkeypatch.setattr(prefix_trie, "SEGMENT", 256)
        sketch = prefix_trie.build_sketch(df, len(rows))
        at = prefix_trie.cells(df.select("key").toArrow().column("key"), sketch.shape[1].bit_length() - 1)
        estimate = np.min([row[own] for row, own in zip(sketch, at)], axis=0)
        found = [bytes(r.key) for r in df.collect()]
        assert all(e >= min(true[k], 2) for e, k in zip(estimate.tolist(), found))
        if limit == 22:
            assert np.mean([e == 1 for e, k in zip(estimate.tolist(), found) if true[k] == 1]) > 0.95


def test_tails_do_not_shuffle(spark, small_dir):
    """Most prefixes of the given table are proved single and never reach the exact grouping."""
    talk = spark.read.parquet(f"{small_dir}/conversations.parquet")
    prefixes = prefix_trie.prefix_rows(prefix_trie.rebuilt(prefix_trie.turn_rows(talk)))
    n = prefixes.count()
    alone = prefix_trie.screen(prefixes, prefix_trie.build_sketch(prefixes, n)).where("alone").select("key")
    exact = prefixes.groupBy("key").count().where("count = 1").count()
    assert 0.9 * exact <= alone.count() <= exact
    assert alone.join(prefixes, "key").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").count() == 0
