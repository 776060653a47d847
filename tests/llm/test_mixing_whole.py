"""The whole selection of the mixing operator against plain Python: budgets down the tree, epochs, prefixes."""
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from segment_lab.llm import mixing

SEED = 17


def shares(children, own):
    """``{name: budget}`` of ``{name: (weight, limit)}``: shares by weight, what a child cannot use goes to the others, again and again."""
    full, left, still = {}, own, dict(children)
    while True:
        open_weight = sum(w for w, _ in still.values())
        over = [c for c, (w, limit) in still.items() if w > 0 and limit <= w * left / open_weight] if open_weight else []
        if not over:
            return {**full, **{c: min(limit, w * left / open_weight) if open_weight else 0.0 for c, (w, limit) in still.items()}}
        for c in over:
            full[c] = still.pop(c)[1]
            left -= full[c]


def leaf_budgets(tokens, names, budget, max_epochs, weights, alpha):
    found = {(): float(budget)}
    for depth, level in enumerate(names):
        below = defaultdict(dict)
        for node in {leaf[:depth + 1] for leaf in tokens}:
            held = sum(n for leaf, n in tokens.items() if leaf[:depth + 1] == node)
            weight = weights[level].get(node[-1], 0.0) if level in weights else float(held) ** alpha
            below[node[:-1]][node] = (weight, float(held * max_epochs))
        found = {node: b for parent, children in below.items() for node, b in shares(children, found[parent]).items()}
    return {leaf: int(b + 0.5) for leaf, b in found.items()}


def selection(docs, levels, budget, max_epochs, weights, alpha=0.7):
    """Bag of (id, text, epoch)."""
    place = [F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.lit(e), F.xxhash64("doc_id", "text")), 1).alias(f"p{e}") for e in range(1, max_epochs + 2)]
    rows = docs.select("doc_id", "text", F.array(*[F.coalesce(c.cast("string"), F.lit("\x00null")) for c in levels.values()]).alias("leaf"),
                       *place).collect()
    size = {id(r): len([w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in r.text or "").split(" ") if w]) for r in rows}
    leaves = defaultdict(list)
    for r in rows:
        leaves[tuple(r.leaf)].append(r)
    tokens = {leaf: sum(size[id(r)] for r in rs) for leaf, rs in leaves.items()}
    budgets = leaf_budgets(tokens, list(levels), sum(tokens.values()) if budget is None else budget, max_epochs, weights, alpha)
    out = Counter()
    for leaf, rs in leaves.items():
        held = tokens[leaf]
        epochs = min(max_epochs, budgets[leaf] // held) if held else 1
        left = max(0, budgets[leaf] - epochs * held) if held else 0
        at = defaultdict(int)
        for r in rs:
            at[r[f"p{epochs + 1}"]] += size[id(r)]
        taken, run = set(), 0
        for p in sorted(at):
            run += at[p]
            if left and 2 * run - at[p] <= 2 * left:
                taken.add(p)
        for r in rs:
            for epoch in range(1, epochs + (r[f"p{epochs + 1}"] in taken) + 1):
                out[(r.doc_id, r.text, epoch)] += 1
    return out


def made(spark, n=600):
    """A third of the rows under one source, null levels, copies, ties, empty and null texts."""
    rng = random.Random(9)
    rows = []
    for k in range(n):
        source = "hot" if k % 3 == 0 else rng.choice(["a", "b", "c", None])
        text = rng.choice([None, "", " \n", "w " * rng.randint(1, 40), "same text twice", "é x y\tz"])
        rows.append((k // 2 if k % 50 == 0 else k, text, rng.choice(["en", "en", "de", None]), source))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("budget,epochs,weights", [
    (None, 2, {}), (500, 2, {}), (40_000, 3, {}), (3_000, 1, {"source": {"hot": 0.1, "a": 0.6, "b": 0.3}}),
    (4_000, 2, {"language": {"en": 1.0, "de": 3.0}, "source": {"hot": 1.0, "a": 5.0}}), (0, 2, {})])
def test_whole_selection(spark, budget, epochs, weights):
    docs = made(spark)
    levels = mixing.document_levels()
    got = mixing.mix(docs, levels, budget=budget, max_epochs=epochs, weights=weights)
    assert Counter((r.doc_id, r.text, r.epoch) for r in got.collect()) == selection(docs, levels, budget, epochs, weights)


def test_edge_rows(edge):
    levels = mixing.document_levels()
    got = mixing.mix(edge, levels).collect()
    assert Counter((r.doc_id, r.text, int(r.epoch)) for r in got) == selection(edge, levels, None, 2, {})
