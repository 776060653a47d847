"""Mixing sources to target weights by hierarchical budgets over a tree of groups.

The budget flows down the tree: at every node it is shared among the
children by their weights, a child that cannot use its share keeps what it
can, and its shortage goes to its siblings.  A node's own limit is the sum
of what its leaves can give, so only what a whole family cannot use reaches
the siblings of an ancestor.  A leaf then takes whole epochs of its
documents and a token prefix of one more epoch, in an order seeded by epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import width, written

#: A leaf table up to this many rows is broadcast; a larger one is joined by key.
BROADCAST_LEAVES = 50_000
#: Words: runs of other characters than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def default_domain(source_col: str = "source", domains: int = 4) -> Column:
    """A stand-in for a domain column: the CRC of the source name picks one of ``domains``."""
    return F.concat(F.lit("domain"), (F.crc32(F.encode(F.coalesce(F.col(source_col).cast("string"), F.lit("")), "UTF-8")) % domains).cast("string"))


def _weight(levels: list[str], depth: int, weights: dict[str, dict[str, float]], alpha: float) -> Column:
    given = weights.get(levels[depth], {})
    out = F.pow(F.col("_tokens").cast("double"), F.lit(alpha))
    if given:
        names = F.create_map(*[F.lit(x) for kv in given.items() for x in kv])
        out = F.coalesce(F.try_element_at(names, F.col(f"_l{depth}")), F.lit(0.0))
    return out


def leaf_budgets(leaves: DataFrame, levels: list[str], budget: float, max_epochs: int,
                 weights: dict[str, dict[str, float]] | None = None, alpha: float = 0.7) -> DataFrame:
    """``leaves`` (``_l0.._lk``, ``_tokens``) with ``_budget`` tokens each.

    One window per level: among the children of a node, in ascending order
    of limit per weight, a child is full if the budget left for it and all
    later ones, shared by weight, reaches its limit.  Weights that are not
    given are the node's tokens to the power ``alpha``.
    """
    keys = [f"_l{k}" for k in range(len(levels))]
    nodes = None
    for depth in range(len(levels)):
        here = leaves.groupBy(*keys[:depth + 1]).agg(F.sum("_tokens").alias("_tokens")) \
            .withColumn("_limit", F.col("_tokens").cast("double") * max_epochs) \
            .withColumn("_w", _weight(levels, depth, weights or {}, alpha))
        here = here.withColumn("_own", F.lit(float(budget))) if nodes is None else here.join(nodes, keys[:depth])
        parent = keys[:depth] or [F.lit(0)]
        ratio = F.when(F.col("_w") > 0, F.col("_limit") / F.col("_w")).otherwise(F.lit(float("inf")))
        here = here.withColumn("_ratio", ratio)
        order = Window.partitionBy(*parent).orderBy("_ratio", *keys[depth:depth + 1]).rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*parent)
        here = here.withColumn("_taken", F.coalesce(F.sum("_limit").over(order), F.lit(0.0))) \
            .withColumn("_rest", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(order), F.lit(0.0)))
        level = F.when(F.col("_rest") > 0, (F.col("_own") - F.col("_taken")) / F.col("_rest"))
        here = here.withColumn("_full", (F.col("_w") > 0) & (F.col("_ratio") <= level))
        # what the full ones leave is shared by the others
        left = F.col("_own") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_limit"))).over(whole), F.lit(0.0))
        open_w = F.sum(F.when(~F.col("_full"), F.col("_w"))).over(whole)
        share = F.when(F.col("_full"), F.col("_limit")).when(open_w > 0, F.least("_limit", F.col("_w") * left / open_w)).otherwise(F.lit(0.0))
        here = here.withColumn("_budget", share)
        nodes = here.select(*keys[:depth + 1], F.col("_budget").alias("_own"))
    return here.select(*keys, "_tokens", F.round("_budget").cast("long").alias("_budget"))


def mix(docs: DataFrame, levels: dict[str, Column], budget: float | None = None, max_epochs: int = 2,
        weights: dict[str, dict[str, float]] | None = None, alpha: float = 0.7, seed: int = 17,
        id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """The columns of ``docs`` plus ``epoch`` and ``n_tokens``: the mixed rows, one per copy taken.

    ``levels`` maps level names (root first) to columns; null names are one
    group of their own.  ``budget`` is in tokens (default: what the table
    holds).  A row's tokens are its words unless ``tokens`` is given.  A leaf
    takes of its last epoch the rows up to its budget, the row that crosses
    it if at least half of its tokens still fit.
    A leaf whose rows hold no token keeps each row once.  Equal rows share
    their place in the order and are taken together; columns named as the two
    new ones are replaced; an empty table gives an empty one.
    """
    names = list(levels)
    keys = [f"_l{k}" for k in range(len(names))]
    count = F.coalesce(tokens if tokens is not None else F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    marked = docs.select(F.struct(*docs.columns).alias("row"), *[F.coalesce(c.cast("string"), F.lit("\x00null")).alias(k) for k, c in zip(keys, levels.values())],
                         F.xxhash64(id_col, text_col).alias("_h"), count.alias("_n"))
    rows = written(marked.select(*keys, "_h", "_n"), "mix_rows")
    leaves = written(rows.groupBy(*keys).agg(F.sum("_n").alias("_tokens")), "mix_leaves")
    total = budget if budget is not None else float(leaves.agg(F.sum("_tokens")).first()[0] or 0)
    shares = leaf_budgets(leaves, names, total, max_epochs, weights, alpha)
    shares = shares.withColumn("_epochs", F.when(F.col("_tokens") > 0, F.least(F.lit(max_epochs), F.expr("_budget div greatest(_tokens, 1)"))).otherwise(F.lit(1)).cast("int")) \
        .withColumn("_left", F.when(F.col("_tokens") > 0, F.greatest(F.lit(0), F.col("_budget") - F.col("_epochs") * F.col("_tokens"))).otherwise(F.lit(0)))
    shares = written(shares, "mix_shares")
    few = shares.count() <= BROADCAST_LEAVES
    small = (lambda t: F.broadcast(t)) if few else (lambda t: t)

    # the last row of each leaf's prefix: first the hash bucket it lies in, then its place there
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("_epochs") + 1, F.col("_h")), 1)
    buckets = 4 * width(docs.sparkSession)
    step = (1 << 63) // buckets + 1
    cut = rows.join(small(shares.where("_left > 0")), keys).withColumn("_u", place).withColumn("_b", F.expr(f"cast(_u div {step} as int)"))
    sums = cut.groupBy(*keys, "_b").agg(F.sum("_n").alias("_sum"), F.max("_u").alias("_last"), F.first("_left").alias("_left"))
    upto = Window.partitionBy(*keys).orderBy("_b")
    sums = sums.withColumn("_end", F.sum("_sum").over(upto))
    inner = sums.where("_end <= _left").groupBy(*keys).agg(F.max("_last").alias("_mark"))
    border = sums.where("_end > _left and _end - _sum <= _left").select(*keys, "_b", (F.col("_left") - F.col("_end") + F.col("_sum")).alias("_room"))
    inside = cut.select(*keys, "_b", "_u", "_n").join(border, [*keys, "_b"]) \
        .groupBy(*keys, "_b", "_room", "_u").agg(F.sum("_n").alias("_n"))
    run = F.sum("_n").over(Window.partitionBy(*keys, "_b", "_room").orderBy("_u"))
    reached = inside.withColumn("_run", run).where("2 * _run - _n <= 2 * _room").groupBy(*keys).agg(F.max("_u").alias("_mark"))
    marks = inner.union(reached).groupBy(*keys).agg(F.max("_mark").alias("_mark"))
    told = written(shares.join(marks, keys, "left").select(*keys, "_epochs", F.coalesce("_mark", F.lit(-1)).alias("_mark")), "mix_marks")

    copies = F.col("_epochs") + (place <= F.col("_mark")).cast("int")
    taken = marked.join(small(told), keys).withColumn("_copies", copies).where("_copies > 0")
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("epoch", "n_tokens")]
    return taken.select(*kept, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("epoch"), F.col("_n").alias("n_tokens"))


def document_levels() -> dict[str, Column]:
    return {"domain": default_domain(), "language": F.col("lang"), "source": F.col("source")}
