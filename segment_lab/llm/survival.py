"""Filter interaction audit by truth-table survival words.

With five filters a document's verdicts are five bits, and its survival word
has one bit for each of the 32 subsets of filters: set where it passes all of
them.  How many documents of a part survive a subset is a positional
popcount of words, taken by carry-save adders; every order of the filters
and every step of it is then a difference of two such counts.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import giving_back, join_by_size, written

#: The filters in the order of their bits.
FILTERS = "ABCDE"
EVERY = (1 << len(FILTERS)) - 1
SPACE = " \t\n\x0b\f\r"
MARKS = "[#$%&*|]"


# ---------------------------------------------------------------- words and their counts

def survival_words() -> np.ndarray:
    """For each set of failed filters the word of the subsets that it survives."""
    return np.array([sum(1 << s for s in range(EVERY + 1) if not s & failed) for failed in range(EVERY + 1)], np.uint32)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many words have each bit set.

    A full adder makes of three words of one weight one of that weight and
    one of twice it; it runs on whole thirds of the words until at most two
    are left at each weight.
    """
    counts = np.zeros(32, np.int64)
    weight, level = 1, np.asarray(words, np.uint32)
    while len(level):
        carries = []
        while (k := len(level) // 3):
            a, b, c = level[:k], level[k:2 * k], level[2 * k:3 * k]
            half = a ^ b
            carries.append((a & b) | (half & c))
            level = np.concatenate([half ^ c, level[3 * k:]])
        counts += weight * ((level[:, None] >> np.arange(32, dtype=np.uint32)) & 1).sum(axis=0, dtype=np.int64)
        weight, level = 2 * weight, np.concatenate(carries) if carries else level[:0]
    return counts


# ---------------------------------------------------------------- verdicts

def failures(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``(id, part, failed, digest)``: the filters that look at a text alone, and the text's SHA-256."""
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    split = text.withColumn("words", F.split(F.btrim("text", F.lit(SPACE)), r"[\x20\x09-\x0D]+"))
    blank = F.get("words", F.lit(0)) == ""
    sizes = split.withColumn("n", F.when(blank, 0).otherwise(F.size("words"))) \
        .withColumn("kinds", F.when(blank, 0).otherwise(F.size(F.array_distinct("words"))))

    def bit(name: str, fails: Column) -> Column:
        return F.when(fails, F.lit(1 << FILTERS.index(name))).otherwise(F.lit(0))
    n, kinds = F.col("n").cast("long"), F.col("kinds").cast("long")
    return sizes.select(
        "id", "part", (bit("A", n < 100) + bit("B", 100 * kinds < 80 * n)
                       + bit("C", 100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 10 * F.char_length("text").cast("long"))
                       + bit("D", F.col("text").rlike(MARKS))).alias("failed"),
        F.unhex(F.sha2("text", 256)).alias("digest"))


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(part, good, toxic, failed)``, one row per document; ``failed`` has a bit for each of ``FILTERS``.

    The smallest id of each repeated text is found by one aggregate and
    joined back; texts that more than a thousandth of all rows share are
    joined by broadcast (there are fewer than a thousand of them).
    """
    rows = written(failures(docs, id_col, text_col, part_col), "verdicts")
    repeated = written(rows.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("rows")).where("rows > 1"), "repeated_texts")
    known = join_by_size(rows, repeated, "digest", "rows", rows.count())
    copy = F.col("least").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("least")))
    known = known.withColumn("failed", F.col("failed") + F.when(copy, F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0)))
    marks = labels.where("quality = 1 OR toxic = 1").groupBy(F.col(id_col).alias("id")) \
        .agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    # rows without an id have no label and would all meet in one task
    with_id = known.where("id IS NOT NULL").join(marks, "id", "left") \
        .select("part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "failed")
    return with_id.unionByName(known.where("id IS NULL").select("part", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "failed"))


# ---------------------------------------------------------------- survivors

def survivors(rows: DataFrame) -> DataFrame:
    """``(part, n, good, toxic)``: arrays of the 32 subsets' survivors, of all documents and of the labelled ones."""
    table = survival_words()

    def run(batches):
        for b in batches:
            part = b.column("part").dictionary_encode()
            flags = b.column("good").to_numpy(zero_copy_only=False).astype(np.int64) * 2 + b.column("toxic").to_numpy(zero_copy_only=False)
            group = part.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 4 + flags
            words = table[b.column("failed").to_numpy(zero_copy_only=False)]
            order = np.argsort(group, kind="stable")
            seen, first = np.unique(group[order], return_index=True)
            if not len(seen):
                continue
            counts = [positional_popcount(w) for w in np.split(words[order], first[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.dictionary.take(pa.array(seen // 4)), pa.array(seen % 4 >= 2), pa.array(seen % 2 == 1), pa.array(counts, pa.list_(pa.int64()))],
                ["part", "good", "toxic", "counts"])

    counted = rows.mapInArrow(giving_back(run), "part string, good boolean, toxic boolean, counts array<long>")
    each = [counted["counts"][s] for s in range(EVERY + 1)]

    def total(which: Column | None) -> Column:
        return F.array(*[F.sum(c if which is None else F.when(which, c).otherwise(0)) for c in each])
    return counted.groupBy("part").agg(total(None).alias("n"), total(F.col("good")).alias("good"), total(F.col("toxic")).alias("toxic"))


def orders() -> list[tuple[str, int, int, int]]:
    """``(filter_order, step, subset before, bit of the step's filter)`` of all orders."""
    out = []
    for p in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(p, 1):
            out.append(("".join(FILTERS[x] for x in p), step, before, 1 << f))
            before |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """What each filter removes at each step of each order, in each part.

    ``(part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley)``, 600 rows a part, zeros included.
    Null texts are empty; null parts are the empty string.  A null id counts
    as larger than every id (its text is a copy if any row with an id has
    it; rows without ids are no copies of each other); rows that share an id
    are no copies of each other.  A document is good or toxic if any of its
    label rows says 1.  No documents give no rows; other columns are not
    read.
    """
    found = survivors(verdicts(docs, labels, id_col, text_col, part_col))
    plan = orders()
    most = len(FILTERS) - 1
    n = lambda at, which="n": F.get(which, at)

    def shapley(bit: int) -> Column:
        """Removed by the filter over all orders: a subset comes just before it in so many of them."""
        terms = [(n(F.lit(s)) - n(F.lit(s | bit))) * (factorial(s.bit_count()) * factorial(most - s.bit_count()))
                 for s in range(EVERY + 1) if not s & bit]
        return sum(terms[1:], terms[0])
    shares = found.withColumn("shares", F.array(*[shapley(1 << k) for k in range(len(FILTERS))])) \
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(plan) - 1))))
    named = shares.select(
        "part", "n", "good", "toxic", "shares", F.get(F.lit([p[0] for p in plan[::len(FILTERS)]]), F.floor(F.col("k") / len(FILTERS)).cast("int")).alias("filter_order"),
        *[F.get(F.lit([p[at] for p in plan]), F.col("k")).alias(name) for at, name in ((1, "step"), (2, "before"), (3, "bit"))])
    before, after, bit = F.col("before"), F.col("before") + F.col("bit"), F.col("bit")
    removed = n(before) - n(after)
    out = [n(after).alias("kept"), removed.alias("removed"), (n(F.lit(0)) - n(bit) - removed).alias("redundant"),
           (n(F.lit(EVERY) - bit) - n(F.lit(EVERY))).alias("unique_fails"), (n(before, "good") - n(after, "good")).alias("good_lost"),
           (n(before, "toxic") - n(after, "toxic")).alias("toxic_lost"), F.get("shares", F.log2(bit).cast("int")).alias("shapley")]
    return named.select("part", "filter_order", F.col("step").cast("int").alias("step"), *out)
