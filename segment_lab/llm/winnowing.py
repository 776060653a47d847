"""Document fingerprints by winnowing, in DataFrame functions only.

Rolling hashes of K consecutive words are cut into windows of WINDOW hashes;
the smallest hash of each window is kept with its place, the rightmost of
equal ones.  Two texts that share K + WINDOW - 1 consecutive words share a
kept hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import cut_points, sample_values
from .common import width

K = 4
WINDOW = 12
#: A place takes 30 bits (no string holds more words); the other 34 order the hashes.
PLACE_BITS = 30
PLACE_MASK = (1 << PLACE_BITS) - 1
SEPARATORS = r"[\x20\x09-\x0D]+"


def with_fingerprint(df: DataFrame, text_col: str, name: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """Adds ``<name>_at`` (places) and ``<name>_hash`` (their hashes), both arrays in text order.

    A text with fewer than ``k`` words has one hash, that of all its words;
    one without a word has none.  An array is named twice wherever a lambda
    looks into it, which keeps the optimizer from computing it again for
    every element.
    """
    w, g, v, p = (f"_{name}_{x}" for x in "wgvp")
    kept = df.columns
    gram = ", ".join(f"get({w}, i + {j})" for j in range(k))
    out = df.withColumn(w, F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), SEPARATORS), ""))
    out = out.withColumn(g, F.expr(f"CASE WHEN size({w}) = 0 THEN cast(array() AS array<bigint>) "
                                   f"WHEN size({w}) < {k} THEN array(xxhash64(array_join({w}, ' '))) "
                                   f"ELSE transform(sequence(0, size({w}) - {k}), i -> xxhash64({gram})) END"))
    # one number per hash whose minimum is the smallest hash and, of equal ones, the rightmost
    out = out.select(*kept, g, F.expr(f"transform({g}, (x, i) -> (x & ~{PLACE_MASK}L) | ({PLACE_MASK}L - i))").alias(v))
    out = out.withColumn(p, F.expr(f"CASE WHEN size({v}) <= {window} THEN filter(array(array_min({v})), x -> x IS NOT NULL) "
                                   f"ELSE array_distinct(transform(slice({v}, 1, size({v}) - {window - 1}), (x, i) -> array_min(slice({v}, i + 1, {window})))) END"))
    out = out.withColumn(f"{name}_at", F.expr(f"transform({p}, x -> cast({PLACE_MASK}L - (x & {PLACE_MASK}L) AS int))"))
    out = out.withColumn(f"{name}_hash", F.expr(f"transform({name}_at, x -> if(size({g}) > x, get({g}, x), NULL))"))
    return out.select(*kept, f"{name}_at", f"{name}_hash")


def fingerprint_text(name: str) -> Column:
    """A fingerprint as text: ``hash@place`` of each kept hash."""
    return F.array_join(F.zip_with(f"{name}_hash", f"{name}_at", lambda h, p: F.concat(F.lower(F.hex(h)), F.lit("@"), p.cast("string"))), ",")


def likeness(a: str, b: str) -> Column:
    """Shared kept hashes over all kept hashes (1 if neither text has a word)."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text, next_text)`` rows, the next row in ascending id order, after the last the first.

    Ids are cut into ranges of about equal counts; a range is one window
    partition.  The first row of each range is copied, marked, to the end of
    the range before it, so every row finds its successor in its own range.
    Null ids come first; rows with equal ids are ordered by a hash of their
    text.
    """
    ranges = 2 * width(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    cuts = cut_points([r[0] for r in sample_values(own, [F.col("id")], ranges)], ranges)

    # binary search among the cuts: how many of them are smaller than the id
    def further(at, step):
        return F.when((at + step <= len(cuts)) & (F.get(F.lit(cuts), at + step - 1) < F.col("id")), at + step).otherwise(at)
    steps = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)])
    place = F.aggregate(steps, F.lit(0), further) if cuts else F.lit(0)
    marked = own.withColumn("range", place).withColumn("key", F.xxhash64("text")).withColumn("copied", F.lit(False))
    heads = marked.groupBy("range").agg(F.min(F.struct("id", "key")).alias("head"))
    around = Window.orderBy("range")  # over at most ``ranges`` rows
    back = Window.orderBy(F.desc("range"))
    heads = heads.withColumn("to", F.coalesce(F.lag("range").over(around), F.first("range").over(back)))
    heads = heads.select("to", F.col("head.id").alias("h_id"), F.col("head.key").alias("h_key"))
    copies = own.withColumn("key", F.xxhash64("text")).join(F.broadcast(heads), F.col("id").eqNullSafe(F.col("h_id")) & (F.col("key") == F.col("h_key"))) \
        .groupBy("to", "id", "key").agg(F.first("text").alias("text")) \
        .select("id", "text", F.col("to").alias("range"), "key", F.lit(True).alias("copied"))
    return marked.unionByName(copies)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    ``(<id_col>, n_chars, edited, fingerprint, edited_fingerprint,
    near_edited, near_next)``: the edited text has its last floor(n_chars/4)
    code points replaced by the first as many (or all) of the next document.
    Null texts are empty; a single row is its own next.  Repeated rows each
    keep their row; other columns are not read; an empty table gives an
    empty one.
    """
    rows = with_next(docs, id_col, text_col).repartition("range")
    rows = with_fingerprint(rows, "text", "own", k, window)
    line = Window.partitionBy("range").orderBy("copied", F.asc_nulls_first("id"), "key")
    rows = rows.withColumn("next", F.lead(F.struct("text", "own_hash")).over(line)).where("NOT copied")
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    rows = rows.select("id", "text", "own_at", "own_hash", n.cast("long").alias("n_chars"), F.col("next.own_hash").alias("next_hash"),
                       F.concat(F.left("text", n - cut), F.left("next.text", cut)).alias("edited"))
    rows = with_fingerprint(rows, "edited", "changed", k, window)
    return rows.select(F.col("id").alias(id_col), "n_chars", "edited", fingerprint_text("own").alias("fingerprint"),
                       fingerprint_text("changed").alias("edited_fingerprint"),
                       likeness("own_hash", "changed_hash").alias("near_edited"), likeness("own_hash", "next_hash").alias("near_next"))
