"""Prefix trie of conversations with count-min screening of prefix digests.

A prefix is known by a 128-bit digest: the sum, limb by limb, of a hash of
every turn with its place, so digests of all prefixes are running sums and a
very long conversation is no task of its own.  A count-min sketch of all
digests proves most prefixes to be of one conversation: what follows them is
a path of single nodes, written where it lies.  Only prefixes that may be
shared are shuffled and grouped exactly.

Sums over a subtree need no walk of the trie.  Let a conversation lead a
node if it is the node's smallest member; it leads all nodes of its path
from some depth on.  Below that depth its turns are copies, so the words
that sharing saves below a node are those of its members' copied turns; its
children are led by the members that lead at the next depth, and its leaves
are led by the members that lead their own last node, if nothing follows it.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import block, ordinal, running_sums
from .common import giving_back, join_by_size, width, written

#: Rows of the sketch, and the bits of its width at most (a byte a counter: 16 MB in all).
SKETCH_ROWS, SKETCH_BITS = 4, 22
#: Counters of a row that are sent and merged together.
SEGMENT = 1 << 16
#: A counter says 0, 1 or "more".
MORE = 2
LIMBS = [f"limb{k}" for k in range(4)]
SPACE = " \t\n\x0b\f\r"


# ---------------------------------------------------------------- rebuilt conversations

def turn_rows(conversations: DataFrame) -> DataFrame:
    """``(c, pos, digest, words)``: every turn's place in its conversation, digest and number of words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"))
    placed = ordinal(own, "c", ["turn", "role", "text"], "pos", start=0)
    bare = F.btrim("text", F.lit(SPACE))
    return placed.select("c", F.col("pos").cast("long").alias("pos"),
                         F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text")).alias("digest"),
                         F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long").alias("words"))


def rebuilt(turns: DataFrame, stride: int = 20, heads: int = 4) -> DataFrame:
    """``(c, d, len, digest, words)``: first turns of each conversation's base, then its own after as many; depth 0 is the root.

    The base of ``c`` is ``c - c % stride``; as many turns as CRC-32 of the
    decimal ``c`` modulo ``heads`` are taken of it.
    """
    sizes = turns.groupBy("c").agg(F.count("*").alias("n")) \
        .withColumn("h", F.pmod(F.crc32(F.col("c").cast("string")), F.lit(heads)).cast("long")) \
        .withColumn("base", F.col("c") - F.col("c") % stride)
    sizes = written(sizes, "conversation_sizes")
    k = F.least("h", F.coalesce("base_n", F.lit(0)).cast("long"))
    plan = sizes.join(sizes.select(F.col("c").alias("base"), F.col("n").alias("base_n")), "base", "left") \
        .withColumn("k", k).withColumn("len", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    first = turns.where((F.col("c") % stride == 0) & (F.col("pos") < heads - 1)).select(F.col("c").alias("base"), "pos", "digest", "words")
    taken = plan.join(first, "base").where("pos < k").select("c", (F.col("pos") + 1).alias("d"), "len", "digest", "words")
    own = join_by_size(turns, plan.select("c", "n", "h", "k", "len"), "c", "n", turns.count()) \
        .where("pos >= h").select("c", (F.col("k") + F.col("pos") - F.col("h") + 1).alias("d"), "len", "digest", "words")
    root = plan.select("c", F.lit(0).cast("long").alias("d"), "len", F.lit("").alias("digest"), F.lit(0).cast("long").alias("words"))
    return taken.unionByName(own).unionByName(root)


def prefix_rows(path: DataFrame) -> DataFrame:
    """``(c, d, len, words, upto, key, prev)``: words through depth ``d``, digest of the prefix and of the one above."""
    own = F.when(F.col("d") > 0, F.md5(F.concat(F.col("d").cast("string"), F.lit(":"), "digest"))).otherwise(F.lit("0" * 32))
    limbs = path.select("c", "d", "len", "words", *[F.conv(F.substring(own, 8 * k + 1, 8), 16, 10).cast("long").alias(name)
                                                   for k, name in enumerate(LIMBS)])
    summed = running_sums(limbs, "c", "d", {"upto": F.col("words"), **{f"sum_{x}": F.col(x) for x in LIMBS}})

    def key(less: bool) -> Column:
        parts = [F.lpad(F.hex(F.pmod(F.col(f"sum_{x}") - (F.col(x) if less else 0), F.lit(1 << 32))), 8, "0") for x in LIMBS]
        return F.unhex(F.concat(*parts))
    return summed.select("c", "d", "len", "words", "upto", key(False).alias("key"), key(True).alias("prev"))


# ---------------------------------------------------------------- count-min sketch

def cells(keys: pa.Array, bits: int) -> np.ndarray:
    """The counter of each key (columns) in each row of the sketch: a limb of the digest each."""
    keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    raw = b"".join(keys.to_pylist())
    return (np.frombuffer(raw, ">u4").reshape(-1, SKETCH_ROWS).T & ((1 << bits) - 1)).astype(np.int64)


def add_to(sketch: np.ndarray, at: np.ndarray) -> None:
    for row, own in zip(sketch, at):
        cell, n = np.unique(own, return_counts=True)
        row[cell] = np.minimum(row[cell] + np.minimum(n, MORE), MORE)


def build_sketch(prefixes: DataFrame, total: int) -> np.ndarray:
    """Counters (0, 1, more) of all keys, merged a segment at a time; at most 16 MB whatever the input.

    Beyond some millions of prefixes it proves fewer of them alone, and
    more are grouped exactly.
    """
    bits = min(max(int(2 * total).bit_length(), 8), SKETCH_BITS)
    step = min(SEGMENT, 1 << bits)

    def count(batches):
        sketch = np.zeros((SKETCH_ROWS, 1 << bits), np.uint8)
        for b in batches:
            add_to(sketch, cells(b.column("key"), bits))
        parts = sketch.reshape(-1, step)
        held = np.flatnonzero(parts.any(axis=1))
        for k in held.tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(parts[k].tobytes(), 1)], pa.binary())], ["part", "counters"])

    def merge(batches):
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            for k, packed in zip(b.column("part").to_pylist(), b.column("counters").to_pylist()):
                own = np.frombuffer(zlib.decompress(packed), np.uint8)
                parts[k] = np.minimum(parts[k] + own, MORE) if k in parts else own
        for k, own in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], ["part", "counters"])

    schema = "part int, counters binary"
    merged = prefixes.select("key").mapInArrow(giving_back(count), schema).repartition("part").mapInArrow(giving_back(merge), schema)
    sketch = np.zeros((SKETCH_ROWS << bits) // step * step, np.uint8).reshape(-1, step)
    for r in merged.collect():  # at most the sketch itself
        sketch[r["part"]] = np.frombuffer(zlib.decompress(r["counters"]), np.uint8)
    return sketch.reshape(SKETCH_ROWS, -1)


def screen(prefixes: DataFrame, sketch: np.ndarray) -> DataFrame:
    """``prefixes`` with ``alone`` and ``above_alone``: whether the prefix, and the one above it, are proved to be of one conversation."""
    bits = sketch.shape[1].bit_length() - 1
    shared = prefixes.sparkSession.sparkContext.broadcast(sketch)  # at most 16 MB

    def run(batches):
        for b in batches:
            flags = []
            for name in ("key", "prev"):
                at = cells(b.column(name), bits)
                flags.append(pa.array(np.min([row[own] for row, own in zip(shared.value, at)], axis=0) == 1 if at.shape[1] else np.zeros(0, bool)))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in b.schema.names if n != "prev"), *flags],
                                             [*(n for n in b.schema.names if n != "prev"), "alone", "above_alone"])
    return prefixes.mapInArrow(run, "c long, d long, len long, words long, upto long, key binary, alone boolean, above_alone boolean")


# ---------------------------------------------------------------- exact groups

def ends_of(shared: DataFrame) -> DataFrame:
    """``(key, ends_sha256)`` of the nodes at which members end: the hash of their ids, taken in one pass over id blocks.

    Ids are joined inside blocks of an id range first; the hash of a node
    then reads one row a block, in order, and holds one block at a time.
    """
    last = shared.where("d = len").select("key", "c")
    lists = last.withColumn("range", block(last, ["c"], 4 * width(last.sparkSession))).groupBy("key", "range") \
        .agg(F.array_join(F.array_sort(F.collect_list("c")).cast("array<string>"), ",").alias("ids"))

    def run(batches):
        key = digest = None
        for b in batches:
            keys, out = [], []
            for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist()):
                if k == key:
                    digest.update(b"," + ids.encode())
                    continue
                if key is not None:
                    keys.append(key)
                    out.append(digest.hexdigest())
                key, digest = k, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["key", "ends_sha256"])

    return lists.repartition("key").sortWithinPartitions("key", "range").mapInArrow(run, "key binary, ends_sha256 string")


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def trie(conversations: DataFrame, stride: int = 20, heads: int = 4) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations.

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256)`` as the contract names them.  Turns are
    ordered by turn (null first), then role and text; null roles and texts
    are empty.  Rows without a conv_id belong to no conversation.  Repeated
    rows are turns of their own.  No conversations give no rows; other
    columns are not read.
    """
    turns = written(turn_rows(conversations), "turns")
    prefixes = written(prefix_rows(rebuilt(turns, stride, heads)), "prefixes")
    total = prefixes.count()
    screened = written(screen(prefixes, build_sketch(prefixes, total)), "screened")
    shared, tails = screened.where("NOT alone"), screened.where("alone")

    groups = written(shared.groupBy("key").agg(F.min("c").alias("leader"), F.count("*").alias("n"), F.max("len").alias("longest")), "prefix_groups")
    led = written(join_by_size(shared, groups, "key", "n", total), "led_prefixes")
    copied = F.col("leader") != F.col("c")
    conversation = led.groupBy("c").agg(
        F.coalesce(F.max(F.when(copied, F.col("d"))) + 1, F.lit(0)).alias("leads_from"),
        F.coalesce(F.max(F.when(copied, F.col("upto"))), F.lit(0)).alias("copied_words"),
        F.max_by("leader", F.when(copied, F.col("d"))).alias("above"),
        # a last node that was proved alone is a leaf of its own
        F.coalesce(F.max(F.when(F.col("d") == F.col("len"), (F.col("longest") == F.col("len")) & ~copied)), F.lit(True)).alias("leaf"),
        F.count("*").alias("rows"))
    conversation = written(conversation, "conversation_shares")
    parent = F.when(F.col("d") == 0, F.lit(None)).when(F.col("leads_from") < F.col("d"), F.col("c")).otherwise(F.col("above"))

    def total_of(x: Column) -> Column:
        return F.sum(x.cast("long"))
    nodes = join_by_size(led, conversation, "c", "rows", total).groupBy("key").agg(
        F.min("c").alias("conv_id"), F.min("d").alias("depth"), F.max(F.when(~copied, parent)).alias("parent_conv_id"), F.count("*").alias("n_convs"),
        total_of((F.col("len") > F.col("d")) & (F.col("leads_from") <= F.col("d") + 1)).alias("n_children"), total_of(F.col("leaf")).alias("n_leaves"),
        total_of(F.when(F.col("leads_from") > F.col("d"), F.col("copied_words") - F.col("upto") + F.col("words")).otherwise(0)).alias("saved_tokens"))
    none = F.sha2(F.lit(""), 256)
    nodes = nodes.join(ends_of(shared), "key", "left").select(*NODE, F.coalesce("ends_sha256", none).alias("ends_sha256"))

    def single(rows: DataFrame, above: Column) -> DataFrame:
        end = F.when(F.col("d") == F.col("len"), F.sha2(F.col("c").cast("string"), 256)).otherwise(none)
        one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
        return rows.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), above.alias("parent_conv_id"), one.alias("n_convs"),
                           (F.col("len") > F.col("d")).cast("long").alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), end.alias("ends_sha256"))
    inner = single(tails.where("above_alone"), F.when(F.col("d") > 0, F.col("c")))
    first = single(tails.where("NOT above_alone").join(conversation, "c"), parent)
    return nodes.unionByName(inner).unionByName(first)
