"""Prefix trie of rebuilt conversations by whole-sequence collapse.

Turns are numbered within their conversation, every conversation is rebuilt on the head of another one, and a prefix is known by its depth and
128 bits: the xor of the hashes of its (position, role, text). Such a key of a prefix follows from that of the prefix before and can be carried over
slices of a conversation, so no task needs a conversation whole.

1. Collapse: conversations with equal whole sequences become one sequence with a weight and a list of ends. Only one of them is expanded.
2. Leaves: sequences that are a proper prefix of another one go by anti-join; the others are the leaves.
3. Weighted prefixes: every prefix of a sequence is a row, and rows of equal prefixes add up. Sums over a subtree need no walk: the words of all members
   from a node on are their totals less what lies before the node; the words of the distinct nodes below are dealt to the sequence with the smallest
   conversation that passes them, which owns the tail of its path from some depth on.

Turns are ordered by turn, null first, then by role and text. Null role and text are empty. Rows without conv_id take no part. Repeated rows are turns
of their own. An empty table has no nodes. Other columns are ignored.

A conversation may hold any share of the rows: rows are dealt into slices by (conv_id, turn, start of the text), and what is carried from slice to
slice is a row per conversation and slice. Lists of ends travel in chunks of CHUNK ids.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modiste.llm.common import stored

C = F.col
WORD = r"[^\x20\x09-\x0D]+"
#: characters of role and text that decide the slice of a turn
START = 64
#: ids of a chunk of a list of ends
CHUNK = 512
KEY = ["depth", "x1", "x2"]


def xored(a: str, b: str) -> Column:
    return C(a).bitwiseXOR(C(b))


def preceding(column: Column, over) -> Column:
    """What a running total has before the current row; `column` is null where there is none."""
    return F.coalesce(column.over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, slice, at, r1, r2, words): hashes and words of each turn, and its place from 1 in its conversation."""
    text = F.concat(F.coalesce("role", F.lit("")), F.lit("\0"), F.coalesce("text", F.lit("")))
    rows = conversations.where("conv_id IS NOT NULL").select(C("conv_id").cast("long").alias("conv_id"), "turn", text.alias("said"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("conv_id", C("turn").asc_nulls_first(), F.left("said", F.lit(START)))
    dealt = dealt.sortWithinPartitions("conv_id", C("turn").asc_nulls_first(), "said")
    turns = stored(dealt.select("conv_id", F.spark_partition_id().alias("slice"), F.monotonically_increasing_id().alias("nr"), F.xxhash64("said").alias("r1"),
                                F.xxhash64(F.lit(1), "said").alias("r2"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")), "turns")
    runs = stored(turns.groupBy("conv_id", "slice").agg(F.min("nr").alias("first"), F.count(F.lit(1)).alias("n")), "turn-runs")
    starts = runs.withColumn("before", preceding(F.sum("n"), Window.partitionBy("conv_id").orderBy("slice")))
    # rows of a conversation in a slice stand next to each other
    return turns.join(starts, ["conv_id", "slice"]).select("conv_id", "slice", (C("nr") - C("first") + C("before") + 1).alias("at"), "r1", "r2", "words")


def rebuilt(turns: DataFrame, ids: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, slice, depth, words, k1, k2): the turns of each conversation c of `ids` (conv_id, n) rebuilt: the first h turns of conversation
    c - c % every, then its own after its first h; h is crc32(c) % most. k1 and k2 are the hashes of the turn at its depth."""
    plan = ids.select("conv_id", (C("conv_id") - C("conv_id") % every).alias("base"), (F.crc32(C("conv_id").cast("string").cast("binary")) % most).alias("h"))
    plan = plan.join(ids.select(C("conv_id").alias("base"), C("n").alias("there")), "base", "left")
    plan = stored(plan.select("conv_id", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken")), "rebuilding")
    own = turns.join(plan.drop("base"), "conv_id").where("at > h").select("conv_id", "slice", (C("at") - C("h") + C("taken")).alias("depth"), "r1", "r2", "words")
    heads = turns.where((C("at") < most) & (C("conv_id") % every == 0)).select(C("conv_id").alias("base"), C("at").alias("depth"), "r1", "r2", "words")
    taken = plan.where("taken > 0").join(heads, "base").where("depth <= taken").select("conv_id", F.lit(-1).alias("slice"), "depth", "r1", "r2", "words")
    return own.unionByName(taken).select("conv_id", "slice", "depth", "words", F.xxhash64("depth", "r1").alias("k1"), F.xxhash64("depth", "r2").alias("k2"))


def sequences(turns: DataFrame, runs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(depth, x1, x2, rep, weight, total): the distinct whole sequences, with their smallest conversation, their number and their words; and the
    key of every conversation."""
    whole = runs.groupBy("conv_id").agg(F.sum("n").alias("depth"), F.bit_xor("k1").alias("x1"), F.bit_xor("k2").alias("x2"), F.sum("words").alias("total"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in (*KEY, "total")]
    ended = stored(ids.select("conv_id").join(whole, "conv_id", "left").select("conv_id", *zero), "whole-sequences")
    return stored(ended.groupBy(*KEY).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.max("total").alias("total")), "sequences"), ended


def prefixes(turns: DataFrame, runs: DataFrame, seqs: DataFrame) -> DataFrame:
    """A row for each prefix but the empty one of each sequence: its key, the key of the prefix before (depth - 1, u1, u2) and the words before its last turn."""
    by_slice = Window.partitionBy("conv_id").orderBy("slice")
    starts = runs.join(seqs.select(C("rep").alias("conv_id"), "weight", "total"), "conv_id")
    starts = starts.select("conv_id", "slice", "weight", "total", *[preceding(f(c), by_slice).alias(f"s_{c}") for f, c in ((F.bit_xor, "k1"), (F.bit_xor, "k2"), (F.sum, "words"))])
    own = Window.partitionBy("conv_id", "slice").orderBy("depth")
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = turns.join(starts, ["conv_id", "slice"])
    rows = rows.select(C("conv_id").alias("rep"), "weight", "total", "depth", "words", "k1", "k2", F.bit_xor("k1").over(so_far).bitwiseXOR(C("s_k1")).alias("x1"),
                       F.bit_xor("k2").over(so_far).bitwiseXOR(C("s_k2")).alias("x2"), (preceding(F.sum("words"), own) + C("s_words")).alias("before"))
    return rows.select("rep", "weight", "total", *KEY, xored("x1", "k1").alias("u1"), xored("x2", "k2").alias("u2"), "before")


def end_lists(ended: DataFrame) -> DataFrame:
    """(depth, x1, x2, first, ids): the conversations that end at a node in ascending order, in chunks of at most CHUNK; `first` orders the chunks."""

    def chunk(batches):
        key, ids = None, []
        out: list[tuple] = []
        schema = pa.schema([("depth", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64()), ("first", pa.int64()), ("ids", pa.list_(pa.int64()))])
        for batch in batches:
            for *k, i in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (k != key or len(ids) == CHUNK):
                    out.append((*key, ids[0], ids))
                    ids = []
                key = k
                ids.append(i)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, ids[0], ids), schema)], schema=schema)

    dealt = ended.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    return dealt.mapInArrow(chunk, "depth long, x1 long, x2 long, first long, ids array<long>")


def end_digests(lists: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256): chunks of a list go through the digest one after the other, so a list of any length is never held."""

    def digest(batches):
        key, sha = None, None
        schema = pa.schema([("depth", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64()), ("ends_sha256", pa.string())])
        for batch in batches:
            out = []
            for *k, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha, comma = k, hashlib.sha256(), b""
                sha.update(comma + ",".join(map(str, ids)).encode())
                comma = b","
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, sha.hexdigest()), schema)], schema=schema)

    return lists.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, "depth long, x1 long, x2 long, ends_sha256 string")


def nodes_of(rows: DataFrame, seqs: DataFrame) -> DataFrame:
    """(depth, x1, x2, u1, u2, conv_id, n_convs, n_leaves, saved_tokens) of every node; the root has no u1 and u2."""
    key = ["depth", "x1", "x2"]
    found = rows.groupBy(*key).agg(F.min("u1").alias("u1"), F.min("u2").alias("u2"), F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum(C("weight") * (C("total") - C("before"))).alias("all_words"))
    found = stored(found, "nodes")
    inner = found.select((C("depth") - 1).alias("depth"), C("u1").alias("x1"), C("u2").alias("x2")).distinct()
    leaves = seqs.join(inner, key, "left_anti").select("rep", F.lit(1).alias("leaf"))
    # a sequence owns the nodes whose smallest conversation it is: all from `owned` words on
    owned = rows.join(found.select(*key, "conv_id"), key).where("rep = conv_id").groupBy("rep").agg(F.min("before").alias("owned"))
    seqs = seqs.join(leaves, "rep", "left").join(owned, "rep", "left").select("rep", "weight", "total", F.coalesce("leaf", F.lit(0)).alias("leaf"), "owned")
    seqs = stored(seqs, "leaves")
    below = rows.select(*key, "rep", "before").join(seqs, "rep").groupBy(*key).agg(F.sum("leaf").alias("n_leaves"), F.sum(F.when(C("owned").isNotNull(), C("total") - F.greatest("before", "owned")).otherwise(0)).alias("words"))
    rest = found.join(below, key).select(*key, "u1", "u2", "conv_id", "n_convs", "n_leaves", (C("all_words") - C("words")).alias("saved_tokens"))
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    words = F.sum(C("weight") * C("total")) - F.sum(F.when(C("owned").isNotNull(), C("total") - C("owned")).otherwise(0))
    root = seqs.agg(F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"), words.alias("saved_tokens")).where("conv_id IS NOT NULL")
    return rest.unionByName(root.select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), none.alias("u1"), none.alias("u2"), "conv_id", "n_convs", "n_leaves", "saved_tokens"))


def trie(conversations: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """The nodes: (depth, x1, x2, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens), and the lists of ends of those that have any.

    conv_id is the smallest member; saved_tokens the words a subtree needn't repeat: those of a node's last text for every member but one."""
    turns = stored(numbered(conversations), "numbered-turns")
    ids = stored(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "conversations")
    turns = stored(rebuilt(turns, ids, every, most), "rebuilt-turns")
    runs = stored(turns.groupBy("conv_id", "slice").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2"), F.sum("words").alias("words")), "rebuilt-runs")
    seqs, ended = sequences(turns, runs, ids)
    nodes = stored(nodes_of(stored(prefixes(turns, runs, seqs), "prefixes"), seqs), "trie")
    kids = nodes.where("u1 IS NOT NULL").groupBy((C("depth") - 1).alias("depth"), C("u1").alias("x1"), C("u2").alias("x2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")
    above = nodes.where("n_children > 0").select((C("depth") + 1).alias("depth"), C("x1").alias("u1"), C("x2").alias("u2"), C("conv_id").alias("parent_conv_id"))
    out = nodes.join(above, ["depth", "u1", "u2"], "left").select(*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return out, end_lists(ended)


def described(conversations: DataFrame, **how) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    nodes, lists = trie(conversations, **how)
    digests = stored(end_digests(lists), "end-digests")
    out = nodes.join(digests, KEY, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
