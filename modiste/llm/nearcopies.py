"""Near-dedup by word shingles: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked.

Documents with equal sets count once from there on. Candidates come from the byte-position index of SimHash fingerprints (`simhash.py`, over the same
five-word shingles), and since two bits miss most pairs of that similarity, also from bands of ROWS of BANDS x ROWS minima of hash functions: at a
similarity of 0.8 a pair has none in common with a chance of 3 in a million, at 0.9 of less than one in 10^12. Nothing is linked before its sets have
been compared exactly.

1. Fingerprints that are equal or differ in two bits at most are compared along the links of the index, and every member of a band with the band's first
   one: as many pairs as members.
2. Candidates that overlap make a cluster. A cluster whose members the links so far connect is settled, which is what becomes of a group of near copies of
   one text. The sets of the other clusters are dealt by hash into blocks of about BLOCK sets or BLOCK_BYTES bytes, and blocks meet blocks but for those
   that are connected already. A task counts the common shingles of all pairs of two blocks by matrix products and passes on links that span what it
   has found, so rows follow the blocks and not the pairs. Every pair of a cluster is compared, whatever its size.

Words are those of SimHash (ASCII white space, A-Z in lower case); a text of fewer than five words is one shingle, texts without words are
equal. Rows that repeat a doc_id are one document, rows without a doc_id stay and take nothing away.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modiste.llm.common import give_back, in_runs, stored, texts_of
from modiste.llm.components import components
from modiste.llm.simhash import fingerprints_of, hashes_of, near_links, spanning
from modiste.scale import within, without

BANDS, ROWS = 32, 5
#: shingles whose minima are taken at once
RUN = 4096
#: sets and bytes of sets of a block, about
BLOCK, BLOCK_BYTES = 256, 8 << 20
#: a shingle in up to so many sets of two blocks is counted pair by pair, others by matrix products of so many columns
RARE, COLUMNS = 12, 2048
_random = np.random.default_rng(77)
FLIP = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
TIMES = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
BAND = _random.integers(0, 1 << 63, BANDS, dtype=np.uint64)
MIX = np.uint64(0x9FB21C651E98DF25)
SIGNED = T.StructType([T.StructField("h", T.LongType()), T.StructField("g", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def shingles(text: bytes, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(hashes_of(text, width))


def bands_of(found: np.ndarray) -> np.ndarray:
    """A key for each band of the minima of a set of hashes."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    own = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(own), RUN):
        mixed = (own[at : at + RUN, None] ^ FLIP) * TIMES
        mixed ^= mixed >> np.uint32(15)
        np.minimum(least, (mixed * np.uint32(0x85EBCA6B)).min(0), out=least)
    key = BAND.copy()
    for column in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = (key ^ column) * MIX
        key ^= key >> np.uint64(29)
    return key


def signed(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, h, g, fp, bands): 128 bits for the set of a text's shingles, the text's fingerprint, and its band keys."""

    @F.arrow_udf(SIGNED)
    @in_runs
    def sign(texts: pa.Array) -> pa.Array:
        h, g, bands = [], [], []

        def hashes():
            for text in texts_of(texts):
                own = hashes_of(text, width)
                found = np.unique(own)
                data = found.tobytes()
                h.append(xxhash.xxh64_intdigest(data, 1))
                g.append(xxhash.xxh64_intdigest(data, 2))
                bands.append(bands_of(found) if len(found) else found)
                yield own

        fp = fingerprints_of(len(texts), hashes())
        long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
        flat = np.concatenate(bands).view(np.int64) if bands else np.empty(0, np.int64)
        return pa.StructArray.from_arrays([long(h), long(g), long(fp), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["h", "g", "fp", "bands"])

    return docs.select("doc_id", sign("text").alias("s")).select("doc_id", "s.*")


@F.arrow_udf(T.BooleanType())
def alike(a: pa.Array, b: pa.Array, tenths: pa.Array) -> pa.Array:
    """Whether two sets of hashes have a Jaccard similarity of so many tenths or more."""
    out = []
    for x, y, t in zip(a, b, tenths.to_pylist()):
        x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(10 * both >= t * (len(x) + len(y) - both))
    give_back()
    return pa.array(out, pa.bool_())


def sets_of(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, set) of the documents that are nodes, the hashes as bytes. Texts that a bitmap of the nodes rules out aren't shuffled."""

    @F.arrow_udf(T.BinaryType())
    @in_runs
    def packed(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(text, width).tobytes() for text in texts_of(texts)], pa.binary())

    wanted = stored(nodes.select(F.col("node").alias("doc_id")).distinct(), "wanted-ids")
    return within(docs, wanted, ["doc_id"]).select(F.col("doc_id").alias("node"), packed("text").alias("set"))


def common_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each pair of sets has in common."""
    n = len(sets)
    shingle, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(shingle, kind="stable")
    shingle, owner = shingle[order], owner[order]
    starts = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
    held = np.diff(np.r_[starts, len(shingle)])
    counts = np.zeros(n * n, np.int64)
    rare, common = starts[(held > 1) & (held <= RARE)], starts[held > RARE]
    size = held[(held > 1) & (held <= RARE)]
    for step in range(1, RARE):
        for first in range(RARE - step):
            at = rare[size > first + step] + first
            counts += np.bincount(owner[at] * n + owner[at + step], minlength=n * n)
    counts = counts.reshape(n, n)
    counts = counts + counts.T
    size = held[held > RARE]
    for at in range(0, len(common), COLUMNS):
        part, k = common[at : at + COLUMNS], size[at : at + COLUMNS]
        held_by = np.zeros((n, len(part)), np.float32)
        nth = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        held_by[owner[np.repeat(part, k) + nth], np.repeat(np.arange(len(part)), k)] = 1
        counts += np.rint(held_by @ held_by.T).astype(np.int64)
    return counts


def linked(batches, tenths: int):
    """Spanning links of each pair of blocks; rows (cluster, i, j, node, set) come sorted by the first three, and a pair may go on in the next batch."""
    key, nodes, sets = None, [], []

    def links():
        size = np.array([len(x) for x in sets])
        both = common_shingles(sets)
        a, b = np.nonzero(np.triu(10 * both >= tenths * (size[:, None] + size[None, :] - both), 1))
        label = spanning(len(sets), a, b)
        tied = np.flatnonzero(label != np.arange(len(sets)))
        ids = np.array(nodes, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[label[tied]]), pa.array(ids[tied])], ["a", "b"])

    for batch in batches:
        for *k, node, data in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4)):
            if k != key:
                if len(sets) > 1:
                    yield links()
                key, nodes, sets = k, [], []
            nodes.append(node)
            sets.append(np.frombuffer(data.as_buffer(), np.uint64).copy())
    if len(sets) > 1:
        yield links()
    give_back()


def block_links(docs: DataFrame, stars: DataFrame, root: DataFrame, width: int, tenths: int) -> DataFrame:
    """(a, b): links within the clusters that `stars` make and the roots so far don't settle."""
    cluster = components(stars)
    cluster = cluster.union(cluster.select("root", "root").distinct()).toDF("node", "cluster")
    member = stored(cluster.join(root, "node", "left").select("cluster", "node", F.coalesce("root", "node").alias("root")), "cluster-members")
    open_ = stored(member.groupBy("cluster").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("cluster"), "open-clusters")
    member = stored(member.join(open_, "cluster"), "open-members")
    # an id that repeats brings all its sets, each dealt by itself
    sets = stored(sets_of(docs, member.select("node"), width).withColumn("digest", F.xxhash64("set")).dropDuplicates(["node", "digest"]), "sets")
    member = stored(sets.select("node", "digest", F.octet_length("set").alias("size")).join(member, "node"), "sized-members")
    sizes = member.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int").alias("n"))
    dealt = member.join(stored(sizes, "cluster-sizes"), "cluster").select("cluster", "node", "digest", "root", "n", F.pmod(F.xxhash64("node", "digest"), "n").cast("int").alias("i"))
    dealt = stored(dealt, "dealt-members")
    blocks = stored(dealt.groupBy("cluster", "i").agg(F.max("n").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")), "blocks")
    left = blocks.select("cluster", "i", "low", "high", F.explode(F.sequence(F.col("i"), F.col("n") - 1)).alias("j"))
    pairs = left.join(blocks.select("cluster", F.col("i").alias("j"), F.col("low").alias("low2"), F.col("high").alias("high2")), ["cluster", "j"])
    pairs = stored(pairs.where(F.least("low", "low2") != F.greatest("high", "high2")).select("cluster", "i", "j"), "block-pairs")
    ends = pairs.select("cluster", "i", "j", F.col("i").alias("of")).unionByName(pairs.where("i <> j").select("cluster", "i", "j", F.col("j").alias("of")))
    held = dealt.select("cluster", "node", "digest", F.col("i").alias("of")).join(ends, ["cluster", "of"]).select("node", "digest", "cluster", "i", "j")
    rows = stored(held, "block-members").join(sets, ["node", "digest"]).select("cluster", "i", "j", "node", "set")
    return rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(lambda batches: linked(batches, tenths), "a long, b long")


def fingerprint_stars(first: DataFrame) -> DataFrame:
    """(a, b): candidates by fingerprint, the smaller node first."""
    marked = first.where(F.size("bands") > 0).select("fp", F.col("a").alias("node"))
    distinct = stored(marked.groupBy("fp").agg(F.min("node").alias("first")), "distinct-fingerprints")
    equal = marked.join(distinct, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    close = near_links(distinct).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return equal.union(close)


def links(docs: DataFrame, signs: DataFrame, width: int, tenths: int) -> DataFrame:
    """(a, b): enough links of at least that similarity to connect whatever is connected by all of them."""
    known = signs.where("doc_id IS NOT NULL")
    least = F.min(F.struct("doc_id", "fp"))
    first = stored(known.groupBy("h", "g").agg(least["doc_id"].alias("a"), least["fp"].alias("fp"), F.first("bands").alias("bands")), "shingle-sets")
    # a repeated doc_id is one document, whatever its sets
    found = stored(first.select("h", "g", "a").join(known.select("h", "g", "doc_id"), ["h", "g"]).where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct(), "equal-sets")
    keyed = stored(first.select(F.col("a").alias("node"), F.explode("bands").alias("band")).distinct(), "bands")
    hubs = stored(keyed.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "hub"), "hubs")
    met = keyed.join(hubs, "band").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    stars = stored(met.union(fingerprint_stars(first)).distinct(), "stars")
    sets = stored(sets_of(docs, stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct(), width), "star-sets")
    met = stars.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    near = stored(met.where(alike("x", "y", F.lit(tenths))).select("a", "b").distinct(), "star-links")
    root = stored(components(found.union(near)), "near-roots")
    more = stored(block_links(docs, stars, root, width, tenths), "block-links")
    return root.select(F.col("root").alias("a"), F.col("node").alias("b")).union(more)


def deduplicated(docs: DataFrame, width: int = 5, tenths: int = 8) -> DataFrame:
    """The documents that are the first of those they are connected to; rows without a doc_id stay."""
    signs = stored(signed(docs, width), "signed")
    gone = components(links(docs.select("doc_id", "text"), signs, width, tenths)).select(F.col("node").alias("doc_id"))
    return without(docs, stored(gone.distinct(), "near-copies"), ["doc_id"])
