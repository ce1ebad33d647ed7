"""SimHash near-dedup over a byte-position inverted index with count filtering.

A fingerprint has eight bytes; two fingerprints that differ in at most two bits share at least six of the eight (position, byte) pairs. The
postings are kept for every choice of six positions, 28 a fingerprint, so sharing a list is reaching the guaranteed count: pairs with
fewer matches never meet, where lists of single bytes would each hold a 256th of all fingerprints and be tallied in quadratic
time. Members of a list differ in two bytes at most, which bounds a list to 65,536 distinct fingerprints, whatever the data; each pair
in it is verified by its bits. A list passes on a spanning set of its links, never all pairs.

Copies share a fingerprint and count once from there on. Null and empty texts have the fingerprint zero. Rows that repeat a doc_id are
one document. A row without doc_id gets the component of its fingerprint, which is null if no row with a doc_id has it.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modiste.llm.common import in_runs, stored, texts_of
from modiste.llm.components import components

SEED = 42
#: shingles whose bits are counted at once
RUN = 1 << 17
#: lists up to this size are compared pair by pair, longer ones by flipping bits
SHORT = 128


def hashes_of(text: bytes, width: int) -> np.ndarray:
    words = text.lower().split()  # of bytes: A-Z and ASCII white space
    if len(words) < width:
        words, width = [b" ".join(words)] if words else [], 1
    runs = zip(*(words[i:] for i in range(width)))
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(SEED)), np.uint64, max(0, len(words) - width + 1))


def fingerprints(texts: list[bytes], width: int = 3) -> np.ndarray:
    """Bit i is set if it is set in over half of the text's shingle hashes."""
    return fingerprints_of(len(texts), (hashes_of(text, width) for text in texts))


def fingerprints_of(n_texts: int, hashes: Iterable[np.ndarray]) -> np.ndarray:
    """The same from the hashes of each text, which are held for a run of texts at a time."""
    out = np.zeros(n_texts, np.uint64)
    rows: list[int] = []
    held: list[np.ndarray] = []

    def count() -> None:
        n = np.array([len(h) for h in held])
        total = np.zeros((len(held), 64), np.int64)
        flat, owner = np.concatenate(held), np.repeat(np.arange(len(held)), n)
        for at in range(0, len(flat), RUN):
            bits = np.unpackbits(flat[at : at + RUN].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            own = owner[at : at + RUN]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            total[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[rows] = np.packbits(2 * total > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
        rows.clear()
        held.clear()

    size = 0
    for i, h in enumerate(hashes):
        if len(h):
            rows.append(i)
            held.append(h)
            size += len(h)
        if size >= RUN:
            count()
            size = 0
    if held:
        count()
    return out


def fingerprinted(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp); fp is the fingerprint as a signed long."""

    @F.arrow_udf(T.LongType())
    @in_runs
    def fp(texts: pa.Array) -> pa.Array:
        return pa.array(fingerprints(texts_of(texts), width).view(np.int64))

    return docs.select("doc_id", fp("text").alias("fp"))


def masks(max_bits: int) -> list[int]:
    """Masks of the byte positions in a list's key, as signed longs: all ways to leave `max_bits` bytes out."""
    full = (1 << 64) - 1
    return [int(np.uint64(full & ~sum(0xFF << (8 * p) for p in left)).astype(np.int64)) for left in combinations(range(8), max_bits)]


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it is connected to by the pairs (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def close_pairs(fp: np.ndarray, group: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of fingerprints of one group that differ in at most `max_bits` bits. Rows are sorted by (group, fp) and distinct."""
    size = np.bincount(group)[group]
    start = np.searchsorted(group, group)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    short = np.flatnonzero(size <= SHORT)
    for d in range(1, SHORT):
        i = short[short - start[short] >= d]
        if not len(i):
            break
        near = np.bitwise_count(fp[i] ^ fp[i - d]) <= max_bits
        found.append((i[near], i[near] - d))
        short = i
    for g in np.unique(group[size > SHORT]):
        at = np.flatnonzero(group == g)
        own = fp[at]
        free = np.bitwise_or.reduce(own ^ own[0])
        bits = [np.uint64(1 << p) for p in range(64) if int(free) >> p & 1]
        for r in range(1, max_bits + 1):
            for flips in combinations(bits, r):
                other = own ^ np.bitwise_or.reduce(np.array(flips))
                to = np.minimum(np.searchsorted(own, other), len(own) - 1)
                hit = np.flatnonzero((own[to] == other) & (other < own))
                found.append((at[hit], at[to[hit]]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def linked(batches, max_bits: int):
    """Spanning links of each list; rows come sorted by (list, key, fp), and a list may go on in the next batch."""
    kept = None

    def links(rows: list[np.ndarray], whole: int):
        which, key, fp, first = (x[:whole] for x in rows)
        new = np.r_[True, (which[1:] != which[:-1]) | (key[1:] != key[:-1])]
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        fp, first, group = fp[many].view(np.uint64), first[many], group[many]
        if not len(fp):
            return None
        order = np.lexsort((fp, group))
        fp, first, group = fp[order], first[order], np.unique(group[order], return_inverse=True)[1]
        a, b = close_pairs(fp, group, max_bits)
        label = spanning(len(fp), a, b)
        tied = np.flatnonzero(label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(first[tied]), pa.array(first[label[tied]])], ["a", "b"])

    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        rows = rows if kept is None else [np.concatenate(x) for x in zip(kept, rows)]
        which, key = rows[0], rows[1]
        last = np.flatnonzero((which[1:] != which[:-1]) | (key[1:] != key[:-1]))
        whole = int(last[-1]) + 1 if len(last) else 0
        if whole and (out := links(rows, whole)) is not None:
            yield out
        kept = [x[whole:] for x in rows]
    if kept is not None and len(kept[0]) and (out := links(kept, len(kept[0]))) is not None:
        yield out


def near_links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b): links between the `first` of distinct fingerprints (fp, first) that differ in at most `max_bits` bits, enough of them to connect
    whatever the rest would connect."""
    lists = [F.struct(F.lit(i).cast("int").alias("which"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(max_bits))]
    postings = distinct.select("fp", "first", F.explode(F.array(*lists)).alias("p")).select("p.which", "p.key", "fp", "first")
    sorted_ = postings.repartition("which", "key").sortWithinPartitions("which", "key", "fp")
    return sorted_.mapInArrow(lambda batches: linked(batches, max_bits), "a long, b long")


def grouped(docs: DataFrame, width: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs`."""
    fps = stored(fingerprinted(docs, width), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    found = components(near_links(distinct.where("first IS NOT NULL"), max_bits))
    named = distinct.join(found, distinct["first"] == found["node"], "left").select("fp", F.coalesce("root", "first").alias("component_id"))
    return fps.join(stored(named, "named-fingerprints"), "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """The documents that are the first of their component; rows without a doc_id stay."""
    gone = grouped(docs.select("doc_id", "text"), **how).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(stored(gone, "near-copies"), docs["doc_id"] == F.col("__gone"), "left_anti")
