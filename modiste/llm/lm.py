"""Language-model scoring with a weighted backoff automaton.

A state is an n-gram seen in training, of at most `order` - 1 words; the arc for word w from state h weighs (c(hw) + K p(w|h')) / (c(h) + K), h' being h
without its first word, and leads to the longest state that ends hw; the failure arc to h' weighs K / (c(h) + K). The root is the add-one unigram
model. One left-to-right traversal of a text carries the state: it takes the arc for the next word if the state has one, else failure arcs until a state
has it, and adds up log-probabilities. The texts of a chunk step on together. What a text gets sums to one over all words at every state.

The automaton grows with the corpus, so no task ever holds it. Texts are gathered in chunks of a bounded size and stored as token
numbers. A chunk sends each distinct n-gram once, with its training count, in sorted blocks to the bucket of its hash; a bucket adds up what
all chunks have sent and answers each block with the totals in the order of its keys. With those a chunk has every arc it needs. Lengths of n-grams
are settled one after the other, and what a length has shuffled is let go before the next.
An n-gram is known by a 64-bit hash, so two different ones are taken for one with probability n^2 / 2^65.

Words are runs of anything but ASCII white space, A-Z in lower case; every text ends with an end token, which is all that null
and empty texts have. Every row is scored by itself, also where a doc_id repeats; a null doc_id isn't held out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modiste.llm.common import give_back, release, sliced, stored, texts_of

#: bytes of text in a chunk, n-grams in a bucket
CHUNK, BUCKET = 6 << 20, 1_000_000
START, END = np.uint64(xxhash.xxh64_intdigest(b" start")), np.uint64(xxhash.xxh64_intdigest(b" end"))
CHUNKS = "chunk long, doc_ids array<long>, held array<boolean>, lengths array<int>, words binary, tokens binary, n long"
BLOCKS = "gram int, bucket int, chunk long, keys binary, counts binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double"


def squeezed(values: np.ndarray) -> bytes:
    """Numbers byte by byte of their width, compressed; zero bytes cost next to nothing."""
    data = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def unsqueezed(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def tokenized(batches):
    """Chunks of texts as numbers into the chunk's list of word hashes; number 0 is the end."""
    part, made = TaskContext.get().partitionId(), 0
    number: dict[bytes, int] = {}
    rows: list[tuple] = []
    tokens: list[np.ndarray] = []
    size = 0

    def out():
        hashes = np.r_[END, np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))]
        ids, held, lengths = zip(*rows)
        values = [[(part << 24) + made], [ids], [held], [lengths], [squeezed(hashes)], [squeezed(np.concatenate(tokens))], [sum(lengths)]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["chunk", "doc_ids", "held", "lengths", "words", "tokens", "n"])

    for batch in sliced(batches):
        for doc, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2))):
            got = [number.setdefault(w, len(number) + 1) for w in text.lower().split()]
            got.append(0)
            tokens.append(np.array(got, np.int32))
            rows.append((doc, held, len(got)))
            size += len(text) + 64
            if size > CHUNK:
                yield out()
                number, rows, tokens, size, made = {}, [], [], 0, made + 1
    if rows:
        yield out()


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of gram `a` followed by word `b`."""
    x = (a ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F) + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


class Grams:
    """The n-grams of a chunk. For every gram size: the distinct hashes, and of each token the place of its gram and of its history there; -1
    where a text has too few words before it."""

    def __init__(self, words: bytes, tokens: bytes, lengths: list[int], held: list[bool], order: int):
        hashes, tokens = unsqueezed(words, np.uint64), unsqueezed(tokens, np.int32)
        lengths = np.array(lengths)
        begin = np.cumsum(lengths) - lengths
        train = np.repeat(~np.array(held, bool), lengths)
        at = np.arange(len(tokens)) - np.repeat(begin, lengths)
        self.begin, self.lengths = begin, lengths
        self.keys, self.counts, self.place, self.history = [], [], [], []
        self.add(np.r_[hashes, START], tokens, np.bincount(tokens[train], minlength=len(hashes) + 1))
        self.counts[0][self.find(0, np.array([START]))] = int((~np.array(held, bool)).sum())
        for k in range(1, order):
            before = np.r_[np.int32(-1), self.place[k - 1][:-1]]
            if k == 1:
                before[begin] = self.find(0, np.array([START]))[0]
            else:
                before[at < k - 1] = -1
            full = np.flatnonzero(before >= 0)
            gram = mixed(self.keys[k - 1][before[full]], hashes[tokens[full]])
            distinct, back = np.unique(gram, return_inverse=True)
            place = np.full(len(tokens), -1, np.int32)
            place[full] = back
            self.history.append(before)
            self.keys.append(distinct)
            self.place.append(place)
            self.counts.append(np.bincount(back[train[full]], minlength=len(distinct)))

    def add(self, keys: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(keys)
        rank = np.empty(len(keys), np.int32)
        rank[order] = np.arange(len(keys), dtype=np.int32)
        self.keys.append(keys[order])
        self.counts.append(counts[order])
        self.place.append(rank[tokens])

    def find(self, k: int, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys[k], keys)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the hash, so a chunk's sorted keys are in their order."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def grams_of(row: dict, order: int) -> Grams:
    return Grams(row["words"], row["tokens"], row["lengths"], row["held"], order)


def rows_of(batches):
    for batch in batches:
        for at in range(batch.num_rows):
            yield {c: batch.column(i)[at].as_py() for i, c in enumerate(batch.schema.names)}
            if batch.nbytes > CHUNK // 8 * batch.num_rows:  # a row is a chunk
                give_back()
        give_back()


def as_batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def requests(batches, k: int, buckets: int):
    """Every distinct gram of k + 1 words of a chunk with its training count, a block for each bucket that has any."""
    for row in rows_of(batches):
        grams = grams_of(row, k + 1)
        keys, counts = grams.keys[k], grams.counts[k].astype(np.int64)
        bucket = bucket_of(keys, buckets)
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.empty(0, np.int64)
        for at, to in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
            yield as_batch([(k, int(bucket[at]), row["chunk"], squeezed(np.diff(keys[at:to], prepend=np.uint64(0))), squeezed(counts[at:to]))], ["gram", "bucket", "chunk", "keys", "counts"], [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()])


def totals(batches):
    """What a bucket has of each gram, to every chunk that asked; with the first answer the bucket's number of known grams and their sum, the
    start not counted. Rows come sorted by (gram, bucket)."""
    held: list[dict] = []

    def answers():
        keys = [np.cumsum(unsqueezed(r["keys"], np.uint64)) for r in held]
        distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, back, np.concatenate([unsqueezed(r["counts"], np.int64) for r in held]))
        real = total[distinct != START]
        at = 0
        for i, (r, own) in enumerate(zip(held, keys)):
            got = total[back[at : at + len(own)]]
            at += len(own)
            yield as_batch([(r["gram"], r["bucket"], r["chunk"], squeezed(got), int((real > 0).sum()) if i == 0 else 0, int(real.sum()) if i == 0 else 0)], ["gram", "bucket", "chunk", "counts", "types", "tokens"], [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()])

    for row in rows_of(batches):
        if held and (row["gram"], row["bucket"]) != (held[0]["gram"], held[0]["bucket"]):
            yield from answers()
            held = []
        held.append(row)
    if held:
        yield from answers()


class Automaton:
    """The states and arcs that the texts of a chunk can meet: for each token and each length of history whether there is an arc, its weight, and the
    weight of the failure arc of that history, as logarithms."""

    def __init__(self, grams: Grams, total: list[np.ndarray], n: int, v: int, weight: float):
        self.order = len(total)
        start = total[0][grams.find(0, np.array([START]))]
        self.first = 1 if self.order > 1 and len(start) and start[0] > 0 else 0
        grams.keys.clear()  # places are all that is needed from here on
        grams.counts.clear()
        count = total[0][grams.place[0]]
        p = (count + 1) / (n + v + 1)
        self.known, self.seen = count > 0, count
        self.arc, self.taken, self.failed = [self.known], [np.log10(p)], [np.zeros(len(p))]
        for k in range(1, self.order):
            history = grams.history[k - 1]
            full = np.flatnonzero(history >= 0)
            c, h = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
            c[full], h[full] = total[k][grams.place[k][full]], total[k - 1][history[full]]
            p = (c + weight * p) / (h + weight)
            self.arc.append(c > 0)
            self.taken.append(np.log10(p))
            self.failed.append(np.log10(weight / (h + weight)))

    def traverse(self, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The log-probability of each text. All texts step on from word to word, carrying the length of their state's n-gram; the word sequence
        has the rest of it."""
        order = np.argsort(-lengths, kind="stable")
        at, ends, out = begin[order], lengths[order], np.zeros(len(begin))
        state = np.full(len(begin), self.first, np.int8)
        for step in range(int(lengths.max(initial=0))):
            m = int(np.searchsorted(-ends, -step, "left"))  # texts with a word here
            t, own = at[:m] + step, state[:m]
            got, into = np.zeros(m), np.zeros(m, np.int8)
            for k in range(self.order - 1, 0, -1):
                here = own == k
                arc = here & self.arc[k][t]
                fail = here & ~arc
                got += np.where(arc, self.taken[k][t], 0.0) + np.where(fail, self.failed[k][t], 0.0)
                into[arc] = min(k + 1, self.order - 1)
                own = np.where(fail, k - 1, np.where(arc, -1, own))
            root = own == 0
            got += np.where(root, self.taken[0][t], 0.0)
            into[root] = np.minimum(self.known[t[root]], self.order - 1)
            out[:m] += got
            state[:m] = into
        back = np.empty(len(out))
        back[order] = out
        return back


def scores(batches, order: int, n: int, v: int, weight: float):
    """Per text the sum of log10(c + 1) and the score. A chunk's answers come first, sorted by (gram, bucket), then the chunk."""
    got: dict[int, list[bytes]] = {}
    for row in rows_of(batches):
        if row["words"] is None:
            got.setdefault(row["gram"], []).append(row["counts"])
            continue
        grams = grams_of(row, order)
        total = [np.concatenate([unsqueezed(x, np.int64) for x in got[k]]) if k in got else np.empty(0, np.int64) for k in range(order)]
        got = {}
        automaton = Automaton(grams, total, n, v, weight)
        out = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(grams.lengths.astype(np.int64))]
        out += [pa.array(np.add.reduceat(x, grams.begin)) for x in (automaton.known.astype(np.int64), np.log10(automaton.seen + 1.0))]
        yield pa.RecordBatch.from_arrays([*out, pa.array(automaton.traverse(grams.begin, grams.lengths))], ["doc_id", "held_out", "n_tokens", "n_known", "logs", "score"])


def scored(docs: DataFrame, held_out: Column, order: int = 3, weight: float = 60.0) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of `docs` (doc_id, text); the model learns from those where
    `held_out` isn't true. `order` is the longest n-gram, `weight` is K."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held"), "text")
    chunks = stored(rows.mapInArrow(tokenized, CHUNKS), "lm-chunks")
    size = chunks.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, math.ceil(size / BUCKET))
    answered = None
    for k in range(order):
        asked = chunks.select("chunk", "held", "lengths", "words", "tokens").mapInArrow(lambda b, k=k: requests(b, k, buckets), BLOCKS)
        counted = asked.repartition("gram", "bucket").sortWithinPartitions("gram", "bucket").mapInArrow(totals, "gram int, bucket int, chunk long, counts binary, types long, tokens long")
        counted = stored(counted, "lm-totals")
        answered = counted if answered is None else answered.union(counted)
        del asked
        release(spark)
    v, n = answered.where("gram = 0").agg(F.sum("types"), F.sum("tokens")).first()
    v, n = v or 0, n or 0

    none = lambda kind: F.lit(None).cast(kind)
    own = chunks.select("chunk", F.lit(order).alias("gram"), F.lit(0).alias("bucket"), none("binary").alias("counts"), "doc_ids", "held", "lengths", "words", "tokens")
    got = answered.select("chunk", "gram", "bucket", "counts", none("array<long>").alias("doc_ids"), none("array<boolean>").alias("held"), none("array<int>").alias("lengths"), none("binary").alias("words"), none("binary").alias("tokens"))
    met = got.union(own).repartition("chunk").sortWithinPartitions("chunk", "gram", "bucket")
    out = stored(met.mapInArrow(lambda b: scores(b, order, n, v, weight), SCORES), "lm-scores")
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
