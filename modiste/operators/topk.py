"""Nearest neighbours, top-k, ordering and paging.

Exact nearest neighbours never materialise query × item pairs: Arrow batches of vectors are multiplied with a query matrix inside the
task, which keeps the best k per (query, group) over all its batches and passes them on at its end. Queries up to a fixed number of
rows are sent to the tasks; more are dealt into blocks, a task each, which reads the stored vectors. Vectors aren't shuffled.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modiste.functions.scores import js_round
from modiste.functions.vec import half_up
from modiste.scale import bounded_rows, first_k, first_per_key, numbered
from modiste.session import cut

C = F.col
#: query rows that a task holds
MAX_QUERY_ROWS = 20_000
#: queries and items that are multiplied at once
QUERY_BLOCK, ITEM_BLOCK = 512, 2048


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    n[n == 0] = 1.0
    return m / n


def first_of_rows(s: np.ndarray, k: int | None) -> np.ndarray:
    """Which are the k highest of each row, of equal ones the first."""
    if k is None or s.shape[1] <= k:
        return np.ones(s.shape, bool)
    edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None]
    above, at = s > edge, s == edge
    return above | (at & (np.cumsum(at, axis=1) <= k - above.sum(axis=1, keepdims=True)))


def best_of_block(q: np.ndarray, ids: np.ndarray, vecs: np.ndarray, groups: np.ndarray | None, k: int | None, floor: float | None):
    """(query index, item index, score) of the best k items per (query, group); ties at the edge go to the smaller id."""
    order = np.argsort(ids, kind="stable")
    parts = [order] if groups is None else [order[groups[order] == g] for g in np.unique(groups)]
    qi, ii, ss = [], [], []
    for part in parts:
        for start in range(0, len(q), 512):
            s = np.round(q[start:start + 512] @ vecs[part].T, 6) + 0.0
            keep = first_of_rows(s, k)
            r, c = np.nonzero(keep if floor is None else keep & (s >= floor))
            qi.append(r + start), ii.append(part[c]), ss.append(s[r, c])
    return np.concatenate(qi or [np.empty(0, int)]), np.concatenate(ii or [np.empty(0, int)]), np.concatenate(ss or [np.empty(0)])


class Best:
    """The best k pairs per (query, group) that a task has met, kept for each block of queries by itself; ties go to the smaller id.

    Pairs are numbers: the query in its block, the item among those met, the group. `least` is the score a query's k-th best has reached in a group: what
    lies under it is dropped right after a product of single precision, whose error is bounded, and the rest is scored again in double precision."""

    def __init__(self, q: np.ndarray, k: int, floor: float | None):
        self.q, self.k, self.floor, self.start = q, k, floor, -np.inf if floor is None else floor
        self.single, self.error = q.astype(np.float32), 2e-6 + 2.4e-7 * q.shape[1]
        self.groups: dict[str, int] = {}
        self.blocks = [(slice(at, at + QUERY_BLOCK), [], [0, 0]) for at in range(0, len(q), QUERY_BLOCK)]
        self.least = np.empty((len(q), 0))
        self.ids: list[np.ndarray] = []
        self.met = 0

    def add(self, ids: np.ndarray, vecs: np.ndarray, groups: np.ndarray | None) -> None:
        order = np.argsort(ids, kind="stable")
        self._add(ids[order], vecs[order], groups, order)

    def _add(self, ids: np.ndarray, vecs: np.ndarray, groups: np.ndarray | None, order: np.ndarray) -> None:
        parts = [("", np.arange(len(ids)))] if groups is None else [(g, np.flatnonzero(groups[order] == g)) for g in np.unique(groups)]
        finite = bool(np.isfinite(vecs).all())
        for name, part in parts:
            g = self.groups.setdefault(name, len(self.groups))
            if g == self.least.shape[1]:
                self.least = np.c_[self.least, np.full(len(self.q), self.start)]
            own = vecs[part]
            single = own.astype(np.float32) if finite else None
            for rows, held, size in self.blocks:
                for at in range(0, len(part), ITEM_BLOCK):
                    some = slice(at, at + ITEM_BLOCK)
                    r, c, s, *more = self._near(rows, g, own[some], single[some] if finite else None, part[some])
                    if len(r):
                        held.append((r.astype(np.int32), part[some][c] + self.met, s, np.full(len(r), g, np.int32), *more))
                        size[1] += len(r)
                        if size[1] >= max(QUERY_BLOCK * self.k, size[0] // 2):
                            self._merge(rows, held, size, ids)
        self.ids.append(ids)
        self.met += len(ids)

    def _near(self, rows: slice, g: int, vecs: np.ndarray, single: np.ndarray | None, part: np.ndarray):
        """(query, item, score) of a block of queries and a block of items of one group: all that may still be among the best k, and little else. `part` has
        the items' places among those added."""
        least = self.least[rows, g]
        if single is not None and np.isfinite(least).all():
            r, c = np.divmod(np.flatnonzero(self.single[rows] @ single.T >= (least - self.error).astype(np.float32)[:, None]), len(vecs))
            if len(r) <= 4 * self.k * len(least):
                s = np.round(np.einsum("ij,ij->i", self.q[rows][r], vecs[c]), 6) + 0.0
                keep = s >= least[r]
                return r[keep], c[keep], s[keep]
        return best_of_block(self.q[rows], np.arange(len(vecs)), vecs, None, self.k, self.floor)

    def _merge(self, rows: slice, held: list, size: list, newest: np.ndarray | None = None) -> None:
        q, item, s, g, *more = (np.concatenate([h[i] for h in held]) for i in range(len(held[0])))
        ids = np.concatenate([*self.ids, *([] if newest is None else [newest])])
        if len(self.ids) > 1:
            self.ids[:] = [ids[: self.met]]
        met = np.zeros(len(ids), bool)
        met[item] = True
        used = np.flatnonzero(met)
        used = used[np.argsort(ids[used], kind="stable")]
        rank = np.zeros(len(ids), np.int64)
        rank[used] = np.arange(len(used))
        key, many = q.astype(np.int64) * len(self.groups) + g, len(used).bit_length()
        if not more and QUERY_BLOCK * len(self.groups) < 1 << (40 - many) and np.isfinite(s).all():
            # one number for all: scores are at most 1 and have six decimals
            packed = np.sort(((key << 23) + (2_000_000 - np.rint(s * 1e6).astype(np.int64)) << many) + rank[item])
            key, item = packed >> (many + 23), used[packed & ((1 << many) - 1)]
            s = (2_000_000 - (packed >> many & ((1 << 23) - 1))) / 1e6
            q, g = np.divmod(key, len(self.groups))
        else:
            order = np.lexsort((rank[item], -s, key))
            q, item, s, g, key, *more = (x[order] for x in (q, item, s, g, key, *more))
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        last = np.flatnonzero(place == self.k - 1)
        self.least[rows][q[last], g[last]] = s[last]
        keep = place < self.k
        held[:] = [(q[keep].astype(np.int32), item[keep], s[keep], g[keep].astype(np.int32), *(x[keep] for x in more))]
        size[:] = [len(held[0][0]), 0]

    def pairs(self):
        """(query, id, score, group) by block."""
        names = np.array(list(self.groups), str)
        for rows, held, size in self.blocks:
            if held:
                self._merge(rows, held, size)
                q, item, s, g = held[0][:4]
                held.clear()
                yield q + rows.start, self.ids[0][item], s, names[g]


class Blended(Best):
    """The best k pairs by a·cosine + b·match for weights (a, b), where match is the mean of 1 − |Δ| over the facts that both sides know, else 0.5, and at most 1.
    So a cosine rules a pair out as soon as a match of 1 wouldn't do. Unknown facts are NaN. The value is that of Spark's expression, to the last of its
    nine decimals."""

    def __init__(self, q: np.ndarray, k: int, facts: np.ndarray, weights: tuple[float, float]):
        super().__init__(q, k, None)
        self.wanted, self.weights = facts, weights
        self.facts: list[np.ndarray] = []

    def add(self, ids: np.ndarray, vecs: np.ndarray, facts: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.facts.append(facts[order])
        self._add(ids[order], vecs[order], None, order)

    def _value(self, cosine: np.ndarray, wanted: np.ndarray, facts: np.ndarray) -> np.ndarray:
        total, n = np.zeros(cosine.shape), np.zeros(cosine.shape, np.int32)
        for i in range(facts.shape[-1]):
            near = 1 - np.abs(wanted[..., i] - facts[..., i])
            known = ~np.isnan(near)
            total, n = total + np.where(known, near, 0.0), n + known
        value = self.weights[0] * cosine + self.weights[1] * np.where(n > 0, total / np.maximum(n, 1), 0.5)
        return half_up(value.ravel(), 9).reshape(value.shape)

    def _near(self, rows: slice, g: int, vecs: np.ndarray, single: np.ndarray | None, part: np.ndarray):
        least, wanted, facts = self.least[rows, g], self.wanted[rows], self.facts[-1][part]
        if single is not None and np.isfinite(least).all():
            enough = (least - self.weights[1]) / self.weights[0] - self.error
            r, c = np.divmod(np.flatnonzero(self.single[rows] @ single.T >= enough.astype(np.float32)[:, None]), len(vecs))
            if len(r) <= 4 * self.k * len(least):
                cosine = np.round(np.einsum("ij,ij->i", self.q[rows][r], vecs[c]), 6) + 0.0
                s = self._value(cosine, wanted[r], facts[c])
                keep = s >= least[r]
                return r[keep], c[keep], s[keep], cosine[keep]
        cosine = np.round(self.q[rows] @ vecs.T, 6) + 0.0
        s = self._value(cosine, wanted[:, None], facts[None])
        r, c = np.nonzero(first_of_rows(s, self.k))
        return r, c, s[r, c], cosine[r, c]

    def pairs(self):
        """(query, id, cosine, facts) by block."""
        facts = np.concatenate(self.facts) if self.facts else None
        for rows, held, size in self.blocks:
            if held:
                self._merge(rows, held, size)
                q, item, _, _, cosine = held[0]
                held.clear()
                yield q + rows.start, self.ids[0][item], cosine, facts[item]


def _all_near(q: np.ndarray, ids: np.ndarray, vecs: np.ndarray, groups: np.ndarray | None, floor: float):
    """(query, id, score, group) of all pairs at or above `floor`, a block of queries and items at a time. A product of single precision, whose error is
    bounded, drops what lies under it; the rest is scored again in double precision."""
    finite = bool(np.isfinite(q).all() and np.isfinite(vecs).all())
    single, error = vecs.astype(np.float32), 2e-6 + 2.4e-7 * q.shape[1]
    for start in range(0, len(q), QUERY_BLOCK):
        own = q[start:start + QUERY_BLOCK]
        for at in range(0, len(vecs), ITEM_BLOCK):
            some = slice(at, at + ITEM_BLOCK)
            near = np.flatnonzero(own.astype(np.float32) @ single[some].T >= np.float32(floor - error)) if finite else None
            if near is not None and len(near) <= len(own) * 200:
                qi, ii = np.divmod(near, len(vecs[some]))
                ss = np.round(np.einsum("ij,ij->i", own[qi], vecs[some][ii]), 6) + 0.0
                qi, ii, ss = (x[ss >= floor] for x in (qi, ii, ss))
            else:
                finite = False  # many pairs stay: scored once only from here on
                qi, ii, ss = best_of_block(own, ids[some], vecs[some], None, None, floor)
            yield qi + start, ids[some][ii], ss, (np.full(len(ii), "") if groups is None else groups[some][ii])


def _batches(qids: pa.Array, pairs, group: str | None):
    """Pairs as record batches."""
    names = ["__q", "object_id", "score"] + ([group] if group else [])
    q, ids, s, g = pairs
    for at in range(0, len(q), 50_000):
        some = slice(at, at + 50_000)
        cols = [qids.take(pa.array(q[some])), pa.array(ids[some], pa.string()), pa.array(s[some])]
        yield pa.RecordBatch.from_arrays(cols + ([pa.array(g[some], pa.string())] if group else []), names=names)


def _scored_batches(qids: pa.Array, qm: np.ndarray, batches, k: int | None, floor: float | None, group: str | None):
    """The pairs of some queries with the items of all batches."""
    best = Best(qm, k, floor) if k is not None else None
    for b in batches:
        if b.num_rows == 0 or len(qids) == 0:
            continue
        ids = b.column("object_id").to_numpy(zero_copy_only=False).astype(str)
        groups = b.column(group).to_numpy(zero_copy_only=False).astype(str) if group else None
        vecs = _matrix(b.column("vec"))
        if best is not None:
            best.add(ids, vecs, groups)
            continue
        for pairs in _all_near(qm, ids, vecs, groups, floor):
            yield from _batches(qids, pairs, group)
    if best is not None:
        for pairs in best.pairs():
            yield from _batches(qids, pairs, group)


def _facts(column: pa.Array) -> np.ndarray:
    """A row of numbers for each list, all of one size; null is NaN."""
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blended_batches(queries: pa.RecordBatch, batches, k: int, weights: tuple[float, float]):
    """The pairs of some queries with the items of all batches that are the best by their value."""
    if not queries.num_rows:
        return
    qids, best = queries.column("__q"), Blended(_matrix(queries.column("vec")), k, _facts(queries.column("facts")), weights)
    for b in batches:
        if b.num_rows:
            best.add(b.column("object_id").to_numpy(zero_copy_only=False).astype(str), _matrix(b.column("vec")), _facts(b.column("facts")))
    for q, ids, cosine, facts in best.pairs():
        for at in range(0, len(q), 50_000):
            some = slice(at, at + 50_000)
            flat = facts[some].ravel()
            known = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, facts.shape[1], dtype=np.int32)), pa.array(flat, mask=np.isnan(flat)))
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(q[some])), pa.array(ids[some], pa.string()), pa.array(cosine[some]), known], names=["__q", "object_id", "score", "facts"])


def _score_sent(v: DataFrame, table: pa.Table, pairs, schema: str) -> DataFrame:
    """Few queries: sent to every task."""
    sent = v.sparkSession.sparkContext.broadcast(_narrow(table.combine_chunks().to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema)))
    return v.mapInArrow(lambda batches: pairs(sent.value, batches), schema)


def _narrow(rows: pa.RecordBatch) -> pa.RecordBatch:
    """With vectors of single precision where that holds them exactly."""
    at = rows.schema.get_field_index("vec")
    column = rows.column(at)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    with np.errstate(over="ignore"):
        single = values.astype(np.float32)
    if ((single == values) | np.isnan(values)).all():
        values = single
    offsets = pa.array(np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int32))
    vecs = pa.ListArray.from_arrays(offsets, pa.array(values))
    return pa.RecordBatch.from_arrays([vecs if i == at else c for i, c in enumerate(rows.columns)], rows.schema.names)


PACK = "pack binary"


def _packs(batches) -> Iterator[pa.RecordBatch]:
    """A row of bytes for each batch."""
    for rows in batches:
        if rows.num_rows:
            rows, out = _narrow(rows), pa.BufferOutputStream()
            with pa.ipc.new_stream(out, rows.schema) as writer:
                writer.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["pack"])


def _whole(batches) -> Iterator[pa.RecordBatch]:
    """The batches of a task as one."""
    held = list(batches)
    if held:
        yield pa.concat_batches(held)


def _unpacked(pack: pa.BinaryScalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(pack.as_py()).read_next_batch()


def _score_dealt(q: DataFrame, v: DataFrame, blocks: int, pairs, schema: str) -> DataFrame:
    """Many queries: dealt into blocks of equal size, a pack and a partition each. Vectors are stored once, in packs, and a task reads these one after the
    other beside its queries, so neither passes through the driver, is copied for the blocks or is held whole."""
    dealt = q.repartitionById(blocks, F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int"))
    asked = cut(dealt.mapInArrow(lambda batches: _packs(_whole(batches)), PACK)).withColumnRenamed("pack", "asked")
    met = cut(v.mapInArrow(_packs, PACK)).withColumn("number", F.monotonically_increasing_id())
    # every block of queries with all packs: the left side is read along, the right side, a pack, is held
    both = met.coalesce(1).hint("shuffle_replicate_nl").crossJoin(asked)

    def run(batches):
        rows = ((b.column("number")[i].as_py(), b.column("pack")[i], b.column("asked")[i]) for b in batches for i in range(b.num_rows))
        by_pack = itertools.groupby(rows, key=lambda x: x[0])
        for _, first in by_pack:
            first = list(first)
            queries = pa.concat_batches([_unpacked(x[2]) for x in first])
            packs = itertools.chain([first[0][1]], (next(own)[1] for _, own in by_pack))
            yield from pairs(queries, (_unpacked(x) for x in packs))

    return both.mapInArrow(run, schema)


def _all_pairs(q: DataFrame, v: DataFrame, max_query_rows: int, pairs, schema: str, kept: bool) -> DataFrame:
    """`pairs` of queries and items. Up to `max_query_rows` queries are sent to the tasks that read the vectors; more are dealt into blocks of about that many
    at most, as many as keep all cores busy. `kept` for pairs that are few enough to be stored."""
    table = bounded_rows(q, max_query_rows)
    if table is not None:
        return _score_sent(v, table, pairs, schema)
    q = cut(q)  # many queries: computed once
    cores = v.sparkSession.sparkContext.defaultParallelism
    found = _score_dealt(q, v, cores * -(-5 * q.count() // (4 * max_query_rows * cores)), pairs, schema)
    return cut(found) if kept else found


def scored(queries: DataFrame, vectors: DataFrame, k: int | None, floor: float | None = None, query_key: str = "query_id", group: str | None = None,
           max_query_rows: int = MAX_QUERY_ROWS) -> DataFrame:
    """(query, item, [group], score): per task at most k rows per (query, group), all at or above `floor`.

    With k set the result still holds the winners of every task; `nearest` ranks them. Without k a floor is required. Up to `max_query_rows` queries are sent
    to the tasks that read the vectors; more are dealt into blocks of about that many at most, as many as keep all cores busy."""
    if k is None and floor is None:
        raise ValueError("give k or a floor")
    q = queries.where(C("vec").isNotNull()).select(C(query_key).cast("string").alias("__q"), "vec")
    v = vectors.where(C("vec").isNotNull()).select("object_id", "vec", *([group] if group else []))
    schema = "__q string, object_id string, score double" + (f", {group} string" if group else "")
    # without k pairs are too many to be stored
    pairs = _all_pairs(q, v, max_query_rows, lambda asked, batches: _scored_batches(asked.column("__q"), _matrix(asked.column("vec")), batches, k, floor, group), schema, k is not None)
    kind = queries.schema[query_key].dataType
    return pairs.select(C("__q").cast(kind).alias(query_key), "object_id", *([group] if group else []), "score")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, floor: float | None = None, query_key: str = "query_id", group: str | None = None,
            max_query_rows: int = MAX_QUERY_ROWS) -> DataFrame:
    """The k nearest items per query (per group) by cosine, ties by id: (query, [group], rank, object_id, score)."""
    keys = [query_key] + ([group] if group else [])
    pairs = scored(queries, vectors, k, floor, query_key, group, max_query_rows)
    return first_k(pairs, keys, [C("score").desc(), "object_id"], k, "rank").select(*keys, "rank", "object_id", "score")


def blended(queries: DataFrame, vectors: DataFrame, k: int, weights: tuple[float, float], query_key: str = "query_id", max_query_rows: int = MAX_QUERY_ROWS) -> DataFrame:
    """(query, object_id, score, facts): among them the k items of each query with the highest round(a·score + b·match, 9) for positive weights (a, b), ties by id,
    where score is the cosine and match that of `facts`, an array of numbers on both sides. All items are candidates."""
    q = queries.where(C("vec").isNotNull()).select(C(query_key).cast("string").alias("__q"), "vec", "facts")
    v = vectors.where(C("vec").isNotNull()).select("object_id", "vec", "facts")
    pairs = _all_pairs(q, v, max_query_rows, lambda asked, batches: _blended_batches(asked, batches, k, weights), "__q string, object_id string, score double, facts array<double>", True)
    return pairs.select(C("__q").cast(queries.schema[query_key].dataType).alias(query_key), "object_id", "score", "facts")


def clustered(clusters: DataFrame, vectors: DataFrame, total_k: int = 120, floor: float = 0.0, query_key: str = "query_id") -> DataFrame:
    """Each cluster asks for max(10, round(K·weight)) items; scores add up as Σ score·weight; the best K per query remain."""
    c = clusters.withColumn("__cid", F.concat_ws("|", C(query_key).cast("string"), C("cluster").cast("string")))
    want = F.greatest(F.lit(10), js_round(C("weight") * total_k))
    hits = nearest(c, vectors, max(10, total_k), None, "__cid").join(c.select("__cid", query_key, "weight"), "__cid")
    kept = hits.where((C("rank") <= want) & (C("score") >= floor))
    fused = kept.groupBy(query_key, "object_id").agg(F.round(F.sum(C("score") * C("weight")), 9).alias("score"))
    return first_k(fused, [query_key], [C("score").desc(), "object_id"], total_k, "rank")


def per_phrase_union(phrases: DataFrame, vectors: DataFrame, per_phrase: int = 80, floor: float | None = 0.18, group: str = "category", query_key: str = "query_id") -> DataFrame:
    """Best 80 per phrase and category, united in phrase order without repeats. All of the union stays: what the last phrases found is ranked as well, and who
    needs fewer takes the first of them."""
    p = phrases.withColumn("__pid", F.concat_ws("|", C(query_key).cast("string"), C("phrase").cast("string")))
    hits = nearest(p, vectors, per_phrase, floor, "__pid", group).join(p.select("__pid", query_key, "phrase"), "__pid")
    firsts = hits.groupBy(query_key, group, "object_id").agg(F.min(F.struct("phrase", "rank")).alias("first"))
    # a group holds what its phrases found, `per_phrase` rows each
    return numbered(firsts, [query_key, group], ["first", "object_id"], "rank", spread=False).select(query_key, group, "rank", "object_id")


# ── order and pages ───────────────────────────────────────────────────────────
def price_nulls_last(df: DataFrame, keys: Sequence[str], descending: bool = False, pos: str = "pos", out: str = "new_pos") -> DataFrame:
    price = C("price").desc_nulls_last() if descending else C("price").asc_nulls_last()
    return numbered(df, keys, [price, pos], out)


def boost_front(df: DataFrame, boosts: DataFrame, keys: Sequence[str], top: int = 24, pos: str = "pos", out: str = "new_pos") -> DataFrame:
    """Boosted ids first in boost order, the rest in place."""
    b = boosts.select(*keys, "object_id", C("rank").alias("__boost"))
    joined = df.join(b, [*keys, "object_id"], "left")
    return numbered(joined, keys, [C("__boost").asc_nulls_last(), pos, "object_id"], out).drop("__boost")


def partition_demote(df: DataFrame, keys: Sequence[str], matches: Column, pos: str = "pos", out: str = "new_pos") -> DataFrame:
    """Mismatches to the end, order kept on both sides."""
    return numbered(df.withColumn("__bad", ~matches), keys, ["__bad", pos, "object_id"], out).drop("__bad")


def page_offset(ranked: DataFrame, keys: Sequence[str], page: int, size: int, pos: str = "pos") -> DataFrame:
    """One page of every list, with `has_more`; the totals are a partial count joined back."""
    totals = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("__total")) if keys else None
    sliced = ranked.where((C(pos) > page * size) & (C(pos) <= (page + 1) * size))
    if not keys:
        return sliced.withColumn("has_more", F.lit(ranked.count() > (page + 1) * size))
    return sliced.join(totals, list(keys)).withColumn("has_more", C("__total") > (page + 1) * size).drop("__total")


def page_loosen(levels: Sequence[DataFrame], keys: Sequence[str], size: int, pos: str = "pos") -> DataFrame:
    """A page filled from the strict list first, then from looser ones; each id at its first level."""
    tagged = None
    for i, df in enumerate(levels):
        part = first_k(df, keys, [pos, "object_id"], size * len(levels), "__r").select(*keys, "object_id", F.lit(i).alias("level"), C(pos).alias("pos"))
        tagged = part if tagged is None else tagged.unionByName(part)
    firsts = tagged.groupBy(*keys, "object_id").agg(F.min(F.struct("level", "pos")).alias("f")).select(*keys, "object_id", "f.level", "f.pos")
    return first_k(firsts, keys, ["level", "pos", "object_id"], size, "position").drop("pos")


def sample_per_group(df: DataFrame, keys: Sequence[str], n: int, order: Sequence[str | Column] = ("object_id",)) -> DataFrame:
    return first_k(df, keys, list(order), n).drop("rn")
