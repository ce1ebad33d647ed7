"""Byte-pair encoding and decoding, speculate and verify.

Greedy longest match proposes tokens for every word a worker hasn't seen. A proposal is right when each token is what the merges
make of its own bytes and no merge would have crossed a boundary; that depends on adjacent pairs only, so all new pairs are judged
at once, by walking the merge trees along both sides of the boundary. Only words with a bad pair are merged step by step.

Ids equal those of the tokenizers library with add_special_tokens=False: added tokens found in a text get their id, whatever their
place. Null texts count as empty; an empty text has no ids and decodes to an empty text. Bytes that are not UTF-8 decode to U+FFFD.
Every row is encoded by itself, so repeated rows, other columns and the order of rows don't matter. A word may be of any length; the time for its merges
grows little faster than that.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modiste.llm.common import in_runs, listed

#: how byte-level vocabularies split a text before merging; no word that starts with an apostrophe is a run of letters or digits, so those may
#: be tried first, as the most frequent
PATTERN = r" ?\p{L}++| ?\p{N}++|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
#: texts of ASCII, European letters and common quotes and dashes, and the same pattern for these in classes that are quicker to match
PLAIN = re.compile("[\t\n\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f\u2013\u2014\u2018\u2019\u201c\u201d\u2026]*+")
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
PLAIN_PATTERN = re.compile(f" ?[{LETTERS}]++| ?[0-9]++|'(?:[stmd]|re|ve|ll)| ?[^\\s{LETTERS}0-9]++|\\s+(?!\\S)|\\s+")
#: words up to this many bytes are merged by searching a list, longer ones with a heap
SHORT = 64
#: words and pairs a worker remembers in each of two generations; when the younger one is full the older one goes, so its memory is bounded and what keeps
#: coming up stays
REMEMBERED = 50_000
NEVER = 1 << 40


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, by the usual rule: printable Latin-1 stands for
    itself, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Table:
    """64-bit keys and their values in an open hash table, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(len(keys) * 4).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values, self.mask = np.full(size + 64, -1, np.int64), np.full(size + 64, NEVER, np.int64), size
        left = np.arange(len(keys))
        at = self.place(keys)
        while len(left):  # every round puts one key into each free place that is asked for
            free = self.keys[at[left]] == -1
            first = left[free][np.unique(at[left[free]], return_index=True)[1]]
            self.keys[at[first]], self.values[at[first]] = keys[first], values[first]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] += 1

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values; NEVER for keys that aren't there."""
        at = self.place(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], NEVER)
        on = np.flatnonzero((held != keys) & (held != -1))
        while len(on):
            at[on] += 1
            held = self.keys[at[on]]
            hit = held == keys[on]
            out[on[hit]] = self.values[at[on[hit]]]
            on = on[~hit & (held != -1)]
        return out


class Bpe:
    """The vocabulary of one tokenizer file, and what a worker remembers."""

    def __init__(self, text: str):
        spec = json.loads(text)
        of = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        top = 1 + max([*vocab.values(), *self.added.values()])
        self.bytes: list[bytes] = [b""] * top
        for token, i in vocab.items():
            if token not in self.added:
                self.bytes[i] = bytes(of[c] for c in token)
        self.id_of = {b: i for i, b in enumerate(self.bytes) if b}
        self.longest = max(map(len, self.id_of))
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.left, self.right = np.full(top, -1), np.full(top, -1)
        self.rank = np.full(top, -1)
        self.merge: dict[tuple[int, int], int] = {}  # rank of a merge
        self.made: list[int] = []  # token made by the merge of each rank
        self.byte_id = [self.id_of.get(bytes([b]), -1) for b in range(256)]
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = vocab[a], vocab[b], vocab[a + b]
            self.merge[a, b] = rank
            self.made.append(c)
            self.left[c], self.right[c], self.rank[c] = a, b, rank
        self.pairs = Table(np.array([a << 32 | b for a, b in self.merge], np.int64), np.array(list(self.merge.values()), np.int64))
        self.made_ids, self.byte_ids = np.array(self.made, np.int64), np.array(self.byte_id, np.int64)
        of_length: dict[int, list[bytes]] = {}
        for b in self.id_of:
            of_length.setdefault(len(b), []).append(b)
        self.by_length = {n: Table(self.hashed(np.frombuffer(b"".join(bs), np.uint8).reshape(len(bs), n)), np.array([self.id_of[b] for b in bs])) for n, bs in of_length.items()}
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.sizes = np.fromiter(map(len, self.bytes), np.int64, top)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words = regex.compile(PATTERN)
        self.known: dict[str, bytes] = {}  # ids of a word, packed
        self.older: dict[str, bytes] = {}
        self.sound = np.zeros(top, np.int8)  # 1: the merges give the token back, -1: they don't
        self.judged, self.verdict = np.empty(0, np.int64), np.empty(0, bool)  # pairs, sorted, and whether they stay apart

    def exact(self, word: bytes) -> list[int]:
        """The merges in the order of their rank, leftmost first."""
        if len(word) > SHORT:
            return self.exact_long(word)
        of, rank_of, made = self.byte_id, self.merge.get, self.made
        ids = [of[b] for b in word]
        ranks = [rank_of(p, NEVER) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            at = ranks.index(best)
            ids[at : at + 2] = [made[best]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of((ids[at - 1], ids[at]), NEVER)
            if at < len(ranks):
                ranks[at] = rank_of((ids[at], ids[at + 1]), NEVER)
        return ids

    def exact_long(self, word: bytes) -> list[int]:
        """The same for words of any length: the pieces are a linked list, the merges wait in a heap by rank and place, and those whose pieces have
        changed since are passed over."""
        rank_of, made = self.merge.get, self.made
        n = len(word)
        ids = self.byte_ids[np.frombuffer(word, np.uint8)]
        first = self.pairs.get(ids[:-1] << 32 | ids[1:])
        at = np.flatnonzero(first < NEVER)
        heap = list(zip(first[at].tolist(), at.tolist()))
        heapq.heapify(heap)
        ids, before, after = ids.tolist(), list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank_of((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = made[rank], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank_of((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return [t for t in ids if t >= 0]

    def hashed(self, rows: np.ndarray) -> np.ndarray:
        """A hash of each row of bytes; kept from being -1, which marks free places."""
        h = np.zeros(len(rows), np.uint64)
        for i in range(rows.shape[1]):
            h = (h ^ (rows[:, i].astype(np.uint64) + np.uint64(1))) * np.uint64(0x100000001B3)
        return (h >> np.uint64(1)).astype(np.int64)

    def proposed(self, raw: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words: (token, word), in order. From every byte the longest token is found length by length, by hash and
        then by its bytes; then all words step on together."""
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(lengths)
        room = np.repeat(ends, lengths) - np.arange(len(data))
        best, size = self.byte_ids[data], np.ones(len(data), np.int64)
        h = np.zeros(len(data), np.uint64)
        for n in range(1, min(self.longest, int(lengths.max(initial=0))) + 1):
            on = np.flatnonzero(room >= n)
            h[on] = (h[on] ^ (data[on + n - 1].astype(np.uint64) + np.uint64(1))) * np.uint64(0x100000001B3)
            if n > 1 and n in self.by_length:
                got = self.by_length[n].get((h[on] >> np.uint64(1)).astype(np.int64))
                hit = got < NEVER
                best[on[hit]], size[on[hit]] = got[hit], n
        for at in np.flatnonzero(size > 8):  # long tokens are rare enough to compare one by one
            if self.bytes[best[at]] != data[at : at + size[at]].tobytes():
                best[at], size[at] = self.byte_ids[data[at]], 1
        at, word, out = ends - lengths, np.arange(len(raw)), []
        while len(at):
            out.append((word, at, best[at]))
            at = at + size[at]
            on = at < ends[word]
            at, word = at[on], word[on]
        word, at, token = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3
        order = np.argsort(at)
        return token[order], word[order]

    def merged(self, raw: list[bytes]) -> list[bytes]:
        """Packed ids of words by the merges in the order of their rank, leftmost first, one merge in every word a round."""
        out: list[bytes] = [b""] * len(raw)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        for low, high in ((1, 8), (9, 16), (17, 32)):
            rows = np.flatnonzero((lengths >= low) & (lengths <= high))
            if not len(rows):
                continue
            ids = np.full((len(rows), high + 1), -1, np.int64)
            inside = np.arange(high + 1) < lengths[rows][:, None]
            ids[inside] = self.byte_ids[np.frombuffer(b"".join([raw[i] for i in rows]), np.uint8)]
            ranks = np.full((len(rows), high), NEVER, np.int64)
            full = inside[:, 1:]
            ranks[full] = self.pairs.get((ids[:, :-1] << 32 | ids[:, 1:])[full])
            live = np.arange(len(rows))
            while len(live):
                own = ranks[live]
                at = own.argmin(1)
                best = own[np.arange(len(live)), at]
                on = best < NEVER
                live, at, best = live[on], at[on], best[on]
                if not len(live):
                    break
                shift = np.arange(high) >= at[:, None]
                i = ids[live]
                i[:, :-1] = np.where(shift & (np.arange(high) > at[:, None]), i[:, 1:], i[:, :-1])
                i[:, -1] = -1
                i[np.arange(len(live)), at] = self.made_ids[best]
                ids[live] = i
                r = ranks[live]
                r[:, :-1] = np.where(shift[:, :-1], r[:, 1:], r[:, :-1])
                r[:, -1] = NEVER
                for to in (at - 1, at):
                    k = np.flatnonzero(to >= 0)
                    a, b = i[k, to[k]], i[k, to[k] + 1]
                    r[k[b >= 0], to[k[b >= 0]]] = self.pairs.get(a[b >= 0] << 32 | b[b >= 0])
                    r[k[b < 0], np.minimum(to[k[b < 0]], high - 1)] = NEVER
                ranks[live] = r
            have = ids >= 0
            packed_ids, ends = ids[have].astype(np.int32).tobytes(), np.cumsum(have.sum(1)).tolist()
            for k, i in enumerate(rows.tolist()):
                out[i] = packed_ids[4 * (ends[k - 1] if k else 0) : 4 * ends[k]]
        for i in np.flatnonzero(lengths > 32).tolist():
            out[i] = array("i", self.exact(raw[i])).tobytes()
        return out

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.pairs.get(a << 32 | b)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a, b stay apart. Going back in time, the piece made last is undone; at each step the merge of the two pieces
        at the boundary, if there is one, must come later than what really happened to either of them. Equal ranks: leftmost first."""
        ok = np.ones(len(a), bool)
        x, y = a.astype(np.int64), b.astype(np.int64)
        up_x, up_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        live = np.arange(len(a))
        while len(live):
            xs, ys = x[live], y[live]
            m = self.merge_rank(xs, ys)
            crossed = (m < NEVER) & (m < up_x[live]) & (m <= up_y[live])
            ok[live[crossed]] = False
            rx, ry = self.rank[xs], self.rank[ys]
            on = ~crossed & ((rx >= 0) | (ry >= 0))
            live, undo_x = live[on], (rx > ry)[on]
            i, j = live[undo_x], live[~undo_x]
            up_x[i], x[i] = self.rank[x[i]], self.right[x[i]]
            up_y[j], y[j] = self.rank[y[j]], self.left[y[j]]
        return ok

    def pairs_good(self, keys: np.ndarray) -> np.ndarray:
        """Verdicts on pairs of tokens (a << 32 | b), each distinct pair judged once."""
        distinct, back = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(self.judged, distinct), max(len(self.judged) - 1, 0))
        seen = self.judged[at] == distinct if len(self.judged) else np.zeros(len(distinct), bool)
        good = self.verdict[at] & seen if len(self.judged) else seen.copy()
        new = distinct[~seen]
        if len(new):
            good[~seen] = ok = self.compatible(new >> 32, new & 0xFFFFFFFF)
            if len(self.judged) > 2 * REMEMBERED:
                self.judged, self.verdict = new, ok
            else:
                into = np.searchsorted(self.judged, new)
                self.judged, self.verdict = np.insert(self.judged, into, new), np.insert(self.verdict, into, ok)
        return good[back]

    def learn(self, words: list[str]) -> None:
        """Ids of words not seen so far."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat, word_of = self.proposed(raw, size)
        for t in np.unique(flat[self.sound[flat] == 0]):
            self.sound[t] = 1 if self.exact(self.bytes[t]) == [t] else -1
        wrong = self.sound[flat] < 0
        inner = np.flatnonzero(word_of[1:] == word_of[:-1])
        wrong[inner] |= ~self.pairs_good(flat[inner] << 32 | flat[inner + 1])
        failed = np.zeros(len(words), bool)
        failed[word_of[wrong]] = True
        lengths = np.bincount(word_of, minlength=len(words))
        packed_ids, ends = flat.astype(np.int32).tobytes(), (4 * np.cumsum(lengths)).tolist()
        self.known.update(zip(words, map(packed_ids.__getitem__, map(slice, [0, *ends[:-1]], ends))))
        again = np.flatnonzero(failed).tolist()
        self.known.update(zip([words[i] for i in again], self.merged([raw[i] for i in again])))

    def pieces(self, text: str) -> list[str]:
        """The words of a text; added tokens are words of their own."""
        if self.split is None or not any(a in text for a in self.added):
            return (PLAIN_PATTERN if PLAIN.fullmatch(text) else self.words).findall(text)
        return [w for part in self.split.split(text) if part for w in ([part] if part in self.added else self.words.findall(part))]

    def encode(self, texts: list[str | None]) -> pa.Array:
        """A list array of ids. Words are learnt in runs of texts of about 400,000 characters, so that memory is bounded."""
        out, run, size = [], [], 0
        for text in texts:
            run.append(self.pieces(text or ""))
            size += len(text or "")
            if size > 400_000:
                out += self.looked_up(run)
                run, size = [], 0
        out += self.looked_up(run)
        return listed(np.frombuffer(b"".join(out), np.int32), np.fromiter(map(len, out), np.int64, len(out)) // 4, pa.int32())

    def looked_up(self, run: list[list[str]]) -> list[bytes]:
        """Packed ids of texts given by their words."""
        words = set().union(*run)
        new = words - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.older, new = {}, self.known, words
        if again := new & self.older.keys():
            self.known.update((w, self.older[w]) for w in again)
            new = new - again
        for word in new & self.added.keys():
            self.known[word] = array("i", [self.added[word]]).tobytes()
        if new := list(new - self.added.keys()):
            self.learn(new)
        return [b"".join(map(self.known.__getitem__, words)) for words in run]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def decoded(self, lists: pa.ListArray) -> pa.Array:
        """The texts of all lists at once: the bytes of all tokens are gathered and cut at the lists' ends. Lists whose bytes aren't UTF-8 are
        decoded one by one."""
        ends = np.r_[0, np.cumsum(np.asarray(lists.value_lengths().fill_null(0), np.int64))]
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        size = self.sizes[ids]
        at = np.r_[0, np.cumsum(size)]
        kind = np.int32 if max(at[-1], len(self.flat)) < 1 << 30 else np.int64
        where = np.repeat((self.starts[ids] - at[:-1]).astype(kind), size)
        where += np.arange(len(where), dtype=kind)
        data = self.flat[where].tobytes()
        got = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(at[ends].astype(np.int32)), pa.py_buffer(data)])
        try:
            return got.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([b.decode("utf-8", "replace") for b in got.to_pylist()], pa.string())


@functools.lru_cache(2)
def loaded(text: str) -> Bpe:
    return Bpe(text)


def codec(spark: SparkSession, path: str):
    """(encode, decode) as column functions for the tokenizer file at `path`, which is read once, on the driver, and sent to the
    executors; such a file has a fixed size, a few MB."""
    with open(path, encoding="utf-8") as f:
        file = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    @in_runs
    def encode(texts: pa.Array) -> pa.Array:
        return loaded(file.value).encode(texts.to_pylist())

    @F.arrow_udf(T.StringType())
    @in_runs
    def decode(ids: pa.Array) -> pa.Array:
        return loaded(file.value).decoded(ids)

    return encode, decode


@F.arrow_udf(T.BinaryType())
@in_runs
def packed(ids: pa.Array) -> pa.Array:
    """Ids as little-endian unsigned 32-bit integers."""
    ends = np.r_[0, 4 * np.cumsum(np.asarray(ids.value_lengths().fill_null(0), np.int64))]
    data = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def encoded(df: DataFrame, path: str, text: str | Column = "text", ids: str = "ids") -> DataFrame:
    """`df` with the ids of `text`; a column of that name is replaced."""
    return df.withColumn(ids, codec(df.sparkSession, path)[0](text))


def decoded(df: DataFrame, path: str, ids: str | Column = "ids", text: str = "decoded") -> DataFrame:
    """`df` with the text of `ids`; a column of that name is replaced."""
    return df.withColumn(text, codec(df.sparkSession, path)[1](ids))


CODED = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}


def coder(spark: SparkSession, path: str, *parts: str):
    """A column function from text to a struct of `parts` of CODED: ids, their number, and the digests of ids and of the text they decode to. Digests are taken
    where the text is read, so neither packed ids nor decoded texts travel."""
    with open(path, encoding="utf-8") as f:
        file = spark.sparkContext.broadcast(f.read())

    def run(texts: pa.Array) -> pa.Array:
        own = loaded(file.value)
        ids = own.encode(texts.to_pylist())
        n = np.asarray(ids.value_lengths(), np.int64)
        ends = np.r_[0, 4 * np.cumsum(n)].tolist()
        data = memoryview(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes())
        made = {"ids": ids, "n_tokens": pa.array(n)}
        if "ids_sha256" in parts:
            made["ids_sha256"] = pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(ends, ends[1:])], pa.string())
        if "decoded_sha256" in parts:
            made["decoded_sha256"] = pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in own.decoded(ids).cast(pa.binary())], pa.string())
        return pa.StructArray.from_arrays([made[p] for p in parts], list(parts))

    return F.arrow_udf(in_runs(run, 2 << 20), T.StructType([T.StructField(p, CODED[p]) for p in parts]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per row of (doc_id, text): ids and the text they decode to."""
    encode, decode = codec(docs.sparkSession, path)
    ids = docs.select("doc_id", encode("text").alias("ids"))
    return ids.select("doc_id", "ids", decode("ids").alias("decoded"), packed("ids").alias("packed"))


def digests(trip: DataFrame) -> DataFrame:
    return trip.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
