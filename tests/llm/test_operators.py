"""The first ten operators against plain loops, libraries and cases of every kind: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import random
import time
from collections import defaultdict

import brute
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from modiste.llm import bpe, decontaminate, hashfilter, html, langid, lines, lm, sharding, simhash, suffix, topk

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(90001, None), (90002, ""), (90003, " \t\n\x0b"), (90004, "word"), (90005, "Zwei Wörter É"), (90006, "a" * 3000), (90007, "\n\n\n"), (90008, "tie tie tie tie")]


@pytest.fixture(scope="module")
def codec():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t, bpe.Bpe(open(PATH, encoding="utf-8").read())


def test_bpe_equals_the_library(codec, texts):
    library, own = codec
    random.seed(1)
    parts = ["a", "e", " ", "t", "h", "in", "ing", " the", "1", "\n", "\t", "é", "😀", "'s", "'ll", "<|endoftext|>", "<|endof", "\x1c", "\x85", " ", ".", "!!", "aaa", "===", "　", "한"]
    cases = ["".join(random.choices(parts, k=random.randint(0, 40))) for _ in range(3000)] + [t for _, t in texts] + ["a" + chr(c) + "b " + chr(c) + "1" + chr(c) * 2 for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    want = [e.ids for e in library.encode_batch(cases, add_special_tokens=False)]
    assert own.encode(cases).to_pylist() == want
    assert [own.decode(np.array(w, np.int64)) for w in want] == [library.decode(w, skip_special_tokens=False) for w in want]
    broken = [[random.randrange(50257) for _ in range(8)] for _ in range(2000)]
    assert [own.decode(np.array(w)) for w in broken] == [library.decode(w, skip_special_tokens=False) for w in broken]
    assert own.encode([None, ""]).to_pylist() == [[], []]
    lists = pa.array([*want[:400], None, []], pa.list_(pa.int32()))
    for part in (lists, lists.slice(37, 200), pa.array(broken, pa.list_(pa.int32())), lists[:0]):
        assert own.decoded(part).to_pylist() == [own.decode(np.array(x or [], np.int64)) for x in part.to_pylist()]


def test_bpe_pairs_decide(codec):
    own = codec[1]
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 50256, 3000), rng.integers(0, 50256, 3000)
    sound = [own.exact(own.bytes[x]) == [x] and own.exact(own.bytes[y]) == [y] for x, y in zip(a, b)]
    want = [own.exact(own.bytes[x] + own.bytes[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert all(w == g for s, w, g in zip(sound, want, own.compatible(a, b)) if s)


def test_bpe_words_of_any_length(codec):
    library, own = codec
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=n)).encode() for n in (65, 300, 2000)] + [b"a" * 700, "é漢字".encode() * 90, bytes(rng.choices(range(256), k=900))]
    short = bpe.SHORT
    try:
        bpe.SHORT = 1 << 40
        slow = [own.exact(w) for w in words]
    finally:
        bpe.SHORT = short
    assert [own.exact(w) for w in words] == slow
    long = "".join(rng.choices("etaoinshrdlu", k=200_000))
    assert own.encode([long]).to_pylist()[0] == library.encode(long, add_special_tokens=False).ids
    began = time.time()
    own.encode(["".join(rng.choices("ACGT", k=1_000_000)), "漢字" * 300_000])
    assert time.time() - began < 60


def test_bpe_plain_texts_split_alike(codec, texts):
    own = codec[1]
    rng = random.Random(9)
    parts = ["a", "É", "ß", " ", "  ", "\n", "\t", "'s", "'ll", "’s", "1", "23", "_", "-", "…", "“", "x'y", "don't", "ſ", "\r\n", "$%", "ÿ"]
    for t in ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(4000)] + [t or "" for _, t in texts]:
        assert own.words.findall(t) == own.pieces(t) or not bpe.PLAIN.fullmatch(t)
    assert sum(bool(bpe.PLAIN.fullmatch(t or "")) for _, t in texts) > 0.8 * len(texts) and not bpe.PLAIN.fullmatch("²") and not bpe.PLAIN.fullmatch("\x1c")


def test_bpe_forgets_and_stays_right(codec, texts, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    own = bpe.Bpe(open(PATH, encoding="utf-8").read())
    got = [own.encode([t]).to_pylist()[0] for _, t in texts[:40]]
    assert got == [e.ids for e in codec[0].encode_batch([t for _, t in texts[:40]], add_special_tokens=False)]


def test_bpe_frames(spark, frame, texts):
    rows = texts[:20] + ODD + texts[:1]
    library = Tokenizer.from_file(PATH)
    got = sorted(tuple(r) for r in bpe.digests(bpe.round_trip(frame(rows), PATH)).collect())
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    code = bpe.coder(spark, PATH, *bpe.CODED)
    coded = frame(rows).select("doc_id", code("text").alias("c")).select("doc_id", "c.*").collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in coded) == got and all(len(r.ids) == r.n_tokens for r in coded)
    back = bpe.decoded(bpe.encoded(frame(rows), PATH), PATH, text="term").collect()
    assert all(r.term == (r.text or "") for r in back) and not bpe.encoded(frame(rows).limit(0), PATH).collect()


def test_bwt_merge_finds_the_least_document():
    random.seed(2)
    for _ in range(40):
        letters, size = random.choice([b"ab", b"abc\x00\xff"]), random.choice([5, 12, 50])
        base = bytes(random.choices(letters, k=200))
        strings = []
        for _ in range(random.randint(2, 60)):
            at = random.randrange(120)
            s = bytearray(base[at : at + random.randint(size, size + 26)])
            s[random.randrange(len(s))] = random.choice(letters)
            strings.append(bytes(s))
        first = np.array([random.randrange(1000) for _ in strings])
        least: dict[bytes, int] = {}
        for s, f in zip(strings, first.tolist()):
            for i in range(len(s) - size + 1):
                least[s[i : i + size]] = min(f, least.get(s[i : i + size], f))
        got = suffix.least_documents(strings, first, size)
        assert [[least[s[i : i + size]] for i in range(len(s) - size + 1)] for s in strings] == [g.tolist() for g in got]


def test_merged_transforms_are_the_sorted_suffixes():
    strings = [b"banana", b"ananas", b"nab", b"banana"]
    inter, lcp = suffix.merged([suffix.Bwt(strings[:2]), suffix.Bwt(strings[2:])], 10)
    every = sorted((s[i:], k // 2) for k, s in enumerate(strings) for i in range(len(s) + 1))
    assert [k for _, k in every] == inter.tolist()
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert all(lcp[i] == common(every[i - 1][0], every[i][0]) for i in range(1, len(every)) if every[i - 1][0] != every[i][0])


def test_pieces_cover_each_window_once(monkeypatch):
    data = bytes(random.Random(4).choices(b"abcd", k=5000))
    whole = sorted((s + at + i) for at, _, start, n in suffix.stretches(data, 50) for s, k in zip(start.tolist(), n.tolist()) for i in range(k))
    assert whole == list(range(5000 - 49))
    monkeypatch.setattr(suffix, "STRETCH", 700)
    parts = sorted((s + at + i) for at, _, start, n in suffix.stretches(data, 50) for s, k in zip(start.tolist(), n.tolist()) for i in range(k))
    assert parts == whole


def test_substrings(spark, frame, texts, monkeypatch):
    rng = random.Random(5)
    rows = texts[:90] + [(10000 + i, rng.choice(texts)[1][rng.randrange(100) :]) for i in range(20)] + [(20000 + i, texts[3][1][i : i + 300] + "zq" + texts[5][1][100 + i : 400]) for i in range(30)]
    rows += ODD + [(None, texts[0][1]), (90010, "b" + "a" * 60), (90011, "a" * 49), texts[0]]
    want = sorted(brute.substrings(rows), key=str)

    def run():
        out = suffix.without_repeats(frame(rows), 50, 1 << 20)
        out = out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), "__cut.n_removed", "__cut.n_spans", F.sha2("__cut.kept", 256))
        return sorted((tuple(r) for r in out.collect()), key=str)

    assert run() == want
    monkeypatch.setattr(suffix, "MANY", 3)  # by windows from four pieces on
    assert run() == want
    assert not suffix.without_repeats(frame([]), 50, 1 << 20).collect()


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_language_model(frame, texts, order, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET", 5000)
    rows = texts + ODD + texts[:2] + [(None, "the of")]
    out = lm.scored(frame(rows), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, order, 60.0)
    got, want = sorted(map(tuple, out.collect()), key=str), sorted(brute.language_model(rows, order, 60.0), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)
    walked = sorted(((*w[:6], x) for w, x in zip(brute.language_model(rows, order, 60.0), brute.walked(rows, order, 60.0))), key=str)
    np.testing.assert_allclose([g[6] for g in got], [w[6] for w in walked], rtol=1e-9)
    assert not lm.scored(frame([]), F.lit(False)).collect()
    held = [w for w in want if w[1]]
    assert order == 1 or sum(w[6] for w in held) > sum(w[5] for w in held)


def test_language_model_of_a_very_long_text(frame):
    rows = [(1, "the of the and " * 30_000), (3, "the of " * 10), (4, None)]
    got = sorted(map(tuple, lm.scored(frame(rows), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).collect()))
    want = brute.walked(rows, 3, 60.0)
    np.testing.assert_allclose([g[6] for g in got], want, rtol=1e-9)


def test_language_model_sums_to_one():
    rows = [(1, "a b a c"), (3, "b a b"), (4, "c")]
    vocab = ["a", "b", "c"]
    one = lambda text: brute.language_model([*rows, (5, text)], 2, 60.0)[-1][6]
    assert all(np.isfinite(one(w)) for w in vocab)


def test_near_groups(frame, texts):
    rng = random.Random(5)
    base = rng.choices("abcdefghijklmnopqrstuvwxyz", k=400)
    near = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(400)] = rng.choice("xyzuvw")
        near.append((1000 + i * 7 % 3000, " ".join(w)))
    rows = texts + near + ODD
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.grouped(frame(rows)).collect()}
    assert got == brute.near_groups(rows)
    kept = sorted(r.doc_id for r in simhash.deduplicated(frame(rows)).collect())
    assert kept == sorted(d for d, (_, c) in got.items() if d == c)
    assert not simhash.grouped(frame([])).collect()
    ids = [(r.doc_id, r.component_id) for r in simhash.grouped(frame([(None, "a"), (1, "b"), (1, "c c c c"), (None, "b")])).collect()]
    assert sorted(ids, key=str) == sorted([(None, None), (1, 1), (1, 1), (None, 1)], key=str)


def test_close_pairs_by_flips_and_by_pairs():
    fp = np.unique(np.random.default_rng(1).integers(0, 4096, 1500).astype(np.uint64))
    i, j = np.triu_indices(len(fp), 1)
    near = np.bitwise_count(fp[i] ^ fp[j]) <= 2
    want = set(zip(i[near].tolist(), j[near].tolist()))
    a, b = simhash.close_pairs(fp, np.zeros(len(fp), np.int64), 2)
    assert {tuple(sorted(x)) for x in zip(a.tolist(), b.tolist())} == want
    groups = np.arange(len(fp)) // 100
    a, b = simhash.close_pairs(fp, groups, 2)
    assert {tuple(sorted(x)) for x in zip(a.tolist(), b.tolist())} == {x for x in want if x[0] // 100 == x[1] // 100}


def test_contamination(spark, frame, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    items += [(900, "short one É"), (901, ""), (902, None), (None, "null item"), (903, items[0][1]), (904, "Tie tie TIE tie")]
    passage = items[1][1]
    rows = texts + ODD + [(80001, passage.upper()), (80002, "x " + passage + " y " * 3000), (80003, "…short-one,É!"), (None, passage), (80001, "other text"), (80004, "tie " * 20), (80004, "tie " * 20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination(frame(rows), bench)
    got = sorted((tuple(r) for r in out.drop("h").collect()), key=str)
    assert got == sorted(brute.contamination(rows, items), key=str)
    kept = sorted(((r.doc_id, r.text) for r in decontaminate.decontaminated(frame(rows), bench).collect()), key=str)
    assert kept == sorted((r for r, c in zip(rows, brute.contamination(rows, items)) if not c[-1]), key=str)
    assert not decontaminate.contamination(frame([]), bench).collect()
    assert not any(r.contaminated for r in decontaminate.contamination(frame(rows), bench.limit(0)).collect())


def test_proximity(spark, frame):
    rows = [(1, "alpha x beta y gamma"), (2, "gamma alpha beta"), (3, "alpha x x x x x beta gamma"), (4, "alpha beta"), (5, None)]
    phrases = spark.createDataFrame([("alpha beta gamma", ["alpha", "beta", "gamma"])], "phrase string, words array<string>")
    assert sorted(r.doc_id for r in decontaminate.proximity_matches(frame(rows), phrases, 5).collect()) == [1, 2]


@pytest.mark.parametrize("shards", [24, 5])
def test_sharding(frame, texts, shards, monkeypatch):
    monkeypatch.setattr(sharding, "CELLS", 32)
    monkeypatch.setattr(sharding, "FINER", 4)
    rows = texts + ODD + [(70000 + i, "same text " * 3) for i in range(60)] + [texts[0], (None, "no id")]
    out = sharding.sharded(frame(rows), shards).collect()
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    order = sorted(groups.items(), key=lambda g: (min((d for d in g[1] if d is not None), default=-1), hashlib.sha256(g[0].encode()).hexdigest()))
    size, slots, placed = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in out:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        placed[r.text_crc32].add(r.shard)
    assert len(out) == len(rows) and set(size) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in placed.values())
    assert max(size.values()) == brute.smallest_capacity([(len(t.encode()) + 8) * len(ds) for t, ds in order], shards)
    assert sharding.sharded(frame([]), shards).collect() == []


def test_sharding_few_documents(frame):
    out = sharding.sharded(frame([(1, "a"), (2, "b"), (3, None)]), 24).collect()
    assert sorted((r.doc_id, r.slot) for r in out) == [(1, 0), (2, 0), (3, 0)] and len({r.shard for r in out}) == 3


def plain_top(vectors, every, k):
    held = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for own, (q, v) in enumerate(held):
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for at, (i, w) in enumerate(held) if at != own)[:k]
            out += [(q, r + 1, i, -s if abs(s) < 1 << 63 else None) for r, (s, i) in enumerate(scores)]
    return sorted(out, key=str)


def test_top_k(spark):
    rng = random.Random(6)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.2))) for _ in range(8)]) for i in range(400)] + [(400 + i, [0.5] * 8) for i in range(60)]
    rows += [(600, None), (601, [float("nan")] * 8), (602, [None] * 8), (603, []), (650, []), (604, [1.0, 2.0]), (50, [0.1] * 8), (50, rows[50][1]), (51, rows[50][1]), (51, rows[50][1]), (None, [0.3] * 8), (605, [float("inf")] * 8), (700, [2.0**19] + [0.0] * 7), (701, [2.0**19] + [0.0] * 7)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, v string, block int").repartition(3)
    assert sorted((tuple(r) for r in topk.top_k(df).collect()), key=str) == plain_top(rows, 50, 5)
    assert topk.top_k(df.limit(0)).collect() == [] and topk.top_k(df.where("vec_id = 650")).collect() == []


def test_top_k_of_large_components(spark):
    rows = [(i * 25, [float((-1) ** i * 3**i * 2.0**40), float(2.0**30 + i), 1.0]) for i in range(9)] + [(1000, [2.0**38, 1.0, 0.0]), (1001, [2.0**15, 0.0, 1.0]), (1002, [2.0**14, 2.0**14, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = sorted((tuple(r) for r in topk.top_k(df).collect()), key=str)
    assert got == plain_top(rows, 50, 5) and any(r[3] is None for r in got)


def test_threshold_stops_early_and_is_exact():
    rng = np.random.default_rng(0)
    rows = np.zeros((2000, 8), np.int32)
    rows[:, 0] = rng.integers(-50, 50, 2000)
    rows[7, 0] = 4000
    met = []
    block = topk.Lists(np.arange(2000), np.arange(2000), rows)
    take = topk.dot
    topk.dot = lambda a, b: met.append(len(a)) or take(a, b)
    try:
        scores, ids, _ = block.search(np.array([3, 0, 0, 0, 0, 0, 0, 0], np.int32), -1, 1, (np.empty(0, np.int64),) * 3)
    finally:
        topk.dot = take
    assert (scores.tolist(), ids.tolist()) == ([12000], [7]) and sum(met) < 100


def test_lines(frame, texts):
    common = "Common LINE of all"
    rows = [(d, (t or "") + f"\n {common.upper() if d % 2 else common}\t\nmore {d}") for d, t in texts] + ODD + [(d + 500, "only once " + str(d)) for d in range(5)] + [(None, common), (texts[0][0], "again\n" + common)]
    out = lines.dropped_lines(frame(rows), bits=1 << 20)
    got = sorted(((r.doc_id, r["__lines"].n_lines, r["__lines"].n_dropped, r["__lines"].text) for r in out.collect()), key=str)
    assert got == sorted(brute.line_dedup(rows), key=str)
    assert lines.dropped_lines(frame([]), bits=1 << 20).collect() == []
    kept = {r.doc_id: r.text for r in lines.deduplicated(frame([(i, f"x{i}\nSame\nsame ") for i in range(12)]), bits=1 << 20, keep_first=True).collect()}
    assert kept == {i: "x0\nSame" if i == 0 else f"x{i}" for i in range(12)}


def test_twice_filter_misses_nothing(spark):
    df = spark.range(0, 3000, 1, 6).selectExpr("pmod(id * 7919, 2500) AS v")
    for bits in (1 << 16, 1 << 20):
        found = hashfilter.seen_twice(df, lambda b: b.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), bits, 2)
        seen = found.has(np.arange(2500, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        n = np.bincount([i * 7919 % 2500 for i in range(3000)], minlength=2500)
        assert seen[n > 1].all()
    assert seen[n == 1].mean() < 0.05


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(90001, None, "en"), (90002, "", "fr"), (90003, "12 %% 34", None), (90004, "the of and in with that", None), (None, "le la de des et que", "fr")], "doc_id long, text string, lang string")
    rows = langid.identified(docs.union(odd)).join(docs.union(odd).select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.doc_id < 90000]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in (90001, 90002, 90003)] == ["und"] * 3 and by[90004].lang_pred == "en" and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in langid.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identified(docs.limit(0)).collect() == []
    kept = {r.doc_id for r in langid.accepted(docs.union(odd).withColumn("score", F.lit(1))).collect()}
    assert not kept & {90001, 90002, 90003} and len(kept) > 0.97 * docs.count()


def test_language_id_ignores_labels_of_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    swapped = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert sorted(map(tuple, langid.identified(docs).collect())) == sorted(map(tuple, langid.identified(swapped).collect()))


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><header class="site-header"><h2>Site</h2></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><div id="content"><article class="post-123"><header><h1>Title &amp; more</h1></header>
<p>One <b>bold</b>   &lt;x&gt; word&nbsp;here<br>next<p>Two &eacute;&#233; with a much longer sentence<ul><li>a<li>b</ul><div class="comments"><p>nice post, I have a lot to say about it, much more than the article</p></div>
<aside>side</aside><form><p>sub</p></form><div class="cookie-notice">We use cookies</div></article><div class=sidebar>zz</div></div><footer>f</footer></body></html>"""


def test_html_text():
    assert html.text_of(PAGE, None) == "Title & more\n\nOne bold <x> word here next\n\nTwo éé with a much longer sentence\n\na\n\nb"
    path = 0
    for tag, names in (("html", ""), ("body", ""), ("div", ""), ("article", "post-77")):
        path = html.step(path, tag, names)
    assert html.vote_of(PAGE)[0] == path
    assert [html.text_of(x, None) for x in (None, "", "<p>", "<!-- x", "<script>a")] == [""] * 5
    assert html.text_of("plain text", None) == "plain text" and html.text_of("<p>a<p>b<!-- c", None) == "a\n\nb"
    assert html.text_of("<body><div class=text><p>" + "long text " * 5000 + "</div>", None) == ("long text " * 5000).strip()


def test_host_consensus(spark):
    usual = "<body><div class='story'><p>{}</p></div><div class='list'><p>{}</p></div></body>"
    pages = [(i, "https://a.example/x", usual.format("story text of some length " * 3, "short")) for i in range(5)]
    pages += [(9, "https://a.example/odd", usual.format("brief", "a long list of other things " * 9)), (10, None, usual.format("brief", "other " * 9)), (11, "::", None), (9, "https://a.example/odd", "")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r["__text"]) for r in html.extracted(df).collect())
    assert got == sorted([(i, ("story text of some length " * 3).strip()) for i in range(5)] + [(9, "brief"), (10, ("other " * 9).strip()), (11, ""), (9, "")])
    assert html.extracted(df.limit(0)).collect() == []


def test_runs_of_a_batch_give_what_the_batch_gives():
    from modiste.llm.common import in_runs, sliced

    sizes = []

    def both(a: pa.Array, b: pa.Array) -> pa.Array:
        sizes.append(len(a))
        return pa.array([f"{x}{len(y or [])}" for x, y in zip(a.to_pylist(), b.to_pylist())])

    a, b = pa.array(["x" * (i % 7) for i in range(100)]), pa.array([[1] * (i % 5) if i % 9 else None for i in range(100)], pa.list_(pa.int32()))
    whole = both(a, b).to_pylist()
    assert in_runs(both, 200)(a, b).to_pylist() == whole and max(sizes[1:]) < 30
    assert in_runs(both, 200)(a[:0], b[:0]).to_pylist() == []
    batch = pa.RecordBatch.from_arrays([a], ["a"])
    assert [x for part in sliced([batch], 100) for x in part.column(0).to_pylist()] == a.to_pylist()


def test_texts_put_together_have_the_pieces_of_each(monkeypatch):
    rng = random.Random(6)
    texts = [bytes(rng.choices(b"abcd", k=k)) for k in (0, 49, 50, 51, 700, 3000, 20, 60, 75, 75, 400)] + [b"a" * 120, b""]
    want = [(i, at + s, n, mh) for i, t in enumerate(texts) for at, m, start, ns in suffix.stretches(t, 50) for s, n, mh in zip(start.tolist(), ns.tolist(), m.tolist())]
    for together in (60, 500, 1 << 16):
        monkeypatch.setattr(suffix, "TOGETHER", together)
        got, calls = [], 0
        for data, text, first, mh, start, n in suffix.pieces_of(texts, 50):
            calls += 1
            assert all(data[s : s + k + 49].tobytes() == texts[i][f : f + k + 49] for i, f, s, k in zip(text.tolist(), first.tolist(), start.tolist(), n.tolist()))
            got += zip(text.tolist(), first.tolist(), n.tolist(), mh.tolist())
        assert sorted(got) == sorted(want)
    assert calls == 1


@pytest.mark.parametrize("length", [5, 8, 17, 50])
def test_wide_symbols_interleave_like_bytes(length):
    rng = random.Random(length)
    base = bytes(rng.choices(b"\x00ab\xff", k=300))
    strings = [base[at : at + rng.randint(length, length + 26)] for at in (rng.randrange(200) for _ in range(40))]
    shards = [suffix.Bwt(strings[s::3], length) for s in range(3)]
    inter, places, border = suffix.interleaved(shards, length)
    texts = [[bytes((b.text[at : at + length] - 1).astype(np.uint8)) for at in p] for b, p in zip(shards, places)]
    taken = [iter(t) for t in texts]
    order = [next(taken[s]) for s in inter.tolist()]
    assert order == sorted(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
    assert border.tolist() == [i == 0 or order[i] != order[i - 1] for i in range(len(order))]
    whole, lcp = suffix.merged([suffix.Bwt(strings[s::3]) for s in range(3)], length)
    assert len(whole) == sum(len(s) + 1 for s in strings) and (lcp < length).sum() >= border.sum()


def test_filters_see_small_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = lambda b: np.repeat(np.uint64(b.num_rows), 2)  # noqa: E731  as seen twice
    got = hashfilter.seen_twice(spark.range(0, 6000, 1, 1), sizes, 1 << 20, 2)
    assert got.has(np.array([1500, 6000], np.uint64)).tolist() == [True, False]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_packed_segments_come_back():
    for n in (0, 1, 300, 4095, 4096, 50_000):
        flags = np.zeros(hashfilter.SEGMENT, bool)
        flags[random.Random(n).sample(range(hashfilter.SEGMENT), n)] = True
        part = np.packbits(flags, bitorder="little")
        data = hashfilter.packed(part)
        assert len(data) == min(2 * n, hashfilter.SEGMENT // 8) and (hashfilter.unpacked(data) == part).all()
