"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import random

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from modiste.llm import html, lines, nearcopies, suffix

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sentences(rng, n):
    return ["".join(rng.choices("abcdefghij", k=5)) + " " + " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(8)) for _ in range(n)]


def test_copies_leave_one_whole_text(spark):
    rng = random.Random(11)
    equal, near = "\n".join(sentences(rng, 6)), sentences(rng, 12)
    rows = [(i, equal) for i in range(100, 112)] + [(200, equal)] * 2
    rows += [(300 + i, "\n".join([*near[:i], f"only in {i}", *near[i + 1 :]])) for i in range(12)]
    rows += [(400 + i, "\n".join([*sentences(rng, 5), "Seen everywhere"])) for i in range(12)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], COLUMNS).repartition(3)
    out = corpus_pipeline.STAGES[1][1](spark, docs, "")
    got = {}
    for r in out.collect():
        assert r.n_chars == len(r.text)
        got.setdefault(r.doc_id, []).append(r.text)
    assert got[100] == [equal] and all(t == "" for d in [*range(101, 112), 200] for t in got[d])
    left = "\n".join(t for i in range(12) for t in got[300 + i]).split("\n")
    assert all(left.count(line) == 1 for line in near) and got[300] == [rows[14][1]]
    assert not any("Seen everywhere" in t for i in range(12) for t in got[400 + i])
    after = [r.text for r in corpus_pipeline.STAGES[2][1](spark, out, "").collect()]
    assert after.count(equal) == 1


def test_one_row_of_equal_rows_keeps_the_lines(spark):
    rows = [(None, "same\ntext")] * 6 + [(7, "same\ntext")] * 6
    out = lines.without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bits=1 << 20).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == [(0, "")] * 6 + [(7, "")] * 5 + [(7, "same\ntext")]


#: of one minimizer, with equal xxh32
EQUAL_32 = [
    ("mzifuenmayejzudnfsenkgrqincaxcvmkrnsovoxjhqsspuerw", "yzwmfwjbvstduudnfsenkgrqincaxcvmkrnsogutpmvausukfd"),
    ("krmbolfxhmerwudnfsenkgrqincaxcvmkrnsorxzvlotudkeie", "tgtfssutvzhyfudnfsenkgrqincaxcvmkrnsolgudvmglyelgc"),
    ("bgzncdwmbleuhudnfsenkgrqincaxcvmkrnsokgesbwoqpopin", "okyetixkjqrwludnfsenkgrqincaxcvmkrnsoqbtgsnzjipecg"),
]


@pytest.mark.parametrize("many", [suffix.MANY, 1])
def test_pieces_of_one_minimizer_stay_apart(spark, frame, many, monkeypatch):
    monkeypatch.setattr(suffix, "MANY", many)
    rows = [(i * 2 + k, t) for i, pair in enumerate(EQUAL_32) for k, t in enumerate(pair)]
    out = suffix.without_repeats(frame(rows), 50, 1 << 20).select("doc_id", F.octet_length("text"), "__cut.n_removed", "__cut.n_spans", F.sha2("__cut.kept", 256))
    assert sorted(map(tuple, out.collect())) == sorted(brute.substrings(rows))


def test_consensus_of_a_host_with_many_templates(spark):
    page = "<body><div class='{}'><p>{}</p></div><div class='list'><p>{}</p></div></body>"
    names, story, other = ["q" + chr(97 + i) for i in range(20)], "story text of some length " * 3, "other things " * 20
    pages = [(100 * i + k, "https://a.example/x", page.format(f"story-{n}", story, "short")) for i, n in enumerate(names) for k in range(3)]
    pages += [(5000 + i, "https://a.example/odd", page.format(f"story-{n}", "brief", other)) for i, n in enumerate(names)]
    pages += [(9000 + k, None, page.format("story-qa", story, "short")) for k in range(3)] + [(9009, "no url", page.format("story-qa", "brief", other))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r["__text"] for r in html.extracted(df).collect()}
    assert len(got) == len(pages) and got[9009] == other.strip()
    # the odd pages give their list 20 votes, more than any story has
    assert all(got[5000 + i] == other.strip() for i in range(20))
    few = [p for p in pages if p[0] < 5000] + [(5000 + i, "https://a.example/odd", p[2].replace("'list'", f"'list-{names[i]}'")) for i, p in enumerate(pages[60:80])]
    got = {r.page_id: r["__text"] for r in html.extracted(spark.createDataFrame(few, "page_id long, url string, html string").repartition(3)).collect()}
    assert [got[5000 + i] for i in range(20)] == ["brief"] * 20


def jaccard(a, b, width=5):
    sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in (brute.words(a), brute.words(b))]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_of_five_word_shingles(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(3000)]
    rows, gone = [], set()
    for i in range(150):
        base = rng.choices(words, k=rng.choice([120, 200, 500]))
        other = list(base)
        for at in rng.sample(range(5, len(base) - 5), rng.randint(1, len(base) // 30)):
            other[at] = "changed"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
        if jaccard(rows[-2][1], rows[-1][1]) >= 0.8:
            gone.add(2 * i + 1)
    assert 50 < len(gone) < 150
    hub = rng.choices(words, k=200)  # many near copies of one text, each with a word of its own
    rows += [(1000 + i, " ".join([*hub[:i], f"own{i}", *hub[i + 1 :]])) for i in range(60)]
    gone |= set(range(1001, 1060))
    # short texts that aren't alike stay, copies and empty texts go; a repeated doc_id is one document
    rows += [(2000, "the of and in"), (2001, "the of and on"), (2002, "THE of  and in"), (2003, ""), (2004, None), (2005, " "), (None, "the of and in"), (2006, "one two three"), (2006, "four five six")]
    gone |= {2002, 2004, 2005}
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, a string, h int").repartition(3)
    kept = sorted((r.doc_id for r in nearcopies.deduplicated(df).collect()), key=str)
    assert kept == sorted((d for d, _ in rows if d not in gone), key=str)
    stage = corpus_pipeline.STAGES[2][1](spark, df, "")
    assert stage.columns == df.columns and stage.count() == len(kept) and not corpus_pipeline.STAGES[2][1](spark, df.limit(0), "").collect()


def test_unsettled_clusters_are_compared_block_by_block(spark, monkeypatch):
    """A chain of texts whose first one isn't alike to most: clusters over several blocks, pairs of every two blocks."""
    monkeypatch.setattr(nearcopies, "BLOCK", 8)
    rng = random.Random(13)
    text = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(120)]
    rows, at = [], list(text)
    for i in range(70):
        rows.append((i, " ".join(at)))
        for k in rng.sample(range(120), 2):
            at[k] = f"new{i}x{k}"
    base = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(150)]
    for i in range(60):  # many texts of one origin, alike by two thirds: none is linked but by chance
        other = list(base)
        for k in rng.sample(range(150), 5):
            other[k] = f"o{i}x{k}"
        rows.append((1000 + i, " ".join(other)))
    rng.shuffle(rows)
    first = brute.shingle_groups(rows)
    assert len({first[d] for d, _ in rows if d < 1000}) < 10 and len({first[d] for d, _ in rows if d >= 1000}) > 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in nearcopies.deduplicated(df).collect()) == sorted(d for d, _ in rows if first[d] == d)


def test_common_shingles_of_all_pairs():
    rng = random.Random(3)
    import numpy as np

    for n, universe, size in [(2, 5, 4), (30, 60, 20), (40, 3000, 50), (25, 40, 40)]:
        sets = [np.unique(np.array([rng.randrange(universe) for _ in range(rng.randint(1, size))], np.uint64)) for _ in range(n)]
        got = nearcopies.common_shingles(sets)
        assert all(got[i, j] == len(set(sets[i].tolist()) & set(sets[j].tolist())) for i in range(n) for j in range(n) if i != j)
