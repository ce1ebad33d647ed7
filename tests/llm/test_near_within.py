"""Texts that can't be near copies aren't shuffled."""

from modiste.llm import nearcopies
from modiste.scale import within


def test_within_is_a_semi_join(spark):
    rows = [(None if i % 17 == 0 else i % 900, f"t{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, text string").repartition(4)
    seen = spark.createDataFrame([(x,) for x in [3, 3, None, 899, 5000]], "k long")
    want = sorted(t for k, t in rows if k in (3, 899))
    assert sorted(r.text for r in within(df, seen, ["k"], filtered=True).collect()) == want
    assert sorted(r.text for r in within(df, seen, ["k"], filtered=False).collect()) == want


def test_sets_are_made_of_texts_a_bitmap_lets_through(spark):
    docs = spark.createDataFrame([(i, f"a b c d e f{i}") for i in range(300)], "doc_id long, text string")
    nodes = spark.createDataFrame([(5,), (5,), (250,), (999,)], "node long")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets = nearcopies.sets_of(docs, nodes, 5)
        assert sorted((r.node, len(r["set"]) // 8) for r in sets.collect()) == [(5, 2), (250, 2)]
        assert "bit_get" in sets._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
