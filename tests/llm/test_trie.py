"""The prefix trie against a plain loop over all prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import brute
import pytest

from modiste.llm import trie

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "conv_id long, turn long, role string, text string, depth int, x1 string, slice int"


def plain(rows, every=20, most=4):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, (role or "") + "\0" + (text or ""), role or "", text or ""))
    said = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    rebuilt = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - int(c % every if c >= 0 else -(-c % every))
        rebuilt[c] = [*said.get(base, [])[:h], *own[h:]]
    members = defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = defaultdict(set)
    for k in members:
        if k:
            kids[k[:-1]].add(k)
    out = []

    def walk(k):  # children first
        leaves, saved = (0 if kids[k] else 1), (len(members[k]) - 1) * (len(brute.words(k[-1][1])) if k else 0)
        for x in kids[k]:
            a, b = walk(x)
            leaves, saved = leaves + a, saved + b
        ends = ",".join(map(str, sorted(c for c in members[k] if len(rebuilt[c]) == len(k))))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if rebuilt:
        walk(())
    return sorted(out, key=str)


def got(spark, rows, parts=5, **how):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], COLUMNS).repartition(parts)
    return sorted(map(tuple, trie.described(df, **how).collect()), key=str)


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(spark, rows) == plain(rows)


def test_nulls_ties_repeats_and_negative_ids(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(45), -3, -20, -41, 1 << 40, None]:
        for _ in range(rng.randint(1, 6)):
            rows.append((c, rng.choice([None, 0, 1, 2, 3]), rng.choice([None, "", "user", "assistant"]), rng.choice([None, "", " \t", "one two", "ONE  two\n", "é x"])))
    rows += rows[:20]
    assert got(spark, rows) == plain(rows)


def test_equal_conversations_in_long_lists(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 7)
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(3)] + [(1000 + c, t, "user", f"turn {t}") for c in range(40) for t in range(1 + c % 5)]
    assert got(spark, rows) == plain(rows)


def test_a_conversation_over_many_slices(spark):
    rows = [(7, t, "user", f"w{t % 3} x") for t in range(900)] + [(0, t, "user", f"w{t % 3} x") for t in range(700)] + [(c, 0, "user", "w0 x") for c in range(8, 15)]
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(41, 0, "user", "a")], [(c, 0, "u", "b") for c in range(1, 19)], [(3, 0, "user", "long " * 300_000), (3, 1, None, "long " * 300_000 + "x")]])
def test_little_and_much(spark, rows):
    assert got(spark, rows) == plain(rows)


def test_other_parameters(spark):
    rows = [(c, t, "user", f"{c % 3} {t}") for c in range(30) for t in range(4)]
    assert got(spark, rows, every=7, most=3) == plain(rows, 7, 3)
