"""The conversation trie against dictionaries."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from streetloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, node string, key int, piece int"


def sequences(rows, h=lambda c: zlib.crc32(str(c).encode()) % 4):
    own: dict = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t, r or "", x or ""))
    for turns in own.values():
        turns.sort(key=lambda z: ((0, 0) if z[0] is None else (1, z[0]), z[1], hashlib.sha256(f"{len(z[1])}:{z[1]}{z[2]}".encode()).digest()))
    base = lambda c: c - (c % 20 if c >= 0 else -(-c % 20))
    return {c: tuple((r, x) for _, r, x in own.get(base(c), [])[: h(c)] + own[c][h(c) :]) for c in own}


def brute(seq):
    members, kids, known, out = {}, {}, {}, []
    for c, s in seq.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    for s in members:
        if s:
            kids.setdefault(s[:-1], []).append(s)
    for s in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        below = [known[k] for k in kids.get(s, [])]
        known[s] = (len(below), sum(b[1] for b in below) or 1, (len(members[s]) - 1) * words + sum(b[2] for b in below))
    for s, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(seq[c]) == len(s))))
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), *known[s], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def order(r):
    return tuple((x is not None, x) for x in r)


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "n", 2, 3) for r in rows], SCHEMA).repartition(6)
    turns = trie.numbered_turns(df)
    heads = df.filter("conv_id IS NOT NULL").select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).alias("h"))
    got = sorted((tuple(r) for r in trie.prefix_trie(trie.rebuilt(turns, heads), heads.select("conv_id")).select(*trie.COLUMNS, "ends_sha256").collect()), key=order)
    assert got == sorted(brute(sequences(rows)), key=order)
    return got


def test_odd_rows(spark):
    rows = [(c, t, r, x) for c in (0, 1, 2, 3, 20, 21, 22, 41, -1, -7, -20, -21, 2**40) for t, r, x in ((0, "user", "hello  there\tyou"), (1, None, "x y"), (2, "user", None))]
    rows += [(5, None, "user", "first"), (5, None, "assistant", "second"), (5, 3, "a", "z"), (5, 3, "a", "z"), (5, 3, "a", "y"), (6, 0, "", "ab"), (7, 0, "a", "b"), (None, 0, "user", "lost"), (8, 9, "user", " \n"), (9, 0, "user", "w " * 200_000)]
    check(spark, rows)


def test_random_conversations_with_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS", 7)  # a node's ids are hashed in many strings
    rnd = random.Random(11)
    rows = []
    for c in rnd.sample(range(4000), 400):
        for t in range(rnd.choice([1, 1, 1, 2, 3, 5])):
            rows.append((c, t, rnd.choice(["user", "assistant"]) if t else "user", "same" if t == 0 or rnd.random() < 0.6 else f"w{rnd.randint(0, 3)} x"))
    got = check(spark, rows)
    assert max(r[3] for r in got if r[1] == 1) > 100


def test_a_long_conversation_takes_few_levels(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHAIN", 50)
    seen = []
    real = trie.written
    monkeypatch.setattr(trie, "written", lambda df, label: (seen.append(label), real(df, label))[1])
    rows = [(1, t, "user", f"t{t}") for t in range(700)] + [(2, t, "user", f"t{t}") for t in range(3)]
    check(spark, rows)
    assert seen.count("going") < 8


@pytest.mark.parametrize("n", [0, 1])
def test_small_tables(spark, n):
    assert len(check(spark, [(3, 0, "user", "one two")] * n)) == (0, 1)[n] or n
    assert check(spark, [(None, 0, "user", "x")]) == []


def test_turnless_conversation(spark):
    """Its own turns are replaced, its base has none."""
    c = next(c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    (root,) = check(spark, [(c, 0, "user", "x y")])
    assert root[:7] == (c, 0, None, 1, 0, 1, 0) and root[7] == hashlib.sha256(str(c).encode()).hexdigest()
