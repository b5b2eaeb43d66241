"""The conversation trie against a plain one, turn by turn."""

import hashlib
import os
import random
import zlib

import duckdb
import pytest

from gridloom.llm import prefix_trie as pt
from gridloom.llm import queries, sql

SCHEMA = "conv_id long, turn long, role string, text string, extra string"


def ordered(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {conv: [x[2:] for x in sorted(said)] for conv, said in own.items()}


def plain_rebuilt(convs):
    out = {}
    for conv, own in convs.items():
        h = zlib.crc32(str(conv).encode()) % 9
        out[conv] = convs.get(conv - conv % 5, [])[:h] + own[h:]
    return out


def plain_trie(convs):
    members = {}
    for conv, said in convs.items():
        for d in range(len(said) + 1):
            members.setdefault(tuple(said[:d]), []).append(conv)
    out = []
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = ",".join(str(x) for x in sorted(own) if len(convs[x]) == len(node))
        out.append((
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own), sum(len(n) == len(node) + 1 for n in below),
            sum(not any(m[:-1] == n for m in below if m) for n in below), sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(rng, n):
    """Conversations with common beginnings, copies, nulls, empty texts and repeated rows."""
    words = ["", "one", "two", "é", None]
    rows = []
    for conv in rng.sample(range(3 * n), n):
        for turn in range(rng.choice([1, 1, 2, 3, 9, 14])):
            rows.append((conv, turn if turn else rng.choice([0, None]), rng.choice(["user", "user", None]), words[min(4, int(rng.expovariate(1.5)))], "x"))
    same = [(4000 + i, t, "user", f"same {t}", None) for i in range(12) for t in range(4)]
    return rows + same + [(None, 1, "user", "nobody's", None), *rows[:2]]


@pytest.mark.parametrize("seed", [1, 2])
def test_rebuilt_against_plain(spark, seed):
    rows = made(random.Random(seed), 60)
    assert got(pt.family_trie(spark.createDataFrame(rows, SCHEMA))) == plain_trie(plain_rebuilt(ordered(rows)))


def test_as_they_are_with_small_blocks(spark):
    rows = made(random.Random(3), 40) + [(7, t, "user", "long" * (t % 3), None) for t in range(50, 90)]
    assert got(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA), block=4)) == plain_trie(ordered(rows))


def test_without_turns_or_rows(spark):
    # 1 starts with turns of 0, which is absent, and has no more of its own than it gives up
    few = [(1, 0, "user", "gone", None)]
    assert zlib.crc32(b"1") % 9 >= 1
    assert got(pt.family_trie(spark.createDataFrame(few, SCHEMA))) == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]
    assert got(pt.family_trie(spark.createDataFrame([], SCHEMA))) == []
    assert got(pt.family_trie(spark.createDataFrame([(None, None, None, None, None)], SCHEMA))) == []


def test_very_long_text_and_many_ends(spark, monkeypatch):
    monkeypatch.setattr(pt, "ENDS_BITS", 2)
    rows = [(i, 0, "user", "x" * 300_000, None) for i in range(40)]
    assert got(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain_trie(ordered(rows))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = con.execute(sql.OP11)
    df = queries.op11_prefix_trie(spark, sf)
    assert [d[0] for d in want.description] == df.columns
    assert got(df) == sorted(want.fetchall(), key=str)
