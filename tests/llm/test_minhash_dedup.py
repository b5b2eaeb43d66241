"""MinHash near-dedup against all pairs of full sets."""

import os
import random

import duckdb
import numpy as np
import pytest

from gridloom.llm import common as c
from gridloom.llm import minhash_dedup as md
from gridloom.llm import queries, sql

SCHEMA = "doc_id long, text string, node string"


def shingles(text, k=2):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate({x: x + 32 for x in range(65, 91)})) if w]
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def plain(rows, percent=80):
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    out = []
    for i, r in enumerate(rows):
        comp = least.get(find(i)) if sets[i] else r[0]
        out.append((r[0], len(sets[i]), comp, r[0] == comp))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def edited(rng, words, share):
    return [rng.choice("abcdefghij") * rng.randint(3, 9) if rng.random() < share else w for w in words]


def near_copies(rng, groups=12, members=12, n=60):
    """Groups of edited copies whose similarities gather around the threshold, in long and short texts."""
    rows, doc = [], 0
    for _ in range(groups):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([4, 6, n, n]))]
        for _ in range(members):
            rows.append((doc := doc + rng.randint(1, 5), " ".join(edited(rng, base, rng.choice([0, 0.02, 0.05, 0.06]))), "x"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,members,most", [(1, md.MEMBERS, md.MOST), (2, 3, 150), (3, 2, 400)])
def test_against_all_pairs(spark, seed, members, most):
    rows = near_copies(random.Random(seed))
    want = plain(rows)
    assert 0 < sum(not r[3] for r in want) < len(rows)
    assert got(md.near_duplicates(spark.createDataFrame(rows, SCHEMA), members=members, most=most)) == want


def test_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(120_000))
    rows = [
        (1, None, None), (2, "", ""), (3, " \n\t", None), (None, None, None), (9, "One", None), (4, "one", None), (5, "one two", None), (6, "ONE\ttwo ", None), (6, "ONE\ttwo ", None), (None, "one two", None),
        (None, "nobody else says this", None), (7, long, None), (8, long + " end", None), (10, "a b c d e", None), (11, "a b c d e f", None), (12, "a b c d", None), (0, "é É", None), (20, "é É", None),
    ]
    assert got(md.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    assert got(md.near_duplicates(spark.createDataFrame([], SCHEMA))) == []


def test_one_large_group_stays_linear(spark):
    """Rows handed to tasks grow with a group, not with its square, while what stands outside its largest component doesn't."""
    handed = []
    for n in (400, 1600):
        rows = spark.createDataFrame([(0, i, 0 if i >= 30 else i, 0.1, 50) for i in range(n)], "leader long, node long, root long, distance double, n_shingles long")
        tasks = md.dealt(rows, 2_000)
        sizes = [r["count"] for r in tasks.groupBy("task").count().collect()]
        assert max(sizes) < 3 * 2_000 / 50  # parts are even but for the hash's chance
        pairs = tasks.alias("x").join(tasks.alias("y"), "task").filter("x.node < y.node AND x.root != y.root AND (x.side != y.side OR x.side = 0)").select("x.node", "y.node").distinct().count()
        assert pairs == 29 * 30 // 2 + 30 * (n - 30) - (n - 30)  # each pair of two roots meets; node 0 has the root of the large component
        handed.append(sum(sizes))
    assert handed[1] < 4.5 * handed[0]


def test_signature_coordinates_agree_as_often_as_sets_do():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.8):
        n = 300
        common = int(2 * n * share / (1 + share))
        hits = []
        for _ in range(60):
            x = rng.integers(0, 2**63, 2 * n - common, dtype=np.uint64)
            a, b = x[:n], x[n - common :]
            s = md.signature(np.concatenate([a, b]), np.array([0, n]))
            hits.append((s[0] == s[1]).mean())
        assert abs(np.mean(hits) - common / (2 * n - common)) < 0.015
    # a small set: five elements, each the least one equally often
    least = md.signature(np.arange(5, dtype=np.uint64), np.array([0]), 6000)[0]
    each = [md.signature(np.arange(5, dtype=np.uint64)[i : i + 1], np.array([0]), 6000)[0] for i in range(5)]
    assert all(abs((least == e).mean() - 0.2) < 0.03 for e in each)


def test_signature_does_not_depend_on_its_neighbours(monkeypatch):
    values = np.random.default_rng(3).integers(0, 2**63, 500, dtype=np.uint64)
    starts = np.array([0, 10, 11, 200, 499])
    whole = md.signature(values, starts)
    monkeypatch.setattr(md, "BLOCK", 16)
    assert (md.signature(values, starts) == whole).all()
    assert (md.signature(values[200:499], np.array([0])) == whole[3]).all()
    assert md.bands(whole).shape == (5, md.BANDS) and len(np.unique(md.bands(whole))) == 5 * md.BANDS


def test_shared():
    a, b = np.array([1, 5, 9, 12], np.uint64), np.array([5, 9, 20], np.uint64)
    assert md.shared(a, b) == md.shared(b, a) == 2 and md.shared(a, np.zeros(0, np.uint64)) == 0


def test_groups_apart_against_all_pairs():
    rng = random.Random(4)
    for side in (False, True):
        base = list(range(50))
        sets = [np.unique(np.array([x if rng.random() > 0.08 else rng.randrange(100, 10**6) for x in base], np.uint64)) for _ in range(60)]
        leader = sets[0]
        d = np.array([1 - md.shared(leader, s) / (len(leader) + len(s) - md.shared(leader, s)) for s in sets])
        order = np.argsort(d, kind="stable")
        sets, d = [sets[i] for i in order], d[order]
        root, sides = np.array([rng.randrange(20) for _ in sets]), np.array([rng.choice([1, 2]) if side else 0 for _ in sets])
        a, b = md.apart_links(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), root, d, sides, 80)
        find = list(range(20))

        def top(x, find=find):
            while find[x] != x:
                x = find[x]
            return x

        for i in range(60):
            for j in range(i):
                n = md.shared(sets[i], sets[j])
                if (not side or sides[i] != sides[j]) and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                    find[max(top(root[i]), top(root[j]))] = min(top(root[i]), top(root[j]))
        mine = list(range(20))
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            assert top(x, mine) != top(y, mine)  # a forest
            mine[max(top(x, mine), top(y, mine))] = min(top(x, mine), top(y, mine))
        assert [top(x) for x in range(20)] == [top(x, mine) for x in range(20)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(sql.OP13)
    assert {d[0] for d in want.description} == {"doc_id", "n_shingles", "component_id", "kept"}
    assert got(queries.op13_minhash_dedup(spark, sf)) == sorted(want.fetchall(), key=str)
    assert c.SOLID[ord("a")]
