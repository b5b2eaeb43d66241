"""The pipeline's stages on a small corpus with planted cases, and its registration."""

import collections
import os
import random

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from gridloom.llm import common as c
from gridloom.llm import sentencepiece_fst as sp
from tests.llm.test_corpus import DOCS, docs_frame, odd_rows, plain_leaks, plain_line_dedup, plain_qda, sentence


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(17)
    d = str(tmp_path_factory.mktemp("sf"))
    item = sentence(rng, 30)
    good = {i: "\n".join(sentence(rng, 12).capitalize() + "." for _ in range(8)) for i in range(80)}
    texts = dict(good)
    texts[100] = good[0]  # a copy
    words = good[1].split(" ")
    texts[101] = " ".join([*words[:40], "edited", *words[41:]])  # a near copy
    texts[102] = sentence(rng, 40) + " " + item + " " + sentence(rng, 40)  # a leak
    shared = "\n".join(sentence(rng, 20) for _ in range(4))
    for i in (103, 104):
        texts[i] = "\n".join([sentence(rng, 30), shared, sentence(rng, 30)])
    for i in range(200, 240):
        texts[i] = " ".join(w.upper() + "!!" for w in sentence(rng, 80).split())
    spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, good, texts, shared


def test_stages(spark, sf):
    d, good, texts, shared = sf
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = []
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, d)
        seen.append({r.doc_id: r for r in docs.collect()})
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == [x.split()[0] for x in DOCS.split(", ")]
    quality, lines, near, clean, ids = seen
    assert set(quality) == {i for i in texts if i < 200}
    assert 100 not in lines and shared in lines[103].text and shared not in lines[104].text and lines[104].n_chars == len(lines[104].text)
    assert 101 not in near or len(near[101].text) < len(good[1])  # what its line dedup left may stay
    assert 102 in near and 102 not in clean
    assert set(good) <= set(ids) and all(r.round_trip for r in ids.values())
    assert ids[5].ids == sp.compiled(sp.read_model()).encode(good[5])
    assert {r.doc_id for r in pipeline.run(spark, d).collect()} == set(ids)


def components(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if root(a) != root(b) and linked(a, b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(x) for x in range(n)]


def plain_pipeline(rows, labels, items):
    """Ids and pieces of what run() keeps: every stage by its definition, all pairs compared. rows: (doc_id, text), in the order of their ids."""
    import numpy as np
    import sentencepiece

    value, _, _ = plain_qda(rows, labels)
    rows = [r for r, v in zip(rows, value, strict=True) if v > 0]  # the classes of the test are far apart, so the curve's place doesn't matter
    texts = plain_line_dedup([(i, t, "") for i, t in rows])
    rows = [(i, new) for (i, old), new in zip(rows, texts, strict=True) if old is None or new == old or new.split()]
    shingles = []
    for _, t in rows:
        w = (t or "").lower().split()
        shingles.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    same = lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])
    roots = components(len(rows), same)
    rows = [r for k, r in enumerate(rows) if roots[k] == k]
    leaking = {i for i, _ in plain_leaks(rows, items)}
    own = sentencepiece.SentencePieceProcessor(model_proto=sp.read_model())
    assert np.isfinite(value).all()
    return {i: own.encode(t) if t is not None else None for i, t in rows if i not in leaking}


def test_run_against_plain(spark, tmp_path):
    rng = random.Random(29)
    items = [(k, sentence(rng, 25)) for k in range(3)]
    good = ["\n".join(sentence(rng, rng.randint(8, 20)).capitalize() + "." for _ in range(rng.randint(4, 9))) for _ in range(60)]
    texts = list(good)
    for k in range(40):
        kind, base = k % 5, rng.choice(good)
        words = base.replace("\n", " ").split(" ")
        if kind == 0:
            texts.append(base)
        elif kind == 1:  # near copies, on one line, so that line dedup leaves them
            for _ in range(rng.choice([1, 1, 2, 4])):
                words[rng.randrange(len(words))] = "edited"
            texts.append(" ".join(words))
        elif kind == 2:
            texts.append(sentence(rng, 30) + " " + rng.choice(items)[1] + " " + sentence(rng, 30))
        elif kind == 3:
            texts.append("\n".join([sentence(rng, 12), *base.split("\n")[:3], sentence(rng, 12)]))
        else:
            texts.append(" ".join(w.upper() + "!!" for w in sentence(rng, 80).split()))
    junk = {i for i, t in enumerate(texts) if "!!" in t}
    rows = list(enumerate(texts))
    labels = [(i, int(i not in junk)) for i in range(len(rows))]
    spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r.ids for r in pipeline.run(spark, str(tmp_path)).collect()}
    want = plain_pipeline(rows, labels, items)
    assert got == want and 50 < len(want) < 90


def chain(spark, docs, d):
    seen = []
    for name, stage in pipeline.STAGES:
        docs = c.cut(stage(spark, docs, d), "chain")
        seen.append(docs)
    return seen


def test_stages_on_odd_tables(spark, sf):
    """Nulls, empty and very long texts, repeated rows and columns with the names that operators use themselves."""
    d = sf[0]
    docs = docs_frame(spark, odd_rows(random.Random(3)))
    for name in ("rid", "node", "key", "h1", "fp", "text_hash", "pos", "removed", "ids", "score", "llm_hash"):
        docs = docs.withColumn(name, F.lit(name))
    *stages, last = chain(spark, docs, d)
    before = docs.count()
    for out in stages:
        assert set(docs.columns) - {"removed"} <= set(out.columns) and out.count() <= before
        before = out.count()
    near = collections.Counter((r.doc_id, r.text) for r in stages[2].collect())
    assert max(near.values()) == 1 and len([k for k in near if not (k[1] or "").strip()]) <= 1
    assert last.columns == ["doc_id", "ids", "n_tokens", "round_trip"] and last.count() == stages[-1].count()


def test_stages_on_empty_tables(spark, sf, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    assert [x.count() for x in chain(spark, docs, sf[0])] == [0] * 5
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    some = docs_frame(spark, [(1, "one two three", "a"), (None, "four five six", "a"), (2, None, "a")])
    assert [x.count() for x in chain(spark, some, str(tmp_path))] == [3] * 5


def test_registered(spark):
    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


def test_nothing_else_imports_the_operators():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for top, _, files in os.walk(f"{root}/gridloom"):
        if "/llm" not in top:
            for f in files:
                if f.endswith(".py"):
                    assert "llm" not in open(f"{top}/{f}").read().replace("llm-", ""), f
