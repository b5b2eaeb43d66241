"""Alignment of two tokenizers against the libraries themselves, token by token."""

import collections
import hashlib
import os
import random

import numpy as np
import pytest

from gridloom.llm import queries
from gridloom.llm import token_alignment as ta
from gridloom.llm.sentencepiece_fst import read_model

pytestmark = pytest.mark.skipif(not os.path.exists(ta.BYTE_LEVEL), reason="the vocabulary files are not here")


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(ta.BYTE_LEVEL)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=ta.PIECES)
    # bytes as characters of a byte-level vocabulary, by their printable ranges
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in own)}

    def tokens(text):
        e = a.encode(" " + text, add_special_tokens=False)
        ids = b.encode(text)
        pieces = [b.id_to_piece(i) for i in ids]
        return list(e.ids), [bytes(of[ch] for ch in t) for t in e.tokens], ids, [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces, strict=True)]

    return tokens


def plain(rows):
    """One row per document, groups found by common ends, links and counts by dictionaries."""
    tokens, found, counts = libraries(), [], collections.Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            a, a_bytes, b, b_bytes = tokens(text)
            if b"".join(a_bytes) == b"".join(b_bytes) == b" " + text.encode():
                ends = [set(np.cumsum([len(x) for x in y]).tolist()) for y in (a_bytes, b_bytes)]
                at = sorted(ends[0] & ends[1])
                groups = [([], []) for _ in at]
                for k, (ids, bytes_) in enumerate(((a, a_bytes), (b, b_bytes))):
                    g = done = 0
                    for i, x in zip(ids, bytes_, strict=True):
                        done += len(x)
                        groups[g][k].append(i)
                        g += done == at[g]
        links = collections.Counter((x, y) for a, b in groups for x in a for y in b)
        counts.update(links.keys())
        found.append((doc_id, groups, links))
    best = collections.defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for doc_id, groups, links in found:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()),
            sum(n for p, n in links.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def models():
    return read_model(ta.BYTE_LEVEL), read_model(ta.PIECES)


def texts(rng):
    words = ["the", "Straße", "naïve", "日本語テキスト", "🙂🙂", "a" * 40, "x1234567", "don't", "<|endoftext|>", "<s>", "\t", "  ", "▁", " ", "fﬁ", "\r\n", "0x00", "\x00", "é"]
    return [None, "", " ", "\n", *(rng.choice([" ", "", "\n"]).join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(60))]


def test_against_the_libraries(spark, monkeypatch):
    monkeypatch.setattr(ta, "LINKS", 64)
    monkeypatch.setattr(ta, "LARGE", 2)
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(texts(rng))] + [(None, "the cat"), (3, "the cat"), (3, "the cat"), (99, "tha" * 30_000), (100, "word " * 20_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, chunk string").repartition(3)
    want = plain(rows)
    assert sum(r[1] > 0 for r in want) > 20 and sum(r[1] == 0 for r in want) > 5
    assert got(ta.alignment(df, *models(), chunk=2000)) == want
    assert got(ta.alignment(df.coalesce(1), *models())) == want


def test_empty_table(spark):
    assert got(ta.alignment(spark.createDataFrame([], "doc_id long, text string"), *models())) == []


def test_components_are_minimal_groups():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 50, 400):
        for p in (0.05, 0.3, 0.9):
            a, b = (np.append(np.flatnonzero(rng.random(n - 1) < p) + 1, n) for _ in range(2))
            both = np.intersect1d(a, b)
            x, y = ta.components(a, b)
            assert (x == np.searchsorted(both, a)).all() and (y == np.searchsorted(both, b)).all()


def test_large_groups_are_expanded_by_ids(monkeypatch):
    monkeypatch.setattr(ta, "LINKS", 10)
    a, b = np.array([1, 1, 1, 2, 9, 9]), np.array([5] * 12 + [6])
    row, pair, n = ta.links(a, np.array([0, 0, 0, 0, 1, 1]), b, np.array([0] * 12 + [1]), np.array([0, 1]))
    assert list(zip(row.tolist(), (pair >> 32).tolist(), (pair & 0xFFFFFFFF).tolist(), n.tolist(), strict=True)) == [(0, 1, 5, 36), (0, 2, 5, 12), (1, 9, 6, 2)]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        ta.ByteLevel(read_model("/opt/tokenizers/word_bpe_49k.json"))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_query_against_plain(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(queries.op12_token_alignment(spark, sf)) == plain(rows)
