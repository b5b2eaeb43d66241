"""Each operator against a plain version of itself, and on odd tables: nulls, empty and long texts, ties, repeats, extra columns."""

import collections
import glob
import math
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import common as c
from gridloom.llm import decontaminate as dc
from gridloom.llm import html_blocks as hb
from gridloom.llm import line_dedup as ld
from gridloom.llm import lm_scoring as lm
from gridloom.llm import quality_qda as qda
from gridloom.llm import quality_rules as qr
from gridloom.llm import sentencepiece_fst as sp
from gridloom.llm import simhash_dedup as sd
from gridloom.llm import sql
from gridloom.llm import token_shards as ts
from gridloom.llm import url_filter as uf

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te", "so", "né", "pö") for b in ("n", "ra", "st", "vi", "x", "da")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def odd_rows(rng):
    """Null ids and texts, empty, blank and very long texts, repeated rows, ties, one line of the document's length."""
    long = "\n".join(sentence(rng, 12) for _ in range(2500))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n\x0b ", None), (None, "one two three", "b"), (None, None, None), (4, long, "a"), (4, long, "a"), (5, long, "b"), (6, "x" * 70_000, "b"), (7, "a", "a"), (8, "b", "a"), (9, "ba\nab\n\nba\nab\nba", "a")]
    return rows + [(10 + i, sentence(rng, 60), "a") for i in range(5)] + [(20, sentence(rng, 3), None)]


@pytest.fixture(scope="module")
def odd(spark):
    df = docs_frame(spark, odd_rows(random.Random(3)))
    for name in ("fp", "rid", "bucket", "node", "k1", "llm_k1", "text_hash", "pos", "removed", "ids", "score", "stats", "host", "record"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# --- kernels


def test_words_lines_and_hashes():
    import pyarrow as pa

    texts = ["a b\tc", "", None, "né\u00a0x  y\n", "\n\n", "same a same"]
    data, off = c.flat(pa.array(texts))
    ws, we = c.runs(c.SOLID[data], off)
    got = [bytes(data[a:b]).decode() for a, b in zip(ws, we, strict=True)]
    assert got == [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    ls, le, row = c.line_spans(data, off)
    assert [bytes(data[a:b]).decode() for a, b in zip(ls, le, strict=True)] == [x for t in texts for x in (t or "").split("\n")]
    h = c.span_hashes(data, ws, we)
    assert len(set(h.tolist())) == len(set(got))
    assert h[got.index("a")] == h[len(got) - 1 - got[::-1].index("a")]


def test_row_hashes_have_no_structure():
    """Short words in different rows must not collide: their hashes are those of small numbers."""
    h = c.span_hashes(np.arange(256, dtype=np.uint8), np.arange(256), np.arange(1, 257))
    every = c.in_row(np.tile(h, 300), np.repeat(np.arange(300), 256))
    assert len(np.unique(every)) == len(every)


def two_letters(n):
    """Two texts of a and b that polynomial hashes modulo 2**64 cannot tell apart, whatever their base."""
    a = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return a, a.translate({97: 98, 98: 97})


def test_hashes_tell_texts_of_two_letters_apart():
    import pyarrow as pa

    data, off = c.flat(pa.array([x for n in (1024, 2048, 4096) for x in two_letters(n)]))
    assert len(set(c.span_hashes(data, off[:-1], off[1:]).tolist())) == 6
    assert len(set(map(tuple, c.digests(data, off[:-1], off[1:]).tolist()))) == 6


def test_hashes_across_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4000, 300)
    ends = starts + rng.integers(0, 1000, 300)
    want = c.span_hashes(data, starts, ends)
    monkeypatch.setattr(c, "_SUMMED", 700)
    assert (c.span_hashes(data, starts, ends) == want).all()
    again = np.concatenate([data[a:b] for a, b in zip(starts, ends, strict=True)])
    off = np.concatenate([[0], np.cumsum(ends - starts)])
    assert (c.span_hashes(again, off[:-1], off[1:]) == want).all()


@pytest.mark.parametrize("pad", ["", "0123456789", "0123456789abcdefgh"])
def test_lookup_compares_bytes(monkeypatch, pad):
    """Strings with one hash: the first is kept, the others are refused, however late they differ."""
    parts = [x.encode() for x in (pad + "one", pad + "two", pad + "six", pad + "one", pad + "on", "")]
    data, size = np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts])
    at = np.cumsum(size) - size
    give = lambda i: (np.full(len(i), 2), np.repeat(at[i], 2))
    t = c.Lookup(np.int32, 100)
    got = t.learned(data, at, size, give)
    assert len(set(got.tolist())) == 5 and got[0] == got[3] and (got == t.learned(data, at, size, None)).all()
    assert t.ids(got[[0, 2]]).tolist() == [at[0], at[0], at[2], at[2]]
    monkeypatch.setattr(c.Lookup, "_hash", staticmethod(lambda low, high, data, starts, sizes: np.full(len(low), 7, np.uint64)))
    t = c.Lookup(np.int32, 100)
    assert t.learned(data, at, size, give).tolist() == [0, -2, -2, 0, -2, -2]
    monkeypatch.undo()
    assert (c.Lookup(np.int32, 1).learned(data, at, size, None) == -2).all()


def test_table_grows():
    rng = np.random.default_rng(4)
    keys = np.unique(c.mix(rng.integers(1, 2**40, 50_000).astype(np.uint64)))
    t = c.Table(16)
    for part in np.array_split(np.arange(len(keys)), 7):
        t.add(keys[part], part.astype(np.int32))
    assert (t.find(keys) == np.arange(len(keys))).all() and (t.find(c.mix(keys)) == -1).all()


# --- 1


def plain_line_dedup(rows):
    """Texts in the order of the rows, which is that of their ids."""
    seen, out = set(), []
    for _, text, _ in rows:
        all_lines = (text or "").split("\n")
        lines = [(k, line.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})) for k, line in enumerate(all_lines) if line.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for n in (1, 2, 3):
            for p in range(len(lines) - n + 1):
                w = tuple(x for _, x in lines[p : p + n])
                if n == 3 or len(lines) == n or len(" ".join(w).split()) > ld.LONG:
                    if w in seen:
                        gone |= set(range(p, p + n))
                    seen.add(w)
        drop = {lines[p][0] for p in gone} | {k for p in gone if p + 1 in gone for k in range(lines[p][0], lines[p + 1][0])}
        out.append(None if text is None else "\n".join(x for k, x in enumerate(all_lines) if k not in drop))
    return out


def test_line_dedup_against_plain(spark):
    rng = random.Random(5)
    pool = [sentence(rng, 4) for _ in range(5)]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) + ("" if rng.random() < 0.8 else "  ") for _ in range(rng.randint(0, 9))]
        rows.append((i, "\n".join(x if rng.random() < 0.9 else x.upper() + "\n" for x in lines), rng.choice("ab")))
    long = [sentence(rng, 60), sentence(rng, 30), sentence(rng, 30)]
    for i in range(60, 80):  # passages that fill one or two lines
        rows.append((i, "\n".join([sentence(rng, 5), *rng.choice([long[:1], long[1:], long[2:], []]), sentence(rng, 5)]), "a"))
    got = {r.doc_id: r.text for r in ld.line_dedup(docs_frame(spark, rows)).collect()}
    assert [got[r[0]] for r in rows] == plain_line_dedup(rows)
    assert sum(len(got[r[0]]) < len(r[1]) for r in rows) > 20
    assert sum(long[0] in t for t in got.values()) == 1


def test_line_dedup_repeated_rows(spark):
    text = "\n".join(sentence(random.Random(k), 4) for k in range(4))
    rows = [(1, text, "a")] * 3 + [(None, text, "a")] * 2 + [(2, "x", "a"), (2, "x", "a"), (3, None, "a"), (3, None, "a")]
    got = collections.Counter((r.doc_id, r.text) for r in ld.line_dedup(docs_frame(spark, rows)).collect())
    assert got == {(None, text): 1, (None, ""): 1, (1, ""): 3, (2, "x"): 1, (2, ""): 1, (3, None): 2}


def test_line_dedup_keeps_lines_of_two_letters(spark):
    a, b = two_letters(2048)
    rows = [(1, f"{a}\n{b}\n{a}", "x"), (2, f"{b}\n{a}\n{b}", "x")]
    assert {r.doc_id: r.text for r in ld.line_dedup(docs_frame(spark, rows)).collect()} == {i: t for i, t, _ in rows}


def test_line_dedup_odd(odd, none):
    out = ld.line_dedup(odd)
    rows = out.collect()
    assert len(rows) == odd.count() and set(odd.columns) - {"removed"} <= set(out.columns)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[1][0].text is None and by[2][0].text == "" and by[9][0].text == "ba\nab\n"  # its third window is its first again
    assert sorted(r.n_removed for r in by[4]) == [0, 2500] and by[5][0].text == ""  # of equal rows one stays
    assert ld.line_dedup(none).count() == 0


# --- 2

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a = "</p><p>no";</script></head><body>
<header class="site-header"><p>A site with a long and winding motto, that nobody reads to the end of it.</p></header>
<nav><ul><li><a href="/">Home</a><li><a href="/n">News</a></ul></nav><!-- ad --><div class="ad">Buy one thing now, and get another thing later for free.</div>
<div class="cookie-consent"><p>We use cookies to do what cookies do; read on and you agree with all of it.</p></div>
<article><header><h1>Head &lt;1&gt;</h1></header><p>First   para&shy;graph,\n with <b>bold</b><i>italic</i> &amp; <a href="/x">a link</a>.<br>Next line<p>Unclosed second.
<aside><p>An aside with words that are no part of the article at all.</p></aside><ul><li>One</li><li>Two</ul><blockquote>Quoted 5 < 6 words.</blockquote>
<form><p>Give us your mail address and we shall write to you each day.</p><input type=text></form><p hidden>secret</p><p></p><p>Last &#8364; &#x20AC; &nbsp; &unknown; end.</p>
<section id="comments"><h2>Comments</h2><p>I am a reader and I have an opinion on all of this.</p></section></article>
<div class="sidebar"><p>Other things that you might also like to read on this site today.</p></div><footer>&copy; 2020 All rights reserved by the people who made this.</footer></body>"""


def test_html_main_text():
    assert hb.main_text(PAGE).split("\n") == ["Head <1>", "First para\u00adgraph, with bolditalic & a link. Next line", "Unclosed second.", "One", "Two", "Quoted 5 < 6 words.", "Last € € &unknown; end."]


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "<p>", "</p></p>", "<!-- x", "<script>a", "<p a='b>c</p>", "x" * 100_000, "<p>" * 5000, "<div>" * 3000 + "deep"])
def test_html_odd_pages(page):
    assert isinstance(hb.main_text(page), str)


def test_html_pages_without_article():
    text = " ".join(["The river rose again in the night, and the people of the town went up the hill."] * 3)
    page = f"<div><a href=/>Home</a> <a href=/b>World</a> <a>Sport</a></div><p>{text}</p><p>{text}</p><div><a>Terms</a> <a>Privacy</a></div>"
    assert hb.main_text(page) == f"{text}\n{text}"


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-comments", "post-share-enabled", "page with-header", "story related-content"])
def test_html_wrappers_are_no_boilerplate(name):
    text = " ".join(["The river rose again in the night, and the people of the town went up the hill."] * 3)
    inside = f"<h1>Title</h1><p>{text}</p><p>Short.</p><div class=comments><p>{text}</p></div>"
    assert hb.main_text(f"<nav><a>Home</a></nav><div class='{name}'><article>{inside}</article><div class=sidebar><p>{text}</p></div></div>") == f"Title\n{text}\nShort."
    assert hb.main_text(f"<nav><a>Home</a></nav><div class='{name}'><h1>Title</h1><p>{text}</p><p>{text}</p></div>") == f"Title\n{text}\n{text}"
    assert hb.main_text(f"<form id=f><div class='{name}'><main><p>{text}</p></main></div></form>") == text


def test_html_links_reach_over_blocks():
    found = hb.Page("<a href=x><div>one two</div><p>three</p></a><p>four</p><a name=y><p>five</p>").blocks
    assert [(b.words, b.linked) for b in found] == [(2, 2), (1, 1), (1, 0), (1, 0)]


def test_html_elements_that_hide_text():
    text = "The river rose again in the night, and the people of the town went up the hill, and by noon it fell."
    for odd in ("<svg/>", "<svg><text>no</text></svg>", "<!-->", "<!--->", "<select><option>no</select>", "<object>no</object>", "<script>'</p>no'</script>", "<template><p>no</p></template>"):
        assert hb.main_text(f"<article><p>{text}</p>{odd}<p>{text}</p></article>") == f"{text}\n{text}", odd


def test_html_deep_pages_are_read_once():
    import time

    began = time.time()
    hb.main_text("<div>" * 60_000 + "</span></b></section>" * 60_000)
    assert time.time() - began < 10


class PlainArticle(__import__("html.parser").parser.HTMLParser):
    """Blocks of the article element, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.out, self.now = 0, [], ""

    def flush(self):
        if self.now.split():
            self.out.append(" ".join(self.now.split()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.now += " "
        if tag in ("article", "h1", "h2", "p", "ul", "li", "div", "blockquote"):
            self.flush()
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        if tag in ("article", "h1", "h2", "p", "ul", "li", "div", "blockquote"):
            self.flush()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.now += data


def test_html_against_the_standard_parser(spark):
    d = "/root/testdata/sf0.01/pages.parquet"
    got = {r.page_id: r.text for r in hb.extract(spark.read.parquet(d)).collect()}
    for page_id, html in duckdb.sql(f"select page_id, html from '{d}'").fetchall():
        plain = PlainArticle()
        plain.feed(html)
        plain.close()
        assert got[page_id] == "\n".join(plain.out), page_id
    assert len(got) == 250


def test_html_query_rows(spark):
    rows = [(1, "http://a/", PAGE), (1, "http://a/", PAGE), (None, None, None), (2, "u", "")]
    got = hb.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()
    assert len(got) == 4 and {r.text for r in got if r.page_id == 1} == {hb.main_text(PAGE)} and all(r.n_chars == len(r.text) for r in got)
    assert hb.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_tree_separates_its_table():
    tree, right, n = hb.trained(), 0, 0
    for page in hb.labelled_pages():
        x, main = hb.marked(page)
        right, n = right + (hb.classify(tree, x) == main).sum(), n + len(main)
    assert right / n > 0.985


def test_tree_on_pages_it_has_not_seen():
    """Articles with blocks of any length and some links, among menus and asides; three links in a row are a list and no text, so not all can be right."""
    rng = np.random.default_rng(1)
    block = lambda tag, n, linked, mark="": f"<{tag}{mark}>{'<a href=x>' if linked else ''}{' '.join(rng.choice(WORDS, n))}{'</a>' if linked else ''}</{tag}>"
    tree, right, n = hb.trained(), 0, 0
    for _ in range(100):
        body = "".join(block(str(rng.choice(["p", "li", "h2", "div", "td", "blockquote"])), int(rng.choice([1, 2, 4, 9, 20, 45, 90])), rng.random() < 0.2, " data-main") for _ in range(rng.integers(1, 12)))
        aside = block("p", int(rng.choice([3, 12, 30, 60])), False)
        x, main = hb.marked(f"<nav>{block('p', 5, True)}{aside}</nav><article>{body}<aside>{aside}</aside></article>{aside}<footer>{aside}</footer>" if rng.random() < 0.5 else f"<div class=ad>{aside}</div><main>{body}</main><div id=sidebar>{aside}</div>")
        right, n = right + (hb.classify(tree, x) == main).sum(), n + len(main)
    assert right / n > 0.98


# --- 3


def plain_lm(rows, target, word_share, pair_share):
    toks = {i: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower()) for i, t in rows}
    words = collections.Counter(w for t in toks.values() for w in t)
    total = sum(words.values())
    vocab = {w for w, n in words.items() if n >= max(1, word_share * total)}
    ids = {i: [w if w in vocab else None for w in t] for i, t in toks.items()}
    uni, big = [], []
    for keys in (list(target), list(ids)):
        uni.append(collections.Counter(w for i in keys for w in ids[i]))
        big.append(collections.Counter(p for i in keys for p in zip(ids[i], ids[i][1:], strict=False)))
    n = [sum(u.values()) for u in uni]
    kept = {p for p in set(big[0]) | set(big[1]) if any(big[m][p] >= max(1, pair_share * n[m]) for m in (0, 1))}
    size = len(vocab) + 1
    out = {}
    for i, t in ids.items():
        loss = [0.0, 0.0]
        for m in (0, 1):
            p = lambda w: (uni[m][w] + 0.5) / (n[m] + 0.5 * size)  # noqa: B023, E731
            for k, w in enumerate(t):
                if k == 0:
                    q = p(w)
                elif (t[k - 1], w) in kept:
                    q = lm.KEEP * big[m][t[k - 1], w] / max(uni[m][t[k - 1]], 1) + (1 - lm.KEEP) * p(w)
                else:
                    q = (1 - lm.KEEP) * p(w)
                loss[m] -= math.log(q)
        out[i] = (len(t), *(x / max(len(t), 1) for x in loss))
    return out


def test_lm_against_plain(spark):
    rng = random.Random(8)
    rows = [(i, sentence(rng, rng.randint(0, 40)).title() + "!", "a") for i in range(40)]
    target = list(range(0, 40, 3))
    ids = spark.createDataFrame([(i,) for i in target], "doc_id long")
    got = {r.doc_id: (r.n_tokens, r.loss_target, r.loss_background) for r in lm.lm_score(docs_frame(spark, rows), ids, word_share=0.02, pair_share=0.003).collect()}
    want = plain_lm([(i, t) for i, t, _ in rows], target, 0.02, 0.003)
    assert got.keys() == want.keys()
    for i in got:
        assert got[i] == pytest.approx(want[i], rel=1e-9)


def test_lm_counts_every_word_and_bigram(spark):
    """Enough tokens that a share of them is more than one: what occurs once still has its own count."""
    rng = random.Random(9)
    rows = [(i, sentence(rng, 1000) + f" once{i} then{i} " + sentence(rng, 10), "a") for i in range(150)]
    target = [*range(0, 150, 3), 0, 999]
    ids = spark.createDataFrame([(i,) for i in target] + [(None,)], "doc_id long")
    got = {r.doc_id: (r.n_tokens, r.loss_target, r.loss_background) for r in lm.lm_score(docs_frame(spark, rows), ids).collect()}
    want = plain_lm([(i, t) for i, t, _ in rows], [i for i in target if i < 150], 0, 0)
    assert got.keys() == want.keys()
    for i in got:
        assert got[i] == pytest.approx(want[i], rel=1e-9)


def test_lm_odd(spark, odd, none):
    out = lm.lm_score(odd, odd.filter("doc_id > 3").select("doc_id")).collect()
    assert len(out) == odd.count() and all(math.isfinite(r.score) for r in out)
    assert all(r.score == 0 and r.n_tokens == 0 for r in out if r.doc_id in (1, 2, 3))
    assert lm.lm_score(none, none.select("doc_id")).count() == 0
    assert lm.lm_score(odd, none.select("doc_id")).count() == odd.count()


# --- 4

MODEL = sp.read_model()


@pytest.fixture(scope="module")
def fst():
    return sp.compiled(MODEL)


def test_fst_gives_the_librarys_ids(fst):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    texts = [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall()]
    rng = random.Random(2)
    alphabet = "ab the in er on  \n\t▁é你好🦙aaa  ==--//..00 123 THE\u00a0\x00\x1f"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["", " ", "  ", "a" * 3000, " " * 500, "é" * 200, "🦙" * 50, "\n" * 40, "<s></s><unk><0x41>"]
    for t in texts:
        ids = fst.encode(t)
        assert ids == own.encode(t), t[:80]
        assert fst.decode(ids) == own.decode(ids)
        if "▁" not in t:
            assert fst.decode(ids) == t


def test_fst_batches_are_single_texts(fst, monkeypatch):
    import pyarrow as pa

    rng = random.Random(12)
    texts = ["".join(rng.choice("ab the  é🦙\n▁.0") for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", "y" * 500, "é" * 200 + " z" * 300, "\n", " "]
    own = sp.Transducer(MODEL)
    for states in (sp.STATES, 40):
        monkeypatch.setattr(sp, "STATES", states)
        monkeypatch.setattr(own, "_known", c.Lookup(np.int32, 50))
        for _ in range(2):
            ids, bounds = own.encode_batch(pa.array(texts))
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [own.encode(t) if t else [] for t in texts]


def model_with(kind=2, charsmap=b"", prefix=True, squeeze=True, fallback=True, user=()):
    """The public model's pieces under other settings, as a model file."""

    def varint(n):
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    field = lambda k, v: varint(k << 3 | 2) + varint(len(v)) + v if isinstance(v, bytes) else varint(k << 3) + varint(v)
    out = b""
    for number, value in sp._fields(MODEL):
        if number == 1:
            own = dict(sp._fields(value))
            piece = sp.USER_DEFINED if own[1].decode() in user else own.get(3, 1)
            out += field(1, field(1, own[1]) + b"\x15" + own.get(2, bytes(4)) + field(3, sp.NORMAL if piece == sp.BYTE and not fallback else piece))
    out += field(2, field(3, kind) + field(35, int(fallback)))
    return out + field(3, (field(2, charsmap) if charsmap else b"") + field(3, int(prefix)) + field(4, int(squeeze)) + field(5, 1))


@pytest.fixture(scope="module")
def charsmap():
    import sentencepiece

    made = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    return next(dict(sp._fields(value))[2] for number, value in sp._fields(made) if number == 3)


def test_normaliser_is_the_librarys(charsmap):
    import sentencepiece

    own = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    n = sp.Normaliser(charsmap, False, False)
    rng = random.Random(3)
    pool = [chr(x) for x in (*range(1, 0x250), *range(0x300, 0x370), *range(0x2000, 0x2100), *range(0xFB00, 0xFB10), *range(0xFF00, 0xFFEF), *range(0x1100, 0x1200), 0xFDFA, 0x1F999, 0x3000)]
    for _ in range(5000):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        assert n(t) == own.normalize(t).replace("▁", " ")


@pytest.mark.parametrize("setting", [{"mapped": True}, {"mapped": True, "prefix": False}, {"squeeze": False, "user": ("▁the", "er", "aa")}, {"kind": 1, "mapped": True}, {"kind": 1, "mapped": True, "fallback": False}, {"fallback": False}])
def test_other_models_give_the_librarys_ids(charsmap, setting):
    import pyarrow as pa
    import sentencepiece

    setting = dict(setting)
    model = model_with(charsmap=charsmap if setting.pop("mapped", False) else b"", **setting)
    own, fst = sentencepiece.SentencePieceProcessor(model_proto=model), sp.Transducer(model)
    rng = random.Random(5)
    alphabet = "ab the in er on  \n\t é你好🦙aaa  ==--//..00 123 THE ﬁＡ①　é"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(800)] + ["", " ", "  "]
    ids, bounds = fst.encode_batch(pa.array(texts))
    data, off = fst.decode_batch(ids, bounds)
    for k, t in enumerate(texts):
        want = own.encode(t)
        assert ids[bounds[k] : bounds[k + 1]].tolist() == want == fst.encode(t), t
        assert data[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace") == own.decode(want)


def test_fst_grammar_is_what_merging_does(fst):
    rng = random.Random(4)
    made = [i for i in fst._made if len(fst.strings[i]) < 9]
    for _ in range(4000):
        p, q = rng.choice(made), rng.choice(made)
        a, b = fst.strings[p], fst.strings[q]
        assert fst.apart(p, q) == (plain_bpe(fst, a + b) == [a, b])


def plain_bpe(fst, text):
    parts = list(text)
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (fst.lexicon.get(parts[i] + parts[i + 1], (0, math.inf))[1], i))
        if parts[best] + parts[best + 1] not in fst.lexicon:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


def test_unigram_path_is_the_best():
    """A unigram model of a few pieces: the shortest path against all segmentations."""
    import struct

    def field(n, kind, payload):
        return bytes([n << 3 | kind]) + payload

    def text(n, data):
        return field(n, 2, bytes([len(data)]) + data)

    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.1, 1), ("ab", -4.0, 1), ("▁a", -3.5, 1), ("ba", -4.4, 1), ("bab", -5.0, 1)]
    model = b"".join(text(1, text(1, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    model += text(2, field(3, 0, bytes([1]))) + text(3, field(3, 0, bytes([1])) + field(4, 0, bytes([0])))
    t = sp.Transducer(model)
    score = {p: s for p, s, _ in pieces[1:]}

    def best(x):
        return max(((score[x[:k]] + best(x[k:])[0], [x[:k], *best(x[k:])[1]]) for k in range(1, len(x) + 1) if x[:k] in score), default=(0.0, []) if not x else (-math.inf, []))

    rng = random.Random(1)
    for _ in range(60):
        x = "▁" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))
        got = [t.strings[i] for i in t.path(x)]
        assert sum(score[p] for p in got) == pytest.approx(best(x)[0]) and "".join(got) == x


def test_encode_and_decode_rows(spark, odd, none):
    enc = sp.encode(odd, MODEL)
    rows = enc.collect()
    assert len(rows) == odd.count()
    assert all(r.ids is None and r.round_trip is None if r.doc_id == 1 else r.round_trip in (True, None) for r in rows)
    back = sp.decode(enc, MODEL)
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=key) == sorted(((r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()), key=key)
    assert sp.encode(none, MODEL).count() == 0


# --- 5


def plain_leaks(rows, items):
    words = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
    grams = lambda w, k: collections.Counter(tuple(w[p : p + k]) for p in range(len(w) - k + 1))
    out = {}
    for i, t in rows:
        w = words(t)
        for item, it in items:
            x = words(it)
            if not x or not w:
                continue
            k, n = min(5, len(x)), min(len(x), len(w))
            g = grams(x, k)
            best = 0.0
            for p in range(len(w) - n + 1):
                h = grams(w[p : p + n], k)
                if not h:
                    continue
                best = max(best, sum((g & h).values()) / sum((g | h).values()))
            if best >= 0.8 - 1e-12:
                out[i, item] = best
    return out


def test_leaks_against_plain(spark):
    rng = random.Random(11)
    items = [(k, sentence(rng, rng.choice([2, 5, 15, 15, 24, 40, 59]))) for k in range(20)] + [(90, ""), (91, None), (92, "...")]
    rows = []
    for i in range(60):
        parts = [sentence(rng, rng.randint(0, 30))]
        if rng.random() < 0.8:
            own = rng.choice(items[:20])[1].split()
            if rng.random() < 0.5 and len(own) > 14:
                own[rng.randrange(len(own))] = "edit"
            parts.append(rng.choice([", ".join(own), " ".join(own).upper(), "\n".join(own)]))
        parts.append(sentence(rng, rng.randint(0, 30)))
        rows.append((i, " ".join(parts), "a"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in dc.find_leaks(docs_frame(spark, rows), bench).collect()}
    want = plain_leaks([(i, t) for i, t, _ in rows], items)
    assert got == pytest.approx(want) and len(want) > 25
    clean = {r.doc_id for r in dc.decontaminate(docs_frame(spark, rows), bench).collect()}
    assert clean == {i for i, _, _ in rows} - {i for i, _ in want}


def test_leaks_in_item_blocks(spark, monkeypatch):
    rng = random.Random(12)
    items = [(k, sentence(rng, 20)) for k in range(9)]
    docs = docs_frame(spark, [(k, "intro " + t, "a") for k, t in items])
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(dc, "ITEMS_AT_ONCE", 2)
    assert {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, bench).collect()} == {(k, k) for k in range(9)}
    more = docs.union(docs_frame(spark, [(100, sentence(rng, 30), "a"), (None, None, "a"), (100, "x", "b")])).withColumn("rid", F.lit("x"))
    left = dc.decontaminate(more, bench)
    assert sorted(str(r.doc_id) for r in left.collect()) == ["100", "100", "None"] and left.columns == more.columns


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**63, 300, dtype=np.int64).astype(np.uint64)
    index = dc.MultiIndex(fps)
    for _ in range(40):
        q = int(fps[rng.integers(300)])
        for b in rng.choice(64, rng.integers(0, 24), replace=False):
            q ^= 1 << int(b)
        assert sorted(index.near(q)) == [i for i, f in enumerate(fps.tolist()) if (f ^ q).bit_count() <= dc.RADIUS]


def test_leaks_odd(spark, odd, none):
    bench = spark.createDataFrame([(1, "one two three"), (None, None), (1, "one two three")], "item_id long, text string").withColumn("doc_id", F.lit(0))
    assert [r.doc_id for r in dc.find_leaks(odd, bench).collect()] == [None, None]
    assert dc.decontaminate(odd, bench).count() == odd.count() - 1
    empty = bench.limit(0)
    assert dc.find_leaks(odd, empty).count() == 0 and dc.decontaminate(odd, empty).count() == odd.count() and dc.find_leaks(none, bench).count() == 0


# --- 6

URLS = ["http://a.example.net/en/x?q#f", "HTTP://A.EXAMPLE.NET/EN/", "http://example.net", "http://net/", "http://xnet/", "https://example.com/de/1", "https://notexample.com/de/1", "https://a.b.example.com/de", "ftp://u.org/fr/", "http://org/fr/?x", "http://org?/fr/", "x", "", None, "http://", "http:///en/", "a://b://c/", "http://free-bets.example.org/fr/a", "http://free-bets.example.com", "http://m.free-bets.example.com#/de/", "http://free-bets.example.com.:80/de/", "http://É.org/fr/É", "http://" + "a." * 2000 + "net/" + "p" * 5000]
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def plain_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({i: i + 32 for i in range(65, 91)})
    fits = [(len(h + p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    listed = any(host == h or host.endswith("." + h) for h in ("free-bets.example.com", "free-bets.example.org"))
    return host, path, max(fits)[2] if fits else None, max(fits)[1] if fits else "block" if listed else "allow"


@pytest.mark.parametrize("most", [uf.MOST_BITS, 8])
def test_urls_against_plain(spark, monkeypatch, most):
    monkeypatch.setattr(uf, "MOST_BITS", most)  # the small one makes several segments
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(URLS * 2)], "page_id long, url string, verdict string")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    listed = spark.createDataFrame([("free-bets.example.com",), ("free-bets.example.org",), ("free-bets.example.org",)], "host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.url_filter(pages, rules, listed).collect()}
    assert got == {i: plain_url(u) for i, u in enumerate(URLS * 2)}
    assert uf.url_filter(pages.limit(0), rules, listed).count() == 0
    same = uf.url_filter(pages.withColumn("page_id", F.lit(None).cast("long")), rules, listed)
    assert collections.Counter((r.host, r.path, r.rule, r.verdict) for r in same.collect()) == collections.Counter(plain_url(u) for u in URLS * 2)
    assert {r.verdict for r in uf.url_filter(pages, rules.limit(0), listed.limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("mistakes", [0.5, 0.024])
def test_cascade_is_exact(spark, monkeypatch, mistakes):
    monkeypatch.setattr(uf, "MISTAKES", mistakes)
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key")).persist()
    listed = spark.range(300).select(F.lit("block").alias("list"), F.concat(F.lit("k"), F.col("id") * 7).alias("key"))
    listed = listed.union(spark.range(9000).select(F.lit("allow"), F.concat(F.lit("k"), F.col("id") * 2)))
    held = uf.build(universe, listed, 300 if mistakes == 0.5 else 20_000)
    assert len(held["block"]) > (2 if mistakes == 0.5 else 0) and len(held["listed"]) == 0
    for name, step, n in (("block", 7, 300), ("allow", 2, 9000)):
        got = {r[0] for r in universe.filter(held[name].has(F.col("key"))).collect()}
        assert got == {f"k{step * i}" for i in range(n)}


def test_urls_use_no_python(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    plan = uf.url_filter(pages, spark.createDataFrame(RULES, "verdict string, host string, path string"), spark.createDataFrame([("a.example.com",)], "host string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- 7


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    assert sorted(ts.feistel(np.arange(n), n, 3).tolist()) == list(range(n))


def test_tokenizer_parts_are_exact():
    t = ts.Tokenizer(sp.read_model(ts.VOCABULARY))
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "the", " ", "  ", "\n", "\t", "é", "'s", "12", "!!", "🦙", "\u00a0", "\u2003", "\x1c", "\x85"]) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    for x in texts + [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet' limit 60").fetchall()]:
        assert np.frombuffer(t.encode(x), "<u2").tolist() == t.own.encode_ordinary(x), repr(x[:50])


def test_shards_hold_every_sequence_once(spark, odd, none):
    ranks = sp.read_model(ts.VOCABULARY)
    folder = f"{c.shared_dir(spark)}/shards-test"
    rows = ts.write_shards(odd, folder, ranks, seq=16, per_shard=50).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and [r.slot for r in rows] != sorted(r.slot for r in rows)
    read = dict(enumerate(ts.read_slots(folder, 0, len(rows), 16, 50)))
    t = ts.Tokenizer(ranks)
    texts = collections.Counter((r.doc_id, tuple([*t.own.encode_ordinary(r.text or ""), ts.END])) for r in odd.select("doc_id", "text").collect())
    by_doc = collections.defaultdict(list)
    for r in rows:
        assert (r.shard, r.byte_at) == (r.slot // 50, r.slot % 50 * 32) and (read[r.slot][r.n_tokens :] == ts.END).all()
        by_doc[r.doc_id].append((r.part, tuple(read[r.slot][: r.n_tokens].tolist())))
    want = collections.defaultdict(list)
    for (doc, ids), n in texts.items():
        want[doc] += [(k // 16, ids[k : k + 16]) for k in range(0, len(ids), 16)] * n
    assert {d: sorted(x) for d, x in by_doc.items()} == {d: sorted(x) for d, x in want.items()}
    some = list(ts.read_slots(folder, 45, 60, 16, 50))
    assert all((a == read[45 + k]).all() for k, a in enumerate(some)) and len(some) == 15
    assert ts.write_shards(none, folder + "-none", ranks).count() == 0
    before = {f: open(f, "rb").read() for f in glob.glob(folder.removeprefix("file://") + "/*")}
    os.remove(sorted(f for f in before if f.endswith(".bin"))[0])
    again = ts.write_shards(odd, folder, ranks, seq=16, per_shard=50).collect()  # completes the folder
    assert sorted(again) == sorted(rows) and before == {f: open(f, "rb").read() for f in glob.glob(folder.removeprefix("file://") + "/*")}
    with pytest.raises(ValueError):
        ts.write_shards(odd, folder, ranks, seq=8, per_shard=50)


def test_tokenizer_tells_parts_of_two_letters_apart():
    import pyarrow as pa

    t = ts.Tokenizer(sp.read_model(ts.VOCABULARY))
    texts = ["start " + x for x in two_letters(1024)]
    assert [np.frombuffer(x, "<u2").tolist() for x in t.encode_all(pa.array(texts))] == [t.own.encode_ordinary(x) for x in texts]


# --- 8


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    out = qda.quality(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    rows = out.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    own = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in own]) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_statistics_are_finite_and_of_the_row_alone():
    import pyarrow as pa

    rng = random.Random(9)
    texts = [None, "", " ", "a", "b b", "c\nd", "é", "#", "\n" * 50, "x" * 9000, *(sentence(rng, 30) for _ in range(50)), *"abcdefghijklmnop"]
    every = qda.statistics(*c.flat(pa.array(texts)))
    assert np.isfinite(every).all()
    for i, t in enumerate(texts):
        assert np.allclose(every[i], qda.statistics(*c.flat(pa.array([t], pa.string())))[0])


def plain_qda(rows, labels):
    """The score of each text from the formulas: densities with matrix inverses and determinants, and the curve by plain gradient steps on all rows."""
    import zlib

    import pyarrow as pa

    x = qda.statistics(*c.flat(pa.array([t for _, t in rows])))
    at = {i: k for k, (i, _) in enumerate(rows)}
    train = [(at[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 5]
    y = np.array([v for _, v in train])
    own = x[[k for k, _ in train]]
    means, covs = [own[y == k].mean(0) for k in (0, 1)], [np.cov(own[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).sum() * covs[k] for k in (0, 1)) / len(y)
    dens = []
    for k in (0, 1):
        a = 0.9 * covs[k] + 0.1 * pooled
        a = 0.95 * a + 0.05 * np.diag(np.diag(a)) + 1e-3 * np.eye(len(a))
        d = x - means[k]
        dens.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(a), d) - 0.5 * np.linalg.slogdet(a)[1] + np.log((y == k).mean()))
    return np.arcsinh(dens[1] - dens[0]), [k for k, _ in train], y


def test_quality_against_plain(spark):
    rng = random.Random(23)
    rows = [(i, sentence(rng, rng.randint(20, 90)) if i % 3 else " ".join(w.upper() + "!" * rng.randint(0, 2) for w in sentence(rng, rng.randint(5, 60)).split())) for i in range(300)]
    labels = [(i, int(i % 3 > 0) if i % 17 else int(i % 3 == 0)) for i in range(0, 300, 2)]
    got = {r.doc_id: r for r in qda.quality(docs_frame(spark, [(i, t, "a") for i, t in rows]), spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int")).collect()}
    value, train, y = plain_qda(rows, labels)
    own = np.array([got[i].score for i, _ in rows])
    odds = np.log(own / (1 - own))
    b, a = np.polyfit(value, odds, 1)
    assert np.allclose(odds, a + b * value, atol=1e-6)  # a line through the log-density differences
    v, one = np.append(value[train], [0.0, 0.0]), np.append(y, [1, 0])
    p = 1 / (1 + np.exp(-(a + b * v)))
    assert abs((one - p).sum()) < 0.5 and abs(((one - p) * v).sum()) < 2  # the line that logistic regression finds, up to the bins


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (None, 1, 0), (5, None, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    out = qda.quality(odd, labels).collect()
    assert len(out) == odd.count() and all(r.score == 0.5 and r.predicted == 1 for r in out)
    mixed = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    out = qda.quality(odd, mixed).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert qda.keep_good(odd, mixed).columns == odd.columns
    assert qda.quality(none, mixed).count() == 0


# --- 9


def test_rules_against_sql(spark, odd, tmp_path):
    rng = random.Random(13)
    rows = [r for r in odd_rows(rng) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    shared = [sentence(rng, 5) for _ in range(3)]
    for i in range(100, 330):
        body = [sentence(rng, 9) for _ in range(rng.randint(1, 9))]
        rows.append((i, "\n".join(rng.sample(shared, rng.randint(0, 3)) + body + [shared[0].upper() + "\t"] * rng.randint(0, 2)), rng.choice(["a", "b", None])))
    template = "\n".join(sentence(rng, 30) for _ in range(3))
    rows += [(400 + i, f"{template}\n{sentence(rng, 9)}", "c") for i in range(8)]
    df = docs_frame(spark, rows)
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    r = con.execute(sql.OP9)
    names = [x[0] for x in r.description]
    want = sorted(r.fetchall())
    got = sorted(tuple(x[n] for n in names) for x in qr.quality_rules(df).collect())
    assert got == want
    at = {n: names.index(n) for n in names}
    assert any(x[at["boilerplate_words"]] and not x[at["kept"]] and not x[at["base_failed"]] for x in want)  # rejected by the method alone


def test_rules_odd(odd, none):
    out = qr.quality_rules(odd).collect()
    assert collections.Counter(r.doc_id for r in out) == collections.Counter(r.doc_id for r in odd.select("doc_id").collect())
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in out if r.doc_id in (1, 2, 3))
    assert {r.n_words for r in out if r.doc_id == 4} == {30_000}
    assert qr.quality_rules(none).count() == 0


def test_rules_count_documents(spark):
    """Lines in 3 documents stay, in 4 go; copies are documents; in a host of 2,000 documents the limit is 10."""
    rng = random.Random(19)
    rows = [(i, f"{sentence(rng, 60)}\nin three\n" + ("in four" if i < 4 else "") if i < 3 or i == 3 else sentence(rng, 60), "a") for i in range(20)]
    rows[3] = (3, f"{sentence(rng, 60)}\nin four", "a")
    copy = sentence(rng, 60)
    rows += [(100 + i, copy, "b") for i in range(5)] + [(200 + i, copy, "c") for i in range(3)]
    rows += [(1000 + i, f"w{i} " * 3 + ("\nten" if i < 10 else "") + ("\neleven" if 20 <= i < 31 else ""), "d") for i in range(2000)]
    got = {r.doc_id: r for r in qr.quality_rules(docs_frame(spark, rows)).collect()}
    assert [got[i].boilerplate_words for i in range(5)] == [2, 2, 2, 2, 0]
    assert all(not got[100 + i].kept and got[100 + i].text == "" for i in range(5)) and all(got[200 + i].kept for i in range(3))
    assert all("ten" in got[1000 + i].text for i in range(10)) and all("eleven" not in got[1020 + i].text for i in range(11))


def test_rules_keep_lines_of_two_letters(spark):
    a, b = two_letters(2048)
    rows = [(i, f"{a}\n{sentence(random.Random(i), 60)}", "x") for i in range(10)] + [(10, f"{b}\n{sentence(random.Random(10), 60)}", "x")]
    got = {r.doc_id: r.boilerplate_words for r in qr.quality_rules(docs_frame(spark, rows)).collect()}
    assert got == {**{i: 1 for i in range(10)}, 10: 0}


# --- 10


def plain_groups(rows, k=4, radius=4):
    fps = [sd.fingerprint(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                parent[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[root(a)] = min(i, least.get(root(a), i))
    return sorted((i, f"{fps[a]:016x}", least[root(a)]) for a, (i, _) in enumerate(rows))


def copies(rng):
    rows = [(500, ""), (501, " "), (502, "a"), (503, "a b c"), (504, "A b C"), (505, "né É"), (506, None)]
    i = 0
    for _ in range(30):
        words = sentence(rng, rng.randint(1, 200)).split()
        for _ in range(rng.choice([1, 1, 2, 30])):
            own = list(words)
            if rng.random() < 0.6:
                own[rng.randrange(len(own))] = "changed"
            rows.append((i, " ".join(own)))
            i += 1
    return rows


@pytest.mark.parametrize("most", [20_000, 8])
def test_groups_against_plain(spark, most):
    rows = copies(random.Random(21))
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in sd.near_duplicates(docs_frame(spark, [(i, t, "a") for i, t in rows]), most=most).collect())
    want = plain_groups(rows)
    assert got == want and len({x[2] for x in want}) < len(rows) - 50


@pytest.mark.parametrize("n", [10, 10**5, 10**7, 10**11])
def test_block_keys_meet_within_the_radius(n):
    rng = random.Random(n)
    own = sd.masks(*sd.scheme(n, 4))
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        assert any(a & m == b & m for m in own)


def test_groups_odd(odd, none):
    out = {(r.doc_id, r.component_id) for r in sd.near_duplicates(odd).collect()}
    assert {(4, 4), (5, 4), (2, 1), (3, 1), (1, 1)} <= out
    assert sd.near_duplicates(none).count() == 0


def test_rules_remove_the_frequent_lines(spark):
    rng = random.Random(14)
    rows = [(i, f"é {sentence(rng, 60)}\n  Shared LINE here\n\n{sentence(rng, 9)}" if i < 60 else sentence(rng, 60) + ("\nshared line here" if i < 63 else ""), "a" if i < 60 else "b") for i in range(80)] + [(90, None, "a")]
    for r in qr.quality_rules(docs_frame(spark, rows)).collect():
        was = dict((i, t) for i, t, _ in rows)[r.doc_id]
        assert r.text == (was.replace("  Shared LINE here\n", "") if r.doc_id < 60 else was)
        assert [was.encode()[x.start : x.end] for x in r.removed] == [b"  Shared LINE here"] * (r.doc_id < 60)
        assert r.boilerplate_words == (3 if r.doc_id < 60 else 0)


def jaccard(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("most", [20_000, 8])
def test_one_of_each(spark, most):
    rng = random.Random(31)
    rows, group = [], {}
    for g in range(25):
        words = sentence(rng, 200).split()
        for _ in range(rng.choice([1, 2, 12])):
            own = list(words)
            for _ in range(rng.choice([0, 1, 2])):
                own[rng.randrange(200)] = "changed"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(own), "a"))
    kept = [r.doc_id for r in sd.one_of_each(docs_frame(spark, rows), most=most).collect()]
    firsts = {min(i for i in group if group[i] == g) for g in set(group.values())}
    assert firsts <= set(kept) and len(kept) <= len(firsts) + 1


@pytest.mark.parametrize("most", [20_000, 8])
def test_one_of_each_around_the_threshold(spark, most):
    """Pairs of texts from 0.74 to 0.86: what goes is what the shingles say, not what the fingerprints estimate."""
    rng = random.Random(47)
    rows, want = [], set()
    for g in range(120):
        words = [f"w{g}x{i}" for i in range(200)]
        own = list(words)
        for p in rng.sample(range(5, 190, 6), rng.choice([3, 4, 4, 4, 5, 5, 6])):
            own[p] = f"changed{p}"
        rows += [(2 * g, " ".join(words), "a"), (2 * g + 1, " ".join(own), "a")]
        want |= {2 * g} | ({2 * g + 1} if jaccard(rows[-1][1], rows[-2][1]) < 0.8 else set())
    base = [f"base{i}" for i in range(200)]
    many = [" ".join(x if i != 6 * j + 5 else f"other{j}" for i, x in enumerate(base)) for j in range(30)]
    rows += [(1000 + j, t, "a") for j, t in enumerate(many)]
    got = {r.doc_id for r in sd.one_of_each(docs_frame(spark, rows), most=most, most_shingles=sd.MOST_SHINGLES if most > 8 else 2000).collect()}
    assert got == want | {1000} and 0 < len([i for i in want if i % 2]) < 120


@pytest.mark.parametrize("many", [10, 3000])
def test_common_shingles_are_counted(monkeypatch, many):
    """Bit sets and sorted lists against Python's sets."""
    monkeypatch.setattr(sd, "COUNTED", 4000)
    rng = np.random.default_rng(many)
    own = [np.unique(rng.integers(0, many, rng.integers(0, 60))).astype(np.int64) * 7 for _ in range(40)]
    s = sd.Sets(np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])]))
    a = rng.integers(0, 40, 300)
    b = (a + rng.integers(1, 40, 300)) % 40
    want = [len(set(own[x].tolist()) & set(own[y].tolist())) for x, y in zip(a, b, strict=True)]
    assert s.common(a, b).tolist() == want and s.common(a[:20], b[:20]).tolist() == want[:20]


def test_one_of_each_odd(spark, odd, none):
    out = sd.one_of_each(odd)
    rows = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert out.columns == odd.columns and max(rows.values()) == 1
    assert len([k for k in rows if k[0] in (4, 5)]) == 1 and len([k for k in rows if not (k[1] or "").strip()]) == 1
    assert sd.one_of_each(none).count() == 0
