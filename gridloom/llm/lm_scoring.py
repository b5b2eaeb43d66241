"""Language-model scoring by cross-entropy difference.

Two bigram models with one vocabulary: the target's counts come from the documents labelled as of the target, the
background's from all documents. Vocabulary, order, smoothing and pruning are the same for both. A document's score
is its mean loss per token under the target model less that under the background model; lower is nearer to the target.

Words are runs of letters and digits of the lower-cased text. Every word and every bigram counts, however rare, and
interpolates with the word (Jelinek-Mercer). The counts grow with the corpus, so they are never on one machine: rows are
numbered by a written table and dealt by that number into chunks of about CHUNK bytes, so that neither an id nor a text
that many rows have makes a chunk large; a chunk passes on its own counts in blocks by range of the key, a block's task
adds up each key over all chunks and answers each chunk in the order of its own keys, and the chunk's documents are
scored with the answers. A key is once in a chunk, however often it stands there.

A caller may ask for a smaller model by shares: then the vocabulary holds the words that make up word_share of the
corpus's tokens, other words are one unknown word, and bigrams under pair_share of either corpus's tokens back off to
the word. Both shares are 0, no pruning, unless given.

Null and empty texts have no tokens and score 0; a text of any length is one unit, held by one task; repeated rows are
scored and counted each; label rows that repeat count a document again for the target; null ids meet no label; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

KEEP = 0.7
#: Bytes of text in a chunk, and of the text whose share of the keys is a block.
CHUNK, BLOCK = 10 << 20, 24 << 20
#: Distinct keys that a task holds before it passes its sums on.
HELD = 1_000_000


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, off = c.flat(pc.utf8_lower(col))
    ws, we = c.runs(c.ALNUM[data], off)
    return c.span_hashes(data, ws, we), np.searchsorted(off, ws, "right") - 1


class Vocabulary:
    """Sorted hashes of the words; a word's id is its place, the unknown word's is their number."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.astype(np.uint64))
        self.size = len(hashes)

    def ids(self, h: np.ndarray) -> np.ndarray:
        if not self.size:
            return np.zeros(len(h), np.int64)
        at = np.searchsorted(self.hashes, h)
        at[at == self.size] = 0
        return np.where(self.hashes[at] == h, at, self.size)

    def pairs(self, ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the bigrams, and the places of their second words."""
        at = np.flatnonzero(row[1:] == row[:-1]) + 1 if len(row) > 1 else np.zeros(0, np.int64)
        return ids[at - 1] * (self.size + 1) + ids[at], at


def summed(df: DataFrame, keys, schema: str = "k long, n long") -> DataFrame:
    """Counts of the keys (int64 arrays) of all texts: in each task first, then by a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            u, back = np.unique(k, return_inverse=True)
            return u, np.bincount(back, n, len(u)).astype(np.int64)

        for batch in batches:
            for part in c.pieces(batch, "text"):
                u, n = np.unique(keys(part.column(0)), return_counts=True)
                parts.append((u, n))
                size += len(u)
            if size > HELD:
                parts = [merged()]
                size = len(parts[0][0])
                if size > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(parts[0][0]), pa.array(parts[0][1])], names=["k", "n"])
                    parts, size = [], 0
        if size:
            u, n = merged()
            for at in range(0, len(u), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[at : at + 100_000]), pa.array(n[at : at + 100_000])], names=["k", "n"])

    c.small_batches(df.sparkSession)
    return df.mapInArrow(run, schema).groupBy("k").agg(F.sum("n").alias("n"))


class Models:
    """Losses of both models: by word, and by the bigrams that count by themselves."""

    def __init__(self, vocabulary: Vocabulary, words: np.ndarray, codes: np.ndarray, pairs: np.ndarray):
        """words: counts (2, size + 1), target first; codes: sorted bigram codes; pairs: their counts (2, n)."""
        size = vocabulary.size + 1
        self.vocabulary, self.codes = vocabulary, codes
        p = (words + 0.5) / (words.sum(1, keepdims=True) + 0.5 * size)
        first, second = codes // size, codes % size
        self.alone = -np.log(p)
        self.backed = -np.log((1 - KEEP) * p)
        self.pair = -np.log(KEEP * pairs / np.maximum(words[:, first], 1) + (1 - KEEP) * p[:, second])

    def score(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens, and mean losses (2, n) of each text."""
        h, row = tokens(col)
        n = np.bincount(row, minlength=len(col))
        ids = self.vocabulary.ids(h)
        codes, at = self.vocabulary.pairs(ids, row)
        place = np.searchsorted(self.codes, codes)
        known = np.zeros(len(codes), bool)
        if len(self.codes):
            place[place == len(self.codes)] = 0
            known = self.codes[place] == codes
        out = np.zeros((2, len(col)))
        for m in (0, 1):
            loss = self.alone[m][ids]
            loss[at] = self.backed[m][ids[at]]
            loss[at[known]] = self.pair[m][place[known]]
            out[m] = np.bincount(row, loss, len(col)) / np.maximum(n, 1)
        return n, out


def fit(docs: DataFrame, target: DataFrame, word_share: float, pair_share: float) -> Models:
    """From two frames of texts (column text)."""
    count = c.cut(summed(docs, lambda col: tokens(col)[0].view(np.int64)), "words")
    total = count.agg(F.sum("n")).first()[0] or 0
    hashes = count.filter(F.col("n") >= max(1.0, word_share * total)).select("k").toArrow().column(0).to_numpy()
    vocabulary = Vocabulary(hashes.astype(np.int64).view(np.uint64))
    context = docs.sparkSession.sparkContext
    held = context.broadcast(vocabulary)

    def keys(col: pa.Array) -> np.ndarray:
        h, row = tokens(col)
        ids = held.value.ids(h)
        return np.concatenate([-1 - ids, held.value.pairs(ids, row)[0]])

    both = summed(target, keys).select("k", F.col("n").alias("t"), F.lit(0).cast("long").alias("b")).union(summed(docs, keys).select("k", F.lit(0).cast("long"), "n"))
    table = c.cut(both.groupBy("k").agg(F.sum("t").alias("t"), F.sum("b").alias("b")), "bigrams")
    sums = table.filter("k < 0").agg(F.sum("t"), F.sum("b")).first()
    often = (F.col("t") >= max(1.0, pair_share * (sums[0] or 0))) | (F.col("b") >= max(1.0, pair_share * (sums[1] or 0)))
    got = table.filter((F.col("k") < 0) | often).toArrow()
    k, t, b = (got.column(i).to_numpy().astype(np.int64) for i in range(3))
    words = np.zeros((2, vocabulary.size + 1))
    one = k < 0
    words[0, -1 - k[one]], words[1, -1 - k[one]] = t[one], b[one]
    order = np.argsort(k[~one])
    return Models(vocabulary, words, k[~one][order], np.stack([t[~one][order], b[~one][order]]).astype(float))


# --- every word and bigram ------------------------------------------------------------------------------


def keyed(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the words (even) and of the bigrams (odd), the words' rows, and the places of the bigrams' first words."""
    h, row = tokens(col)
    h &= ~np.uint64(1)
    two, at = c.shingles(h, row, 2)
    return h, two | np.uint64(1), row, at


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(chunk, kind, rows) of runs of rows that are sorted by the first two columns, chunk and kind."""
    for batch in batches:
        if not batch.num_rows:
            continue
        chunk, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        at = [0, *(np.flatnonzero((chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(at, at[1:], strict=False):
            yield int(chunk[lo]), int(kind[lo]), batch.slice(lo, hi - lo)


def pack(a: np.ndarray) -> bytes:
    """64-bit integers by planes of bytes, compressed; what is small or sorted (as differences) takes few bytes."""
    return pa.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n).T).view(np.int64).ravel()


def block_of(k: np.ndarray, blocks: int) -> np.ndarray:
    """Even ranges of the keys, in their order."""
    return ((k >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


class Keys:
    """The keys of a chunk's texts: each part of the texts refers to its own distinct keys, and these to the chunk's, which are sorted."""

    def __init__(self):
        self._own: list[np.ndarray] = []
        self._codes: list[np.ndarray] = []

    def add(self, keys: np.ndarray) -> np.ndarray:
        """The places of the keys among the part's distinct ones, whose number is the length of the last of _own."""
        codes, own = pd.factorize(keys)
        self._own.append(own)
        return codes

    def close(self) -> np.ndarray:
        """The chunk's keys; places(k) are then those of part k's distinct keys among them."""
        codes, every = pd.factorize(np.concatenate([*self._own, np.zeros(0, np.uint64)]))
        order = np.argsort(every)
        rank = np.empty(len(every), np.int32)
        rank[order] = np.arange(len(every), dtype=np.int32)
        self._codes = np.split(rank[codes], np.cumsum([len(x) for x in self._own])[:-1]) if self._own else []
        self._own = []
        return every[order]

    def places(self, k: int) -> np.ndarray:
        return self._codes[k]


def chunk_counts(blocks: int):
    """(block, chunk, n, keys, t, b) from rows (chunk, kind, rid, n, text): first numbers of the target's rows and how often each counts, then documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys = None, Keys()
        counts: list[tuple[np.ndarray, np.ndarray]] = []
        ids: list[tuple[np.ndarray, np.ndarray]] = []
        own = None

        def done() -> Iterator[pa.RecordBatch]:
            if not counts:
                return
            k = keys.close()
            t, b = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
            for i, (x, y) in enumerate(counts):  # a part has a key once
                t[keys.places(i)] += x
                b[keys.places(i)] += y
            at = np.searchsorted(block_of(k, blocks), np.arange(blocks + 1))
            rows = [(i, now, hi - lo, pack(np.diff(k[lo:hi], prepend=np.uint64(0))), pack(t[lo:hi]), pack(b[lo:hi])) for i, (lo, hi) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False)) if hi > lo]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), COUNTS.types, strict=True)], schema=COUNTS)

        for chunk, kind, rows in runs_of(batches):
            if chunk != now:
                yield from done()
                now, keys, counts, ids, own = chunk, Keys(), [], [], None
            if kind == 0:
                ids.append((rows.column(2).to_numpy(), rows.column(3).to_numpy()))
                continue
            if own is None:
                own, n = (np.concatenate(x) for x in zip(*ids, strict=True)) if ids else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                order = np.argsort(own)
                own, n = own[order], n[order]
            for part in c.pieces(rows, "text"):
                weight = np.zeros(part.num_rows, np.int64)
                if len(own):
                    value = part.column(2).to_numpy()
                    place = np.minimum(np.searchsorted(own, value), len(own) - 1)
                    weight = np.where(own[place] == value, n[place], 0)
                words, pairs, row, at = keyed(part.column(4))
                codes = keys.add(np.concatenate([words, pairs]))
                b = np.bincount(codes)
                each = weight[np.concatenate([row, row[at]])]
                counts.append((np.bincount(codes, each, len(b)).astype(np.int64) if each.any() else np.zeros(len(b), np.int64), b))
        yield from done()

    return run


def block_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of COUNTS sorted by block: to each chunk the totals of its keys, and a row (no chunk) of the block's words: how many, and their tokens."""
    now, held = None, []

    def done() -> Iterator[pa.RecordBatch]:
        keys = Keys()
        for x in held:
            keys.add(np.cumsum(unpack(x[3], x[2]).view(np.uint64), dtype=np.uint64))
        u = keys.close()
        t, b = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
        for i, x in enumerate(held):
            t[keys.places(i)] += unpack(x[4], x[2])
            b[keys.places(i)] += unpack(x[5], x[2])
        word = u & np.uint64(1) == 0
        yield out([(now, None, int(word.sum()), int(t[word].sum()), int(b[word].sum()), None, None)])
        for lo in range(0, len(held), 100):
            own = [keys.places(i) for i in range(lo, min(lo + 100, len(held)))]
            yield out([(now, x[1], x[2], None, None, pack(t[o]), pack(b[o])) for x, o in zip(held[lo : lo + 100], own, strict=True)])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), TOTALS.types, strict=True)], schema=TOTALS)

    for batch in batches:
        for x in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if x[0] != now:
                if held:
                    yield from done()
                now, held = x[0], []
            held.append(x)
    if held:
        yield from done()


COUNTS = pa.schema([("block", pa.int32()), ("chunk", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("t", pa.binary()), ("b", pa.binary())])
TOTALS = pa.schema([("block", pa.int32()), ("chunk", pa.int32()), ("n", pa.int64()), ("sum_t", pa.int64()), ("sum_b", pa.int64()), ("t", pa.binary()), ("b", pa.binary())])


def chunk_scores(size: int, totals: tuple[int, int]):
    """Scores from rows (chunk, kind, block, n, t, b, doc_id, text): first the totals of the chunk's keys by block, then documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, answers, keys = None, [], Keys()
        docs: list[tuple] = []

        def done() -> Iterator[pa.RecordBatch]:
            table = [np.concatenate([unpack(x[i], x[0]) for x in answers]) if answers else np.zeros(0, np.int64) for i in (1, 2)]
            if len(keys.close()) != len(table[0]):
                raise RuntimeError("the documents have changed between two readings")
            for k, (doc_id, codes, row, at) in enumerate(docs):
                place, n_words = keys.places(k)[codes], len(row)
                one, two = place[:n_words], place[n_words:]
                n = np.bincount(row, minlength=len(doc_id))
                loss = np.zeros((2, len(doc_id)))
                for m in (0, 1):
                    p = (table[m][one] + 0.5) / (totals[m] + 0.5 * size)
                    each = p.copy()
                    each[at + 1] = KEEP * table[m][two] / np.maximum(table[m][one[at]], 1) + (1 - KEEP) * p[at + 1]
                    loss[m] = np.bincount(row, -np.log(each), len(doc_id)) / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(n.astype(np.int64)), pa.array(loss[0]), pa.array(loss[1]), pa.array(loss[0] - loss[1])], names=NAMES)

        for chunk, kind, rows in runs_of(batches):
            if chunk != now:
                yield from done()
                now, answers, keys, docs = chunk, [], Keys(), []
            if kind == 0:
                answers += zip(*(rows.column(i).to_pylist() for i in (3, 4, 5)), strict=True)
                continue
            for part in c.pieces(rows, "text"):
                words, pairs, row, at = keyed(part.column(7))
                # codes and places in 32 bits: a chunk holds them all until it is complete
                docs.append((part.column(6), keys.add(np.concatenate([words, pairs])).astype(np.int32), row.astype(np.int32), at.astype(np.int32)))
        yield from done()

    return run


NAMES = ["doc_id", "n_tokens", "loss_target", "loss_background", "score"]
SCHEMA = "doc_id long, n_tokens long, loss_target double, loss_background double, score double"


def whole_score(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Scores by the counts of every word and bigram; df: doc_id, text."""
    spark = df.sparkSession
    c.small_batches(spark)
    base = c.row_cut(df, "documents")
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, blocks = (max(math.ceil(size / each), 2 * spark.sparkContext.defaultParallelism) for each in (CHUNK, BLOCK))
    chunk = F.pmod(F.xxhash64("rid"), F.lit(chunks)).cast("int").alias("chunk")
    null = lambda kind: F.lit(None).cast(kind)
    target = ids.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    # the ids grow with the corpus, so they are shuffled like the rows at any size, never broadcast
    weights = base.select("rid", "doc_id").join(target.hint("merge"), "doc_id")
    first = weights.select(chunk, F.lit(0).alias("kind"), "rid", "n", null("string").alias("text")).union(base.select(chunk, F.lit(1), "rid", null("long"), "text"))
    own = first.repartitionById(chunks, F.col("chunk")).sortWithinPartitions("chunk", "kind").mapInArrow(chunk_counts(blocks), "block int, chunk int, n int, keys binary, t binary, b binary")
    summed_up = own.repartitionById(blocks, F.col("block")).sortWithinPartitions("block").mapInArrow(block_totals, "block int, chunk int, n long, sum_t long, sum_b long, t binary, b binary")
    totals = c.cut(summed_up, "totals")
    words = totals.filter("chunk is null").agg(F.sum("n"), F.sum("sum_t"), F.sum("sum_b")).first()
    answers = totals.filter("chunk is not null").select("chunk", F.lit(0).alias("kind"), "block", "n", "t", "b", null("long").alias("doc_id"), null("string").alias("text"))
    both = answers.union(base.select(chunk, F.lit(1), null("int"), null("long"), null("binary"), null("binary"), "doc_id", "text"))
    # one more place than words, as for a word that the corpus doesn't have
    scores = chunk_scores((words[0] or 0) + 1, (words[1] or 0, words[2] or 0))
    return both.repartitionById(chunks, F.col("chunk")).sortWithinPartitions("chunk", "kind", "block").mapInArrow(scores, SCHEMA)


def lm_score(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", word_share: float = 0.0, pair_share: float = 0.0) -> DataFrame:
    """A row per document: doc_id, n_tokens, loss_target, loss_background, score. target_ids: ids of the target's documents."""
    df = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    ids = target_ids.select(F.col(target_ids.columns[0]).cast("long").alias("doc_id"))
    if not word_share and not pair_share:
        return whole_score(df, ids)
    # the ids grow with the corpus, so they are shuffled like the texts at any size, never broadcast
    target = df.join(ids.hint("merge"), "doc_id").select("text")
    models = df.sparkSession.sparkContext.broadcast(fit(df.select("text"), target, word_share, pair_share))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, loss = models.value.score(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(loss[0]), pa.array(loss[1]), pa.array(loss[0] - loss[1])], names=NAMES)

    return c.map_text(df, run, SCHEMA)
