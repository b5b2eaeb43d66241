"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact shingle similarity.

Words are runs of letters and digits of the lower-cased text. For an item of L words, every run of L words of a
document is a window (a document with fewer words is one window); its fingerprint is the SimHash of its five-word
shingles, with their multiplicity. A multi-index cuts the 64 bits into blocks, so many that two fingerprints within
RADIUS differ by at most one bit in some block; a block's table therefore holds each item under its value and the
values one bit away, and every item within the radius is found. Survivors are verified by the exact weighted
Jaccard similarity of the shingle counts, sum of minima over sum of maxima, which must reach the threshold.

That similarity also bounds the work: to reach it, a window must hold a certain number of shingles that some item
has, so windows with fewer are not fingerprinted; nothing that could match is left out.

Items are read in blocks of bounded size, each shipped to the executors for one pass over the documents, so any
number of items works. With more than one block, a pass's result is written before the next block is shipped, so that
the driver never holds more than two blocks and an executor one.

Null and empty texts, and items or documents without words, match nothing; items with fewer than five words are one
shingle; a text of any length is one unit, held by one task, its windows in bounded parts; of windows that tie the first
is reported; null ids and repeated rows of either table are rows like any other; extra columns of items are ignored,
those of documents pass through decontaminate; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

K, THRESHOLD, RADIUS = 5, 0.8, 20
ITEMS_AT_ONCE, BYTES_AT_ONCE = 20_000, 16 << 20
#: Shingles of the windows that are fingerprinted at once.
WINDOW_SHINGLES = 1 << 18


def word_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word."""
    data, off = c.flat(pc.utf8_lower(col))
    ws, we = c.runs(c.ALNUM[data], off)
    return c.span_hashes(data, ws, we), np.searchsorted(off, ws, "right") - 1


def simhash(shingles: np.ndarray) -> np.ndarray:
    """Of each row of shingle hashes: the bits set in more than half of them."""
    out = np.empty(len(shingles), np.uint64)
    n = shingles.shape[1]
    step = max(1, (1 << 17) // n)
    for at in range(0, len(shingles), step):
        part = np.ascontiguousarray(shingles[at : at + step])
        ones = np.unpackbits(part.view(np.uint8).reshape(len(part), n, 8), axis=2, bitorder="little").sum(1, dtype=np.int32)
        out[at : at + step] = np.packbits(2 * ones > n, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    common = sum((x & y).values())
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 0.0


class MultiIndex:
    """Fingerprints by blocks of their bits; near() gives all within the radius."""

    def __init__(self, fps: np.ndarray, radius: int = RADIUS):
        self.fps, self.radius = fps, radius
        count = radius // 2 + 1  # with so many blocks, some block differs in one bit at most
        edges = [64 * i // count for i in range(count + 1)]
        self.blocks = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            table: list[list[int]] = [[] for _ in range(1 << (hi - lo))]
            for i, v in enumerate(((fps >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)).tolist()):
                for x in (v, *(v ^ 1 << b for b in range(hi - lo))):
                    table[x].append(i)
            self.blocks.append((lo, (1 << (hi - lo)) - 1, table))

    def near(self, fp: int) -> list[int]:
        found: set[int] = set()
        for lo, mask, table in self.blocks:
            found.update(table[fp >> lo & mask])
        return [i for i in found if (int(self.fps[i]) ^ fp).bit_count() <= self.radius]


class Items:
    """A block of benchmark items, by their number of words."""

    def __init__(self, ids: list, texts: list[str | None], k: int = K, threshold: float = THRESHOLD):
        self.k, self.threshold = k, threshold
        h, row = word_hashes(pa.array(texts, pa.string()))
        edges = np.searchsorted(row, np.arange(len(texts) + 1))
        groups: dict[int, list[tuple[object, np.ndarray]]] = {}
        for i, item in enumerate(ids):
            own = h[edges[i] : edges[i + 1]]
            if len(own):
                n = min(k, len(own))
                groups.setdefault(len(own), []).append((item, c.shingles(own, np.zeros(len(own), np.int64), n)[0]))
        self.groups = {}
        for length, members in sorted(groups.items()):
            sets = np.stack([s for _, s in members])
            self.groups[length] = ([i for i, _ in members], sets, MultiIndex(simhash(sets)))
        #: by shingle size: the shingles of any item, and a bitmap of their low bits that most others miss
        self.known = {}
        for size in {min(k, n) for n in self.groups}:
            every = np.unique(np.concatenate([s.ravel() for n, (_, s, _) in self.groups.items() if min(k, n) == size]))
            low = np.zeros(1 << 20, bool)
            low[(every & np.uint64(0xFFFFF)).astype(np.int64)] = True
            self.known[size] = (every, low)

    def leaks(self, col: pa.Array) -> Iterator[tuple[int, object, float, int, int, int]]:
        """(row, item, similarity, first word, words, windows) of each row and item that match: the best window, the first of equals."""
        h, row = word_hashes(col)
        for size, (every, low) in self.known.items():
            s, at = c.shingles(h, row, size)
            maybe = np.flatnonzero(low[(s & np.uint64(0xFFFFF)).astype(np.int64)])
            place = np.searchsorted(every, s[maybe])
            maybe = maybe[every[np.minimum(place, len(every) - 1)] == s[maybe]]
            if not len(maybe):
                continue
            srow = row[at]
            for r in np.unique(srow[maybe]):
                a, b = np.searchsorted(srow, [r, r + 1])
                hit = np.zeros(b - a + 1, np.int64)
                hit[maybe[(maybe >= a) & (maybe < b)] - a + 1] = 1
                yield from ((int(r), *x) for x in self._row(s[a:b], np.cumsum(hit), size))

    def _row(self, s: np.ndarray, hits: np.ndarray, size: int) -> Iterator[tuple[object, float, int, int, int]]:
        for length, (ids, sets, index) in self.groups.items():
            if min(self.k, length) != size:
                continue
            n = min(sets.shape[1], len(s))
            need = math.ceil(self.threshold * (n + sets.shape[1]) / (1 + self.threshold) - 1e-9)
            if need > n:
                continue
            starts = np.flatnonzero(hits[n:] - hits[:-n] >= need)
            if not len(starts):
                continue
            best: dict[int, list] = {}
            step = max(1, WINDOW_SHINGLES // n)
            for at in range(0, len(starts), step):
                some = starts[at : at + step]
                rows = s[some[:, None] + np.arange(n)]
                for p, shingles, fp in zip(some.tolist(), rows, simhash(rows).tolist(), strict=True):
                    for i in index.near(fp):
                        if (sim := similarity(shingles, sets[i])) >= self.threshold - 1e-12:
                            got = best.setdefault(i, [0.0, 0, 0])
                            got[2] += 1
                            if sim > got[0]:
                                got[:2] = sim, p
            for i, (sim, p, windows) in sorted(best.items()):
                yield ids[i], sim, p, n + size - 1, windows


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, k: int, threshold: float) -> Iterator[Items]:
    ids, texts, size = [], [], 0
    for item, text in benchmark.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).toLocalIterator():
        ids.append(item)
        texts.append(text)
        size += len(text or "")
        if len(ids) >= ITEMS_AT_ONCE or size >= BYTES_AT_ONCE:
            yield Items(ids, texts, k, threshold)
            ids, texts, size = [], [], 0
    yield Items(ids, texts, k, threshold)


def by_block(spark: SparkSession, blocks: Iterator[Items], run: Callable[[object], DataFrame]) -> list[DataFrame]:
    """run for the broadcast of each block; the result of one block stays a plan, those of more are written one after the other."""
    out: list[DataFrame] = []
    block = next(blocks)
    while True:
        after, held = next(blocks, None), spark.sparkContext.broadcast(block)
        if after is None and not out:
            return [run(held)]
        out.append(c.cut(run(held), "leaks"))
        held.destroy()
        if after is None:
            return out
        block = after


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document and item that it holds: doc_id, item_id, similarity, start and words of the best window, windows."""
    df = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = "doc_id long, item_id long, similarity double, start int, words int, windows int"

    def over(items) -> DataFrame:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            found = list(items.value.leaks(batch.column(1)))
            if not found:
                return None
            rows, *columns = zip(*found, strict=True)
            kinds = (pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))], names=["doc_id", "item_id", "similarity", "start", "words", "windows"])

        return c.map_text(df, run, schema)

    return reduce(lambda a, b: a.union(b), by_block(docs.sparkSession, item_blocks(benchmark, item_col, item_text, k, threshold), over))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that hold no item."""
    blocks = item_blocks(benchmark, item_col, item_text, k, threshold)
    first, second = next(blocks), next(blocks, None)
    at = docs.columns.index(text_col)

    def rows_of(batch: pa.RecordBatch, items, leaking: bool) -> pa.RecordBatch:
        mark = np.full(batch.num_rows, not leaking)
        mark[[x[0] for x in items.value.leaks(batch.column(at))]] = leaking
        return batch.filter(pa.array(mark))

    if second is None:
        held = docs.sparkSession.sparkContext.broadcast(first)
        return c.map_text(docs, lambda batch: rows_of(batch, held, False), docs.schema, text_col)
    (rid,) = c.fresh(docs, "rid")
    rows = c.row_cut(docs, "documents", rid)
    some = rows.select(*docs.columns, rid)
    leaks = by_block(docs.sparkSession, (b for x in ((first, second), blocks) for b in x), lambda held: c.map_text(some, lambda batch: rows_of(batch, held, True), some.schema, text_col).select(rid))
    return rows.join(reduce(lambda a, b: a.union(b), leaks).distinct(), rid, "left_anti").select(*docs.columns)
