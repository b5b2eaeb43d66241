"""Near duplicates by SimHash, with pivot distance tables.

A fingerprint has 64 bits; two texts are linked if theirs differ in at most radius bits, and a group is a
connected component of links. Equal fingerprints collapse first, so copies cost nothing further. Candidates meet
in buckets: the bits are cut into blocks, and two fingerprints within the radius agree on all but radius of the
blocks, so on one of the block sets that are the keys; how many blocks there are depends on the number of
fingerprints, never what is found. In a bucket, each fingerprint has its Hamming distances to reference
fingerprints (the pivots); by the triangle inequality a pair whose distances to any pivot differ by more than the
radius is no link, and only the rest is compared bit by bit. A bucket passes on the edges of a spanning A bucket passes on the edges of a spanning forest, so
n fingerprints give at most n - 1 edges, however many links they have. Buckets are counted before anything is dealt by
them; one that is too large for a task is cut into chunks by the first pivot's distance (and, where one distance is
too many rows, by a hash), and the pairs of chunks that this distance doesn't exclude go to tasks of their own.
Components come from rounds of minimum labels over written tables.

Null texts count as empty, and an empty text has fingerprint zero, which links like any other. Rows with equal ids
stay rows and are linked by their fingerprints like all rows; texts that tie in distance all link; a text of any length
is one unit, held by one task; extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

PIVOTS = 24
#: Fingerprints of one bucket that a task holds at once.
MOST = 20_000


# --- fingerprints ------------------------------------------------------------------------------------


def fingerprint(text: str | None, k: int = 4) -> int:
    """One text's fingerprint, word by word; what the batches are tested against."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


#: Shingles whose bits are unpacked at once.
_UNPACK = 1 << 16


def _bits_over_half(h: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), _UNPACK):
        ones += np.unpackbits(h[at : at + _UNPACK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
    digest = xxhash.xxh64_intdigest
    out = np.zeros(batch.num_rows, np.uint64)
    for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
        words = text.lower().split() if text else []
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= k:
            out[i] = digest(joined, 42)
            continue
        ends, at = [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *(e + 1 for e in ends)]
        h = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends[k - 1 :], strict=False)), np.uint64, len(words) - k + 1)
        out[i] = _bits_over_half(h)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64)), _binaries(out[:, None])], names=["doc_id", "fp", "bits"])


# --- buckets -----------------------------------------------------------------------------------------


def scheme(n: int, radius: int) -> tuple[int, int]:
    """(blocks, agreeing blocks): the fewest keys a fingerprint that leave each bucket a few random members."""
    for blocks in range(radius + 1, 4 * radius + 5):
        agree = blocks - radius
        if agree * (64 // blocks) >= np.log2(max(n, 2)) - 4 or blocks == 4 * radius + 4:
            return blocks, agree
    raise AssertionError


def masks(blocks: int, agree: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    own = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(own, agree)]


def pivots(words: int = 1) -> np.ndarray:
    """The reference fingerprints, a row of 64-bit words each."""
    return c.mix(np.arange(1, PIVOTS * words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(PIVOTS, words)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints, a row of words each."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)


def near(fp: np.ndarray, key: np.ndarray, radius: int, differ: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within the radius inside each run of equal keys, by their step (rows are sorted by key, then by the first pivot's distance).

    Only pairs of rows that differ in each array of differ count."""
    n = len(fp)
    table = np.stack([distance(fp, r) for r in pivots(fp.shape[1])]).astype(np.int16)
    left = np.arange(n - 1)
    step = 1
    while left.size:
        left = left[left + step < n]
        right = left + step
        ok = (key[left] == key[right]) & (table[0, right] - table[0, left] <= radius)  # sorted: beyond this, no later row of the bucket is near
        left, right = left[ok], right[ok]
        a, b = left, right
        for x in differ:
            ok = x[a] != x[b]
            a, b = a[ok], b[ok]
        for coordinate in table[1:]:
            if not a.size:
                break
            ok = np.abs(coordinate[a] - coordinate[b]) <= radius
            a, b = a[ok], b[ok]
        if a.size:
            ok = distance(fp[a], fp[b]) <= radius
            a, b = a[ok], b[ok]
        if a.size:
            yield a, b
        step += 1


class Forest:
    """The edges of a spanning forest of the links that are added, and each row's root so far (roots, kept in place)."""

    def __init__(self, n: int):
        self.roots = np.arange(n)
        self._a: list[np.ndarray] = []
        self._b: list[np.ndarray] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        roots = self.roots
        while a.size:
            ra, rb = roots[a], roots[b]
            ok = ra != rb
            a, b, ra, rb = a[ok], b[ok], ra[ok], rb[ok]
            if not a.size:
                break
            hi, lo = np.maximum(ra, rb), np.minimum(ra, rb)
            _, one = np.unique(hi, return_index=True)
            roots[hi[one]] = lo[one]
            while ((above := roots[roots]) != roots).any():
                roots[:] = above
            self._a.append(a[one])
            self._b.append(b[one])

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *self._a]), np.concatenate([none, *self._b])


def links(fp: np.ndarray, key: np.ndarray, radius: int, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links inside each run of equal keys.

    With other, only pairs of rows whose other differs count. Rows that are connected already are not compared again."""
    forest = Forest(len(fp))
    for a, b in near(fp, key, radius, [forest.roots] + ([] if other is None else [other])):
        forest.add(a, b)
    return forest.edges()


_EDGE_SCHEMA = "a long, b long"


def _edges(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Each forest's edges, from each member to the smallest node of its tree."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for x, y in zip(node[a].tolist(), node[b].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    pairs = [(x, r) for x in parent if (r := root(x)) != x]
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["a", "b"])


def _matrix(col: pa.Array, words: int) -> np.ndarray:
    """Fixed-length binaries as rows of 64-bit words."""
    if not len(col):
        return np.zeros((0, words), np.uint64)
    start = np.frombuffer(col.buffers()[1], np.int32)[col.offset]
    return np.frombuffer(col.buffers()[2], np.uint8)[start : start + 8 * words * len(col)].view(np.uint64).reshape(-1, words)


def _binaries(fp: np.ndarray) -> pa.Array:
    n, words = fp.shape
    offsets = np.arange(0, 8 * words * (n + 1), 8 * words, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(fp).tobytes())])


def _last_start(key: np.ndarray) -> int:
    return int(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[-1])


Find = Callable[..., tuple[np.ndarray, np.ndarray]]


def _bucket_task(find: Find, words: int, most: int, names: tuple[str, ...]):
    """Over rows sorted by bucket and first distance: edges of a forest of each bucket, no bucket having more than most rows (or shingles).

    names are the columns after node: fp, and perhaps own (shingle sets) and side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def solve(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks().to_batches()[0]
            key, node, fp = rows.column("key").to_numpy(), rows.column("node").to_numpy(), _matrix(rows.column("fp"), words)
            more = {}
            if "side" in names:
                more["other"] = rows.column("side").to_numpy()
            if "own" in names:
                own = rows.column("own")
                off = own.offsets.to_numpy().astype(np.int64)
                more["sets"] = (own.values.to_numpy()[off[0] : off[-1]], off - off[0])
            return _edges(node, *find(fp, key, **more))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += len(batch.column("own").flatten()) if "own" in names else batch.num_rows
            if size < most:
                continue
            every = pa.Table.from_batches(held)
            key = every.column("key").to_numpy()
            if at := _last_start(key):  # the last bucket may be unfinished
                yield solve(every.slice(0, at))
                every = every.slice(at).combine_chunks()
                held = every.to_batches()
                size = sum(len(x.column("own").flatten()) if "own" in names else x.num_rows for x in held)
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def bucket_edges(rows: DataFrame, radius: int, words: int, most: int = MOST) -> DataFrame:
    """Edges (a, b) that connect what links within buckets connect, from rows (bucket, node, fp, d0); d0 is the distance to the first pivot."""
    c.small_batches(rows.sparkSession)
    find = lambda fp, key, **more: links(fp, key, radius, **more)
    hot = c.cut(rows.groupBy("bucket").count().filter(F.col("count") > most).select("bucket"), "hot")
    some = not hot.isEmpty()
    own = (rows.join(hot, "bucket", "left_anti") if some else rows).repartition("bucket").sortWithinPartitions("bucket", "d0").select(F.col("bucket").alias("key"), "node", "fp")
    edges = own.mapInArrow(_bucket_task(find, words, most, ("fp",)), _EDGE_SCHEMA)
    if not some:
        c.release(hot)
        return edges
    # chunks are one value of the first pivot's distance, or a hash's part of it: two of them meet if their values are within the radius
    big = rows.join(hot, "bucket")
    parts = big.groupBy("bucket", "d0").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    chunks = c.cut(parts.select("bucket", "d0", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("sub")), "chunks")
    x, y = chunks.alias("x"), chunks.alias("y")
    later = (F.col("x.d0") < F.col("y.d0")) | (F.col("x.d0") == F.col("y.d0")) & (F.col("x.sub") <= F.col("y.sub"))
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & later & (F.col("y.d0") - F.col("x.d0") <= radius))
    pair = F.xxhash64("x.bucket", "x.d0", "x.sub", "y.d0", "y.sub").alias("pair")
    same = (F.col("x.d0") == F.col("y.d0")) & (F.col("x.sub") == F.col("y.sub"))
    # a chunk with itself: every row its own side, so all pairs count
    one = pairs.select("x.bucket", "x.d0", "x.sub", pair, F.when(same, -1).otherwise(0).alias("side"))
    two = pairs.filter(~same).select("y.bucket", "y.d0", "y.sub", pair, F.lit(1).alias("side"))
    sides = c.cut(one.union(two), "sides")
    placed = big.join(chunks.filter("sub = 0").select("bucket", "d0", "parts"), ["bucket", "d0"]).withColumn("sub", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = placed.join(sides, ["bucket", "d0", "sub"]).withColumn("side", F.when(F.col("side") < 0, F.col("node")).otherwise(F.col("side")))
    more = met.repartition("pair").sortWithinPartitions("pair", "d0").select(F.col("pair").alias("key"), "node", "fp", "side").mapInArrow(_bucket_task(find, words, most, ("fp", "side")), _EDGE_SCHEMA)
    return edges.union(more)


def fingerprint_edges(fps: DataFrame, radius: int, n: int, most: int = MOST) -> DataFrame:
    """Edges that connect what links connect, from distinct 64-bit fingerprints (fp, and as bytes: bits): buckets by agreeing blocks."""
    first = int(pivots()[0, 0].view(np.int64))
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(*scheme(n, radius))]
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)))
    rows = fps.select(F.explode(keys).alias("bucket"), F.col("fp").alias("node"), F.col("bits").alias("fp"), F.bit_count(F.col("fp").bitwiseXOR(F.lit(first))).alias("d0"))
    return bucket_edges(rows, radius, 1, most)


# --- documents of high similarity -----------------------------------------------------------------------

#: For texts that share at least SIMILARITY of their five-word shingles: words of a fingerprint, and the smallest
#: shingle hashes that are a text's buckets. Two sets with Jaccard similarity J share one of the smallest KEYS but
#: for about (1 - J) ** KEYS of the cases; their cosine is 2 J / (1 + J), so their fingerprints differ in
#: acos(cosine) / pi of the bits, give or take a few.
WORDS, KEYS, SIMILARITY = 8, 8, 0.8


#: Standard deviations of the distance by which candidates may exceed what is expected at the similarity.
WIDE = 5.0


def radius_of(similarity: float, words: int = WORDS, deviations: float = 0.0) -> int:
    """The expected distance of texts of that similarity, and so many standard deviations."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    bits = 64 * words
    return int(bits * share + deviations * np.sqrt(bits * share * (1 - share)))


def shingle_sets(col: pa.Array, k: int) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted; a text of fewer than k words is one shingle."""
    data, off = c.flat(col)
    ws, we = c.runs(c.SOLID[data], off)
    row = np.searchsorted(off, ws, "right") - 1
    h = c.span_hashes(c.LOWER[data], ws, we)
    s, at = c.shingles(h, row, k)
    edges = np.searchsorted(row[at], np.arange(len(col) + 1))
    words = np.searchsorted(row, np.arange(len(col) + 1))
    out = []
    for i in range(len(col)):
        own = np.unique(s[edges[i] : edges[i + 1]])
        if not len(own) and words[i + 1] > words[i]:
            one = h[words[i] : words[i + 1]]
            own = c.shingles(one, np.zeros(len(one), np.int64), len(one))[0]
        out.append(own)
    return out


def sketches(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """(h1, h2, fp, d0, keys) of rows (h1, h2, text): the fingerprint of the set of shingles, and its smallest hashes."""
    salts = c.mix(np.arange(1, WORDS + 1, dtype=np.uint64))
    fp = np.zeros((batch.num_rows, WORDS), np.uint64)
    keys: list[list[int]] = []
    for i, own in enumerate(shingle_sets(batch.column(2), k)):
        keys.append(own[:KEYS].view(np.int64).tolist() or [0])
        for j in range(WORDS if len(own) else 0):
            fp[i, j] = _bits_over_half(c.mix(own ^ salts[j]))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binaries(fp), pa.array(distance(fp, pivots(WORDS)[0])), pa.array(keys, pa.list_(pa.int64()))], names=["h1", "h2", "fp", "d0", "keys"])


#: Elements that one step of counting holds: shingles of pairs, or 64-bit words of bit sets.
COUNTED = 1 << 22
#: Shingles of a group that one task holds.
MOST_SHINGLES = 1 << 19


class Sets:
    """Sets of shingles, row by row; the sizes of the intersections of pairs of rows."""

    def __init__(self, values: np.ndarray, off: np.ndarray):
        self.size, self.off, self.codes = np.diff(off), off, pd.factorize(values)[0].astype(np.int64)
        self._bits: np.ndarray | None = None
        # shingles that one row has by itself meet nothing
        shared = np.bincount(self.codes, minlength=1) > 1
        number = np.cumsum(shared) - 1
        self._words = int(number[-1]) // 64 + 1 if len(number) else 1
        self._place = np.where(shared, number, -1)[self.codes] if len(self.codes) else self.codes

    def _bit_sets(self) -> np.ndarray:
        if self._bits is None:
            self._bits = np.zeros((len(self.size), self._words), np.uint64)
            row = np.repeat(np.arange(len(self.size)), self.size)
            has = self._place >= 0
            np.bitwise_or.at(self._bits, (row[has], self._place[has] >> 6), np.uint64(1) << (self._place[has] & 63).astype(np.uint64))
        return self._bits

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        if len(a) > 64 and len(self.size) * self._words <= COUNTED:
            bits = self._bit_sets()
            step = max(1, COUNTED // self._words)
            for at in range(0, len(a), step):
                out[at : at + step] = np.bitwise_count(bits[a[at : at + step]] & bits[b[at : at + step]]).sum(1)
            return out
        ends = np.cumsum(self.size[a] + self.size[b])
        at = 0
        while at < len(a):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COUNTED, "right")))
            some = np.arange(to - at)
            keys = [np.sort(np.repeat(some, self.size[x[at:to]]) * (len(self.codes) + 1) + self.codes[c.ranges(self.off[x[at:to]], self.size[x[at:to]])]) for x in (a, b)]
            every = np.sort(np.concatenate(keys), kind="stable")
            out[at:to] = np.bincount(every[1:][every[1:] == every[:-1]] // (len(self.codes) + 1), minlength=to - at)
            at = to
        return out


def similar_links(fp: np.ndarray, key: np.ndarray, radius: int, similarity: float, sets: tuple[np.ndarray, np.ndarray], other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the pairs inside each run of equal keys that share at least similarity of their shingles.

    Fingerprints within the radius name the pairs, their sets decide; rows that are connected already are not compared."""
    values, off = sets
    found: list[tuple[np.ndarray, np.ndarray]] = []
    # runs of like size together, so that a large one has bit sets of its own
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(starts, len(key)))
    few = np.repeat(size <= 64, size)
    for rows in [np.flatnonzero(few), *(np.arange(s, s + n) for s, n in zip(starts.tolist(), size.tolist(), strict=True) if n > 64)]:
        if len(rows) < 2:
            continue
        own = Sets(values[c.ranges(off[rows], off[rows + 1] - off[rows])], np.concatenate([[0], np.cumsum(off[rows + 1] - off[rows])]))
        forest = Forest(len(rows))
        for a, b in near(np.ascontiguousarray(fp[rows]), key[rows], radius, [forest.roots] + ([] if other is None else [other[rows]])):
            # sets of too different sizes can't be similar
            ok = np.minimum(own.size[a], own.size[b]) >= similarity * np.maximum(own.size[a], own.size[b]) - 1e-9
            a, b = a[ok], b[ok]
            both = own.common(a, b)
            ok = both >= similarity * (own.size[a] + own.size[b] - both) - 1e-9
            forest.add(a[ok], b[ok])
        x, y = forest.edges()
        found.append((rows[x], rows[y]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(x for x, _ in found)]), np.concatenate([none, *(y for _, y in found)])


def similar_edges(rows: DataFrame, radius: int, similarity: float, most: int) -> DataFrame:
    """Edges that connect what similar pairs within buckets connect, from rows (bucket, node, fp, d0, own), own being the shingles.

    A bucket with more than most shingles is dealt into parts by a hash of the node, and each two parts are a task."""
    c.small_batches(rows.sparkSession)
    find = lambda fp, key, **more: similar_links(fp, key, radius, similarity, **more)
    hot = c.cut(rows.groupBy("bucket").agg(F.ceil(F.sum(F.size("own")) / most).cast("int").alias("parts")).filter("parts > 1"), "hot")
    some = not hot.isEmpty()
    own = (rows.join(hot, "bucket", "left_anti") if some else rows).repartition("bucket").sortWithinPartitions("bucket", "d0").select(F.col("bucket").alias("key"), "node", "fp", "own")
    edges = own.mapInArrow(_bucket_task(find, WORDS, most, ("fp", "own")), _EDGE_SCHEMA)
    if not some:
        c.release(hot)
        return edges
    placed = rows.join(hot, "bucket").withColumn("sub", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # a part with itself: every row its own side, so all pairs count
    side = F.when(F.col("sub") == F.col("t"), F.col("node")).when(F.col("sub") < F.col("t"), F.lit(-1)).otherwise(F.lit(-2)).cast("long")
    pair = F.xxhash64("bucket", F.least("sub", "t"), F.greatest("sub", "t"))
    met = placed.select(pair.alias("key"), "node", "fp", "own", side.alias("side"), "d0")
    more = met.repartition("key").sortWithinPartitions("key", "d0").select("key", "node", "fp", "own", "side").mapInArrow(_bucket_task(find, WORDS, most, ("fp", "own", "side")), _EDGE_SCHEMA)
    return edges.union(more)


def similar_groups(buckets: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float, most: int, most_shingles: int) -> DataFrame:
    """(node, root) of the groups that pairs of at least that similarity connect, from rows (bucket, node, fp, d0); sets gives
    (node, fp, d0, own) of nodes.

    Fingerprints within a radius that few similar pairs exceed make loose groups; inside these, shingles are counted exactly.
    Both steps pass on no more edges than rows, however many pairs are near or similar."""
    radius = radius_of(similarity, deviations=WIDE)
    loose = components(bucket_edges(buckets, radius, WORDS, most))
    held = c.cut(sets(loose.select("node")), "sets")
    rows = held.join(loose, "node").withColumnRenamed("root", "bucket")
    return components(similar_edges(rows, radius, similarity, most_shingles))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = SIMILARITY, most: int = MOST, most_shingles: int = MOST_SHINGLES) -> DataFrame:
    """The rows of docs, all columns, without near copies: of each group the row with the least id (then text hash) stays.

    Null ids come first; null and empty texts are one text, and texts without words one group; of rows with equal id and
    text one stays; extra columns pass through, whatever their names; an empty table gives an empty result."""
    h1, h2, k0, k1, k2 = c.fresh(docs, "h1", "h2", "k0", "k1", "k2")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.withColumns({h1: F.xxhash64(text), h2: F.xxhash64(F.lit(1), text)})
    texts = rows.select(F.col(h1).alias("h1"), F.col(h2).alias("h2"), text.alias("text"))
    made = c.cut(c.map_text(texts, lambda b: sketches(b, k), "h1 long, h2 long, fp binary, d0 int, keys array<long>"), "sketches")
    # equal texts, by 128 bits, are one node; what they emit is equal too, so any of them will do
    one = c.row_cut(made.groupBy("h1", "h2").agg(F.any_value("fp").alias("fp"), F.any_value("d0").alias("d0"), F.any_value("keys").alias("keys")), "nodes", "node")
    buckets = one.select(F.explode("keys").alias("bucket"), "node", "fp", "d0")

    def sets(nodes: DataFrame) -> DataFrame:
        wanted = texts.join(one.join(nodes, "node", "left_semi").select("h1", "h2", "node", "fp", "d0"), ["h1", "h2"]).groupBy("node").agg(F.any_value("fp").alias("fp"), F.any_value("d0").alias("d0"), F.any_value("text").alias("text"))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = shingle_sets(batch.column(3), k)
            off = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            values = pa.array(np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64))
            return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(off, pa.int32()), values)], names=["node", "fp", "d0", "own"])

        return c.map_text(wanted.select("node", "fp", "d0", "text"), run, "node long, fp binary, d0 int, own array<long>")

    root = similar_groups(buckets, sets, similarity, most, most_shingles)
    rooted = one.select("h1", "h2", "node").join(root, "node", "left").select(F.col("h1").alias("n1"), F.col("h2").alias("n2"), F.coalesce("root", "node").alias("root"))
    names = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(h1).alias("n1"), F.col(h2).alias("n2")).distinct()
    least = names.join(rooted, ["n1", "n2"]).groupBy("root").agg(F.min(F.struct("id", "n1", "n2")).alias("s"))
    chosen = c.cut(least.select(F.col("s.id").alias(k0), F.col("s.n1").alias(k1), F.col("s.n2").alias(k2)), "kept")
    kept = rows.join(chosen, F.col(f"`{id_col}`").eqNullSafe(F.col(k0)) & (F.col(h1) == F.col(k1)) & (F.col(h2) == F.col(k2)), "left_semi")
    if made.count() > names.count():  # equal rows, of which one stays
        kept = kept.dropDuplicates([id_col, h1, h2])
    return kept.drop(h1, h2)


# --- components ---------------------------------------------------------------------------------------


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of each node of an edge, root being the smallest node of its component.

    Rounds of large-star and small-star: in each, a node's larger (then smaller) neighbours are tied to the least
    of them. What a round gathers for a node is a minimum, combined before it shuffles."""
    now = c.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that both sides of the join are shuffled and Spark can split a node with very many neighbours
        least = c.cut(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        joined = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = joined.select("u", F.col("m").alias("v")).union(joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        after = c.cut(small, "star")
        c.release(now, least)  # what this round has replaced
        # done when each node has one edge and no root has one
        left = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        now = after
        if not left:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, radius: int = 4, most: int = MOST) -> DataFrame:
    """A row per document: doc_id, fingerprint (16 hex digits), component_id, the least id of its component."""
    df = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    base = c.cut(c.map_text(df, lambda b: fingerprints(b, k), "doc_id long, fp long, bits binary"), "fingerprints")
    own = c.cut(base.groupBy("fp").agg(F.min("doc_id").alias("least"), F.any_value("bits").alias("bits")), "distinct")
    root = components(fingerprint_edges(own.select("fp", "bits"), radius, own.count(), most))
    groups = own.join(root, own["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    of = c.cut(groups.join(least, "root").select("fp", "component_id"), "groups")
    return base.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
