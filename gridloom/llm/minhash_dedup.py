"""Near duplicates by circulant MinHash, banding and exact Jaccard similarity.

A document is the set of its distinct shingles. One permutation scatters a shingle over the 64-bit numbers; a second one,
shifted circularly by one step more for each coordinate, ranks it there, and a signature's coordinate is the least rank
in the set. So two permutations give all coordinates. Runs of ROWS coordinates are bands; documents that agree on a band
are candidates. Two sets of similarity 0.8 agree on none of the bands with a chance of (1 - 0.8 ** ROWS) ** BANDS, 5e-8.

Equal sets are one node, so copies cost nothing further. The smallest node of a band's bucket leads it. Every other
member is compared with its leader first, on full sets: a pair of node and leader is a row with the node's text, whatever
the number of bands that bring it. What these links connect needs no more comparing, so only buckets of members that are
still apart go on; there, all members of one leader are a group, and pairs that are apart are compared on full sets,
unless their exact distances to the leader (a metric) or the sizes of their sets exclude them. No pair leaves a task, only
edges of spanning forests do. A group with more than MOST shingles is dealt over tasks: the rows of its largest
component are split, and all others meet each part, so the work grows with the square only of what stands outside that.

Texts are the only large rows that move: once to the pairs that want them, and once for each pair. Null texts and texts
without words have an empty set, link with nothing and stay; fewer words than a shingle are one shingle; a text of any
length is one unit, held by one task; similarities of just the threshold link. A component's id is the least id in it,
null only if it has no other; rows of equal id are rows like all others, and all of those with the least id are kept;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .simhash_dedup import Forest, Sets, components, shingle_sets

#: Coordinates of a band, and bands.
ROWS, BANDS = 4, 32
#: Shingles whose ranks are taken at once: a block that stays in a core's cache.
BLOCK = 1 << 14
#: Members of a leader that one task compares with it, and shingles of a group that one task holds.
MEMBERS, MOST = 4_000, 1 << 21

_SHIFT = np.uint64(0x9E3779B97F4A7C15)
_RANK = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def signature(values: np.ndarray, starts: np.ndarray, coordinates: int = ROWS * BANDS) -> np.ndarray:
    """A row of least ranks for each of the sets that begin at starts (none empty) in values."""
    out = np.empty((len(starts), coordinates), np.uint64)
    bounds = np.append(starts, len(values))
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK, "right")) - 1)
        place = c.mix(values[bounds[at] : bounds[to]])  # the first permutation
        rank, half = np.empty_like(place), np.empty_like(place)
        own = bounds[at:to] - bounds[at]
        for k in range(coordinates):
            place += _SHIFT  # one step more around the circle
            np.right_shift(place, np.uint64(32), out=half)  # the second permutation
            np.bitwise_xor(place, half, out=rank)
            np.multiply(rank, _RANK[0], out=rank)
            np.right_shift(rank, np.uint64(29), out=half)
            np.bitwise_xor(rank, half, out=rank)
            np.multiply(rank, _RANK[1], out=rank)
            out[at:to, k] = np.minimum.reduceat(rank, own)
        at = to
    return out


def bands(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key for each band of each signature."""
    n, k = signatures.shape
    parts = signatures.reshape(n, k // rows, rows)
    keys = np.broadcast_to(np.arange(1, k // rows + 1, dtype=np.uint64), (n, k // rows))
    for j in range(rows):
        keys = c.mix(keys * _SHIFT + parts[:, :, j])
    return keys


_SKETCH = "doc_id long, h1 long, h2 long, n_shingles long, s1 long, s2 long, keys array<long>"


def sketches(batch: pa.RecordBatch, k: int, rows: int, n_bands: int) -> pa.RecordBatch:
    """The set's size, 128 bits that name it, and its bands' keys, of rows (doc_id, h1, h2, text); an empty set has no keys."""
    sets = shingle_sets(batch.column(3), k)
    size = np.array([len(x) for x in sets], np.int64)
    values = np.concatenate([*sets, np.zeros(0, np.uint64)])
    some = np.flatnonzero(size)
    starts = (np.cumsum(size) - size)[some]
    name = np.zeros((len(sets), 2), np.uint64)
    if len(some):
        for j in range(2):
            name[some, j] = np.add.reduceat(c.mix(values ^ np.uint64(j + 1)), starts)
    keys = bands(signature(values, starts, rows * n_bands), rows).view(np.int64).ravel() if len(some) else np.zeros(0, np.int64)
    off = pa.array(np.concatenate([[0], np.cumsum(np.where(size > 0, n_bands, 0))]), pa.int32())
    return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size), *(pa.array(name[:, j].view(np.int64)) for j in range(2)), pa.ListArray.from_arrays(off, pa.array(keys))], names=[x.split()[0] for x in _SKETCH.split(", ")])


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


_STAR = "leader long, node long, shared long, total long"


def _stars(k: int):
    """Over rows (leader, node, kind, text) sorted so that a leader's own text comes before its members': what each pair shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.zeros(0, np.uint64)
        for batch in batches:
            for part in c.pieces(batch, "text"):
                leader, node, kind = (part.column(i).to_pylist() for i in range(3))
                found = []
                for who, other, own, values in zip(leader, node, kind, shingle_sets(part.column(3), k), strict=True):
                    if own == 0:
                        first = values
                        continue
                    n = shared(first, values)
                    found.append((who, other, n, len(first) + len(values) - n))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["leader", "node", "shared", "total"])

    return run


def apart_links(values: np.ndarray, off: np.ndarray, root: np.ndarray, distance: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (of roots) of a spanning forest of the links between rows of different roots and, unless it is 0, sides; rows are sorted by distance."""
    sets = Sets(values, off)
    names, of = np.unique(root, return_inverse=True)
    forest = Forest(len(names))
    reach = 1 - percent / 100 + 1e-9
    left, step = np.arange(len(root)), 1
    while left.size:
        left = left[left + step < len(root)]
        left = left[distance[left + step] - distance[left] <= reach]  # sorted: no later row comes nearer
        a, b = left, left + step
        ok = (forest.roots[of[a]] != forest.roots[of[b]]) & ((side[a] != side[b]) | (side[a] == 0))
        ok &= 100 * np.minimum(sets.size[a], sets.size[b]) >= percent * np.maximum(sets.size[a], sets.size[b])
        a, b = a[ok], b[ok]
        if a.size:
            both = sets.common(a, b)
            ok = 100 * both >= percent * (sets.size[a] + sets.size[b] - both)
            forest.add(of[a[ok]], of[b[ok]])
        step += 1
    x, y = forest.edges()
    return names[x], names[y]


def _groups(k: int, percent: int):
    """Over rows (task, root, distance, side, text) sorted by task and distance: edges of roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []

        def solve() -> pa.RecordBatch:
            sets = [x for h in held for x in h[0]]
            root, distance, side = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            off = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            a, b = apart_links(np.concatenate(sets), off, root, distance, side, percent)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            for part in c.pieces(batch, "text"):
                own = part.column(0).to_numpy()
                edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(own)], strict=True):
                    if own[s] != task:
                        if held:
                            yield solve()
                        task, held = own[s], []
                    some = part.slice(s, e - s)
                    held.append((shingle_sets(some.column(4), k), *(some.column(i).to_numpy() for i in (1, 2, 3))))
        if held:
            yield solve()

    return run


def near_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, percent: int = 80, rows: int = ROWS, n_bands: int = BANDS, members: int = MEMBERS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(documents, nodes): rows (doc_id, n_shingles, s1, s2), and for each distinct set that is not empty (s1, s2, component_id).

    Links are pairs of sets that share at least percent of their union."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))
    made = c.cut(c.map_text(texts, lambda b: sketches(b, k, rows, n_bands), _SKETCH, most=1 << 19), "sketches")
    one = made.filter("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min(F.struct("doc_id", "h1", "h2")).alias("at"), F.min("doc_id").alias("least"), F.any_value("keys").alias("keys"))
    nodes = c.row_cut(one.select("s1", "s2", "n_shingles", "at.doc_id", "at.h1", "at.h2", "least", "keys"), "nodes", "node")
    keys = nodes.select("node", F.explode("keys").alias("key"))
    leaders = keys.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1").drop("n")
    pairs = c.cut(keys.join(leaders, "key").filter("node > leader").select("leader", "node").distinct(), "pairs")
    named = nodes.select("node", "n_shingles", "doc_id", "h1", "h2")

    def with_text(wanted: DataFrame, *columns: str) -> DataFrame:
        """Rows of wanted (node, columns) with the text of the node; of repeated rows of documents any one."""
        places = wanted.join(named.drop("n_shingles"), "node").select("node", *columns, F.col("doc_id").alias("i"), F.col("h1").alias("x"), F.col("h2").alias("y"))
        met = texts.join(places, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h1") == F.col("x")) & (F.col("h2") == F.col("y"))).select("node", *columns, "text")
        return met

    c.small_batches(docs.sparkSession)
    parts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / members).cast("int").alias("parts"))
    placed = pairs.join(parts, "leader").select("node", "leader", F.lit(1).alias("kind"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    heads = parts.select(F.col("leader").alias("node"), "leader", F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    roles = with_text(placed.union(heads), "leader", "kind", "part").repartition("leader", "part").sortWithinPartitions("leader", "part", "kind")
    stars = c.cut(roles.select("leader", "node", "kind", "text").mapInArrow(_stars(k), _STAR), "stars")
    linked = stars.filter(f"100 * shared >= {percent} * total").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    roots = c.cut(components(linked), "roots")
    joined = _joined(stars, roots, named, with_text, k, percent, most)
    if joined is not None:
        onward = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
        roots = roots.join(onward, "root", "left").select("node", F.coalesce("top", "root").alias("root")).union(onward.select(F.col("root").alias("node"), "top").join(roots.select("node"), "node", "left_anti"))
    of = nodes.select("node", "s1", "s2", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return made.select("doc_id", "n_shingles", "s1", "s2"), c.cut(of.join(least, "root").select("s1", "s2", "component_id"), "sets")


def dealt(rows: DataFrame, most: int) -> DataFrame:
    """(node, task, root, distance, side) from rows (leader, node, root, distance, n_shingles): the tasks that a leader's members are compared in."""
    sizes = rows.groupBy("leader", "root").agg(F.sum("n_shingles").alias("n"))
    split = sizes.groupBy("leader").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all")).select(
        "leader", F.col("top.root").alias("big"), F.when(F.col("all") <= most, 0).otherwise(F.ceil(F.col("top.n") / most)).cast("int").alias("p"),
        F.when(F.col("all") <= most, 1).otherwise(F.ceil((F.col("all") - F.col("top.n")) / most)).cast("int").alias("r"))
    # parts 0 .. p - 1 are the largest component's, p .. p + r - 1 all others'; each two parts of which one is another's are a task
    met = rows.join(split, "leader").withColumn("h", F.xxhash64("node"))
    big = (F.col("root") == F.col("big")) & (F.col("p") > 0)
    met = met.withColumn("own", F.when(big, F.pmod("h", "p")).otherwise(F.col("p") + F.pmod("h", "r")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.when(big, F.col("p")).otherwise(0), F.col("p") + F.col("r") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return met.select("node", F.xxhash64("leader", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "root", "distance", side.alias("side"))


def _joined(stars: DataFrame, roots: DataFrame, named: DataFrame, with_text, k: int, percent: int, most: int) -> DataFrame | None:
    """(node, root) of the components (named by their nodes) that links between members of one leader join; None if no leader has members that are apart."""
    distance = 1 - F.col("shared") / F.col("total")
    rooted = stars.select("leader", "node", distance.alias("distance")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = rooted.groupBy("leader").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("leader")
    rows = c.cut(rooted.join(apart, "leader").join(named.select("node", "n_shingles"), "node"), "apart")
    if rows.isEmpty():
        return None
    texts = with_text(dealt(rows, most), "task", "root", "distance", "side").repartition("task").sortWithinPartitions("task", "distance")
    edges = texts.select("task", "root", "distance", "side", "text").mapInArrow(_groups(k, percent), "a long, b long")
    return components(edges)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (the least id of its component) and kept (whether that is its own)."""
    own, sets = near_sets(docs, id_col, text_col, **options)
    met = own.join(sets, ["s1", "s2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return met.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
