"""Sparse products on a grid of tiles.

The rows of A are dealt into R strips, the columns of B into C, the contracted index into K slabs, each by a hash. A
tile is a strip of A, a strip of B and a slab; a task multiplies the cells of its tiles and sums their products before
anything is shuffled again. With one slab a tile's sums are cells of the result, and what is shuffled is A's cells C times
and B's R times; with several, each cell of A and B goes to fewer tiles, and a cell of the result comes from up to K of
them. Which is cheaper depends on the sizes of A, B and A B, and these are known or estimated first (plans.sizes). A
contracted index with very many cells on both sides needs no special case, as its cells lie in all strips; slabs split
a long row of A or column of B. Cells travel packed, a row of a table for each strip of a batch, in as few bytes as their
indices and values need.

Where a grid would send cells often, they are routed instead: cells of both sides meet once by the contracted index, and a
cell of A goes only to strips of B that have cells at its index (and the other way round). Strips are ranges of rows and of
columns there if these are loaded evenly, so that what lies together in a matrix of blocks goes to few tiles.

A A.T needs A once: its cells are summed and written as records that hold all cells of some contracted indices, so that no
cell is shuffled to meet others. A tile is a pair of strips of rows, made once for both halves of the result, and gets a cell
once, if its strip is one of the two and the other has a cell at its index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..plans import sizes
from ..plans.lineage import cleaned, cut

#: Products of a tile and cells that it holds of A and B, about; cells of a packed row; products that are made at once.
PRODUCTS, CELLS, PACKED, AT_ONCE = 20_000_000, 2_000_000, 1 << 16, 1 << 21
#: Places of a tile's result that are summed in an array of all of them.
DENSE = 1 << 22


@dataclass(frozen=True)
class Grid:
    rows: int = 1
    cols: int = 1
    slabs: int = 1


def grid(facts: sizes.Facts, cores: int, cells: float | None = None) -> Grid:
    """The cheapest grid whose tiles are small enough; cells: of the result, if they are known or estimated."""
    a, b = max(1, facts.a), max(1, facts.b)
    tiles = max(1, ceil(facts.products / PRODUCTS), min(cores, ceil(facts.products / 250_000)))
    rows, cols = 1, 1
    while rows * cols < tiles or a / rows + b / cols > CELLS:
        # one more strip of B gives as many tiles as A has strips, and sends A once more; and the other way round
        if a * cols <= b * rows and not (a / rows > CELLS / 2 >= b / cols) or b / cols > CELLS / 2 >= a / rows:
            cols += 1
        else:
            rows += 1
    rows, cols = min(rows, max(1, facts.rows)), min(cols, max(1, facts.cols))
    slabs = max(1, ceil(max(facts.longest_row, facts.longest_col) / CELLS))
    if slabs == 1 and cells is not None:
        split = max(tiles, ceil((a + b) / CELLS))
        if a + b + min(facts.products, cells * split) < a * cols + b * rows:
            return Grid(1, 1, split)
    return Grid(rows, cols, slabs)


@dataclass(frozen=True)
class Route:
    """Strips of A's rows and B's columns, and slabs in which cells meet before they are sent to tiles; n: rows and columns if strips are ranges, else 0."""

    rows: int
    cols: int
    slabs: int
    n_rows: int = 0
    n_cols: int = 0


def route(a: DataFrame, b: DataFrame, facts: sizes.Facts, cores: int) -> tuple[Route, int]:
    """Strips as the grid has them, by ranges where no range has twice its share, and how many cells they send to tiles."""
    g = grid(facts, cores)

    def even(df: DataFrame, key: str, n: int, strips: int, stored: int) -> int:
        most = df.groupBy(_ranged(key, n, strips)).count().agg(F.max("count")).first()[0] or 0
        return n if most <= 2 * max(1, stored / strips) else 0

    r = Route(g.rows, g.cols, max(1, ceil(2 * (facts.a + facts.b) / CELLS)), even(a, "i", facts.rows, g.rows, facts.a), even(b, "j", facts.cols, g.cols, facts.b))

    def met(df: DataFrame, at: str, m: str, n: int, strips: int, names: list[str]) -> DataFrame:
        strip = _ranged(at, n, strips) if n else F.pmod(F.xxhash64(at), F.lit(strips))  # of a hash, as many as of any other
        parts = df.groupBy(F.col(m).alias("m"), strip.alias("s")).agg(F.count("*").alias("n")).groupBy("m").agg(F.sum("n"), F.count("*"))
        return parts.toDF("m", *names)

    each = met(a, "i", "j", r.n_rows, r.rows, ["x", "p"]).join(met(b, "j", "i", r.n_cols, r.cols, ["y", "q"]), "m")
    return r, int(each.agg(F.sum(F.col("x") * F.col("q") + F.col("y") * F.col("p"))).first()[0] or 0)


def _ranged(key: str, n: int, strips: int):
    return F.floor(F.col(key) / ceil(n / strips))


def narrow(x: np.ndarray) -> bytes:
    """Whole numbers (as floats, too) as steps from the least one, in as few bytes as the longest needs; other floats in four bytes if that loses nothing. A letter for the kind and eight bytes for the least one go ahead."""
    whole, low = x, 0
    if x.dtype.kind == "f":
        if not (np.isfinite(x).all() and (np.abs(x) < 2.0**53).all() and (x == np.rint(x)).all()):
            with np.errstate(over="ignore"):
                short = x.astype(np.float32)
            return b"f" + bytes(8) + short.tobytes() if (short == x).all() else b"d" + bytes(8) + x.tobytes()
        whole = x.astype(np.int64)
    if len(whole):
        low = int(whole.min())
        span = int(whole.max()) - low
        if span >= 1 << 63:
            return b"q" + bytes(8) + whole.tobytes()
        whole = (whole - low).astype(next(k for k in ("u1", "u2", "u4", "u8") if span < 1 << 8 * int(k[1])))
    return whole.dtype.char.encode() + low.to_bytes(8, "little", signed=True) + whole.tobytes()


def widened(packed: bytes, kind: type) -> np.ndarray:
    """What narrow packed, int64 or float64 as before."""
    steps = np.frombuffer(packed, chr(packed[0]), offset=9)
    return steps.astype(kind) if packed[:1] in b"fdq" else (steps.astype(np.int64) + int.from_bytes(packed[1:9], "little", signed=True)).astype(kind, copy=False)


def _cells(at: np.ndarray, m: np.ndarray, v: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Cells in the order of m, packed: of m the steps from one cell to the next. Indices at stay as they are."""
    return at.tobytes(), m[:1].tobytes() + narrow(np.diff(m)), narrow(v)


def _read(at: bytes, m: bytes, v: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = widened(m[8:], np.int64)
    return np.frombuffer(at, np.int64), np.cumsum(np.concatenate([np.frombuffer(m, np.int64, 1), steps])), widened(v, float)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Spread hashes of indices."""
    x = (x.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _dealt(side: int, g: Grid):
    """Over cells of A (i, m, v) or B (j, m, v): packed rows (side, strip, slab, at, m, v)."""
    strips = g.cols if side else g.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            at, m, v = (np.concatenate(x) for x in zip(*held, strict=True))
            part = (_mixed(at, 1) % np.uint64(strips)).astype(np.int64) * g.slabs + (_mixed(m, 2) % np.uint64(g.slabs)).astype(np.int64)
            order = np.lexsort((m, part))
            at, m, v, part = at[order], m[order], v[order], part[order]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            found = [(int(part[s]) // g.slabs, int(part[s]) % g.slabs, *_cells(at[s:e], m[s:e], v[s:e])) for s, e in zip(first, [*first[1:], len(at)], strict=True)]
            strip, slab, *binary = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([side] * len(found), pa.int32()), pa.array(strip, pa.int32()), pa.array(slab, pa.int32()), *(pa.array(x, pa.binary()) for x in binary)], names=["side", "strip", "slab", "at", "m", "v"])

        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(n).to_numpy() for n in range(3)])
                size += batch.num_rows
            if size >= PACKED * min(64, strips * g.slabs):
                yield packed()
                held, size = [], 0
        if held:
            yield packed()

    return run


def _met(side: int, slabs: int):
    """Over cells (at, m, v): packed rows (slab, side, at, m, v)."""
    run = _dealt(side, Grid(1, 1, slabs))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch.select(["slab", "side", "at", "m", "v"])

    return packed


def _sent(r: Route):
    """Over packed rows (slab, side, at, m, v) sorted by slab: packed rows (tile, side, at, m, v), each cell for every strip of the other side that has its m."""

    def strips(at: np.ndarray, n: int, many: int, salt: int) -> np.ndarray:
        return at // ceil(n / many) if n else (_mixed(at, salt) % np.uint64(many)).astype(np.int64)

    def packed(side: int, at: np.ndarray, m: np.ndarray, v: np.ndarray, own: np.ndarray, other: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        low, high = np.searchsorted(other[0], m, "left"), np.searchsorted(other[0], m, "right")
        ends = np.cumsum(high - low)
        s = 0
        while s < len(at):
            e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + AT_ONCE, "right")))
            count = (high - low)[s:e]
            cell = np.repeat(np.arange(s, e), count)
            strip = other[1][_ranges(low[s:e], count)]
            tile = own[cell] * r.cols + strip if side == 0 else strip * r.cols + own[cell]
            order = np.argsort(tile, kind="stable")
            tile, cell = tile[order], cell[order]
            first = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])) if len(tile) else np.zeros(0, np.int64)
            for f, t in zip(first, [*first[1:], len(tile)], strict=True):
                for x in range(f, t, PACKED):
                    some = cell[x : min(t, x + PACKED)]
                    _, *rest = _cells(at[some], m[some], v[some])
                    yield pa.RecordBatch.from_arrays([pa.array([int(tile[f])], pa.int64()), pa.array([side], pa.int32()), *(pa.array([y], pa.binary()) for y in (narrow(at[some]), *rest))], names=["tile", "side", "at", "m", "v"])
            s = e

    def solved(held: tuple[list, list]) -> Iterator[pa.RecordBatch]:
        if held[0] and held[1]:
            a, b = ([np.concatenate(x) for x in zip(*own, strict=True)] for own in held)
            a, b = ([x[order] for x in cells] for cells, order in ((cells, np.argsort(cells[1], kind="stable")) for cells in (a, b)))
            row, col = strips(a[0], r.n_rows, r.rows, 1), strips(b[0], r.n_cols, r.cols, 1)
            for side, cells, own, other, theirs in ((0, a, row, b, col), (1, b, col, a, row)):
                order = np.lexsort((theirs, other[1]))
                m, strip = other[1][order], theirs[order]
                new = np.concatenate([[True], (m[1:] != m[:-1]) | (strip[1:] != strip[:-1])])
                yield from packed(side, *cells, own, (m[new], strip[new]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])
        for batch in batches:
            for slab, side, at, m, v in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if slab != now:
                    yield from solved(held)
                    now, held = slab, ([], [])
                held[side].append(_read(at, m, v))
        yield from solved(held)

    return run


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def multiplied(ai: np.ndarray, am: np.ndarray, av: np.ndarray, bj: np.ndarray, bm: np.ndarray, bv: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells (i, j, v) of the sums of products at equal m."""
    order = np.argsort(bm, kind="stable")
    bj, bm, bv = bj[order], bm[order], bv[order]
    low, high = np.searchsorted(bm, am, "left"), np.searchsorted(bm, am, "right")
    some = np.flatnonzero(high > low)
    ai, av, low, count = ai[some], av[some], low[some], (high - low)[some]
    rows, ai = np.unique(ai, return_inverse=True)
    cols, bj = np.unique(bj, return_inverse=True)
    wide = len(cols)
    dense = np.zeros(len(rows) * wide) if len(rows) * wide <= DENSE else None
    keys, sums = [np.zeros(0, np.int64)], [np.zeros(0)]

    def compact() -> None:
        k, v = np.concatenate(keys), np.concatenate(sums)
        order = np.argsort(k, kind="stable")
        k, v = k[order], v[order]
        at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        keys[:], sums[:] = [k[at]], [np.add.reduceat(v, at) if len(at) else v]

    ends = np.cumsum(count)
    at = kept = 0
    while at < len(ai):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        other = _ranges(low[at:to], count[at:to])
        key = np.repeat(ai[at:to] * wide, count[at:to]) + bj[other]
        value = np.repeat(av[at:to], count[at:to]) * bv[other]
        if dense is not None:
            dense += np.bincount(key, value, len(dense))
        else:
            keys.append(key)
            sums.append(value)
            if sum(map(len, keys)) > 4 * AT_ONCE + 2 * kept:
                compact()
                kept = len(keys[0])
        at = to
    if dense is not None:
        key = np.flatnonzero(dense)
        return rows[key // max(1, wide)], cols[key % max(1, wide)], dense[key]
    compact()
    return rows[keys[0] // wide], cols[keys[0] % wide], sums[0]


def _tiles(batches: Iterator[pa.RecordBatch], sent: bool = False) -> Iterator[pa.RecordBatch]:
    """Over packed rows (tile, side, at, m, v) sorted by tile: cells. sent: at is narrow."""
    now, held = None, ([], [])

    def solved() -> Iterator[pa.RecordBatch]:
        if held[0] and held[1]:
            parts = [np.concatenate(x) for own in held for x in zip(*own, strict=True)]
            out = multiplied(*parts)
            for at in range(0, len(out[0]), PACKED):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + PACKED]) for x in out], names=["i", "j", "v"])

    for batch in batches:
        for tile, side, at, m, v in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if tile != now:
                yield from solved()
                now, held = tile, ([], [])
            held[side].append(_read(widened(at, np.int64) if sent else at, m, v))
    yield from solved()


def tiled(a: DataFrame, b: DataFrame, g: Grid) -> DataFrame:
    """Cells (i, j, v) of A B from canonical real cells (i, j, v) of both, sums that are exactly zero left out."""
    kind = "side int, strip int, slab int, at binary, m binary, v binary"
    left = a.select("i", "j", "v").mapInArrow(_dealt(0, g), kind)
    right = b.select(F.col("j").alias("at"), F.col("i").alias("m"), "v").mapInArrow(_dealt(1, g), kind)
    number = lambda row, col: (row * g.cols + col) * g.slabs + F.col("slab")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.select(every(g.cols).alias("col"), "*").select(number(F.col("strip"), F.col("col")).alias("tile"), "side", "at", "m", "v")
    right = right.select(every(g.rows).alias("row"), "*").select(number(F.col("row"), F.col("strip")).alias("tile"), "side", "at", "m", "v")
    out = left.union(right).repartition(g.rows * g.cols * g.slabs, "tile").sortWithinPartitions("tile").mapInArrow(_tiles, "i long, j long, v double")
    if g.slabs > 1:
        out = out.groupBy("i", "j").agg(F.sum("v").alias("v"))
    return out.filter(V.nonzero("float64", F.col("v")))


def routed(a: DataFrame, b: DataFrame, r: Route, parts: int) -> DataFrame:
    """The same as tiled, from cells that went only where they meet others; tiles are dealt to so many tasks."""
    kind = "side int, at binary, m binary, v binary"
    left = a.select("i", "j", "v").mapInArrow(_met(0, r.slabs), f"slab int, {kind}")
    right = b.select(F.col("j").alias("at"), F.col("i").alias("m"), "v").mapInArrow(_met(1, r.slabs), f"slab int, {kind}")
    sent = left.union(right).repartition(r.slabs, "slab").sortWithinPartitions("slab").mapInArrow(_sent(r), f"tile long, {kind}")
    out = sent.repartition(parts, "tile").sortWithinPartitions("tile").mapInArrow(partial(_tiles, sent=True), "i long, j long, v double")
    return out.filter(V.nonzero("float64", F.col("v")))


#: Counts that say how evenly indices lie; cells of a record, about; slabs in which duplicates meet have about CELLS / 2 cells.
BUCKETS, RECORD = 1 << 12, 1 << 17
_RECORD = "at binary, m binary, v binary"


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (m): how many there are by bucket of a hash."""
    n = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        n += np.bincount((_mixed(batch.column(0).to_numpy(), 2) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["k", "n"])


def _summed(at: np.ndarray, m: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In the order of m and at, each place once."""
    order = np.lexsort((at, m))
    at, m, v = at[order], m[order], v[order]
    new = np.concatenate([[True], (m[1:] != m[:-1]) | (at[1:] != at[:-1])])
    return (at, m, v) if new.all() else (at[new], m[new], np.add.reduceat(v, np.flatnonzero(new)))


def _record(slab: int | None, at: np.ndarray, m: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    found = [pa.array([x], pa.binary()) for x in (narrow(at), *_cells(at[:0], m, v)[1:])]
    return pa.RecordBatch.from_arrays(([pa.array([slab], pa.int32())] if slab is not None else []) + found, names=(["slab"] if slab is not None else []) + ["at", "m", "v"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at, m, v in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            yield _read(widened(at, np.int64), m, v)


def _slabs(slabs: int):
    """Over cells (at, m, v): packed rows (slab, at, m, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            at, m, v = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            slab = (_mixed(m, 2) % np.uint64(BUCKETS)).astype(np.int64) % slabs
            order = np.argsort(slab, kind="stable")
            edges = np.searchsorted(slab[order], np.arange(slabs + 1))
            for k in np.flatnonzero(np.diff(edges)):
                some = order[edges[k] : edges[k + 1]]
                yield _record(int(k), at[some], m[some], v[some])

        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(n).to_numpy() for n in range(3)])
                size += batch.num_rows
            if size >= PACKED * min(32, slabs):
                yield from packed()
                held, size = [], 0
        if held:
            yield from packed()

    return run


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over packed rows (slab, at, m, v) sorted by slab: records (at, m, v), each with all cells of its m."""
    now, held = None, []

    def done() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        at, m, v = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        s = 0
        while s < len(m):
            e = len(m) if s + RECORD >= len(m) else int(np.searchsorted(m, m[s + RECORD], "left"))
            if e <= s:
                e = int(np.searchsorted(m, m[s], "right"))
            yield _record(None, at[s:e], m[s:e], v[s:e])
            s = e

    for batch in batches:
        for slab, at, m, v in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if slab != now:
                yield from done()
                now, held = slab, []
            held.append(_read(widened(at, np.int64), m, v))
    yield from done()


def _bucket(at: np.ndarray, n: int = 0) -> np.ndarray:
    """By ranges of n rows or (n: 0) a hash."""
    return np.clip(at // ceil(n / BUCKETS), 0, BUCKETS - 1) if n else (_mixed(at, 1) % np.uint64(BUCKETS)).astype(np.int64)


def _row_counts(n: int):
    """Over records: (kind, k, n): cells by range of rows (0) and by hash of rows (1), products (2) and records (3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, products, records = np.zeros((2, BUCKETS), np.int64), 0, 0
        for at, m, _ in _opened(batches):
            counts[0] += np.bincount(_bucket(at, n), minlength=BUCKETS)
            counts[1] += np.bincount(_bucket(at), minlength=BUCKETS)
            products += int((np.diff(np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1], [True]]))) ** 2).sum())
            records += 1
        kind, k = np.nonzero(counts)
        rows = [np.concatenate([x, y]) for x, y in ((kind, [2, 3]), (k, [0, 0]), (counts[kind, k], [products, records]))]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in rows], names=["kind", "k", "n"])

    return run


@dataclass(frozen=True)
class Strips:
    """Rows in so many strips: ends are the first bucket after each strip, over ranges of n rows or (n: 0) a hash."""

    ends: tuple[int, ...]
    n: int = 0

    def of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.ends), _bucket(at, self.n), "right")


def strips(by_range: np.ndarray, by_hash: np.ndarray, n: int, many: int) -> Strips:
    """Strips of about the same number of cells; ranges, unless one of these has twice its share and those of a hash are more even."""

    def cut_at(count: np.ndarray) -> tuple[tuple[int, ...], int]:
        total = np.cumsum(count)
        ends = np.searchsorted(total, total[-1] * np.arange(1, many + 1) / many, "left") + 1
        ends = np.unique(np.append(ends[:-1], len(count)))
        return tuple(ends.tolist()), int(np.diff(np.concatenate([[0], total[ends - 1]])).max())

    (near, most), (far, least) = cut_at(by_range), cut_at(by_hash)
    return Strips(near, n) if most <= max(least, 2 * by_range.sum() / many) else Strips(far)


def _paired(s: Strips, count: bool = False):
    """Over records: packed rows (tile, side, at, m, v), a cell for each pair of its strip and a strip that has cells at its m; side 0: the lesser strip, and both of a pair of one strip. count: how many cells that sends."""
    many = len(s.ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = 0
        for at, m, v in _opened(batches):
            own, place = s.of(at), np.unique(m, return_inverse=True)[1]
            of, strip = np.divmod(np.unique(place * many + own), many)  # which strips each m has
            low, high = np.searchsorted(of, place, "left"), np.searchsorted(of, place, "right")
            ends = np.cumsum(high - low)
            sent += int(ends[-1])
            x = len(at) if count else 0
            while x < len(at):
                e = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + AT_ONCE, "right")))
                times = (high - low)[x:e]
                cell = np.repeat(np.arange(x, e), times)
                mine, other = own[cell], strip[_ranges(low[x:e], times)]
                tile = (np.minimum(mine, other) * many + np.maximum(mine, other)) * 2 + (mine > other)
                order = np.argsort(tile, kind="stable")
                tile, cell = tile[order], cell[order]
                first = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
                for f, t in zip(first, [*first[1:], len(tile)], strict=True):
                    some = cell[f:t]
                    _, *rest = _cells(at[some], m[some], v[some])
                    yield pa.RecordBatch.from_arrays([pa.array([int(tile[f]) // 2]), pa.array([int(tile[f]) % 2], pa.int32()), *(pa.array([y], pa.binary()) for y in (narrow(at[some]), *rest))], names=["tile", "side", "at", "m", "v"])
                x = e
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([sent])], names=["n"])

    return run


def _pairs(many: int):
    """Over packed rows (tile, side, at, m, v) sorted by tile: cells of both halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])

        def solved() -> Iterator[pa.RecordBatch]:
            same = now is not None and now // many == now % many
            if held[0] and (held[1] or same):
                a = [np.concatenate(x) for x in zip(*held[0], strict=True)]
                i, j, v = multiplied(*a, *(a if same else [np.concatenate(x) for x in zip(*held[1], strict=True)]))
                for i, j in ((i, j),) if same else ((i, j), (j, i)):  # noqa: B020
                    for at in range(0, len(v), PACKED):
                        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + PACKED]) for x in (i, j, v)], names=["i", "j", "v"])

        for batch in batches:
            for tile, side, at, m, v in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if tile != now:
                    yield from solved()
                    now, held = tile, ([], [])
                held[side].append(_read(widened(at, np.int64), m, v))
        yield from solved()

    return run


def _own_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over records: cells of their own products."""
    for at, m, v in _opened(batches):
        out = multiplied(at, m, v, at, m, v)
        for s in range(0, len(out[0]), PACKED):
            yield pa.RecordBatch.from_arrays([pa.array(x[s : s + PACKED]) for x in out], names=["i", "j", "v"])


def opened(records: DataFrame) -> DataFrame:
    """Cells (i, j, v) of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, m, v in _opened(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, m, v)], names=["i", "j", "v"])

    return records.mapInArrow(run, "i long, j long, v double")


def recorded(a: DataFrame) -> DataFrame | None:
    """Real cells (i, j, v), summed and written as records; None where a task would hold too many, as very many cells have one j."""
    with cleaned(a.sparkSession):
        found = a.select("j").mapInArrow(_histogram, "k long, n long").groupBy("k").agg(F.sum("n")).collect()
    n = np.zeros(BUCKETS, np.int64)
    for k, x in found:
        n[k] = x
    slabs, share = BUCKETS, min(CELLS / 2, max(n.sum() / a.sparkSession.sparkContext.defaultParallelism, PACKED))
    while slabs > 1 and n.sum() / (slabs // 2) <= share:
        slabs //= 2
    if n.reshape(-1, slabs).sum(0).max() > 2 * CELLS:
        return None
    cells = a.select(F.col("i").alias("at"), F.col("j").alias("m"), F.col("v").cast("double").alias("v"))
    met = cells.mapInArrow(_slabs(slabs), f"slab int, {_RECORD}").repartition(slabs, "slab").sortWithinPartitions("slab")
    return cut(met.mapInArrow(_records, _RECORD), "records")


def squared(records: DataFrame, n: int, cores: int, sent_most: int) -> DataFrame | None:
    """Cells (i, j, v) of A A.T from records of A, whose rows are n; None where a strip of rows would be too large for a task."""
    counts, products, many = np.zeros((2, BUCKETS), np.int64), 0, 0
    with cleaned(records.sparkSession):
        for kind, k, x in records.mapInArrow(_row_counts(n), "kind long, k long, n long").groupBy("kind", "k").agg(F.sum("n")).collect():
            if kind < 2:
                counts[kind, k] = x
            else:
                products, many = (x, many) if kind == 2 else (products, x)
    stored = int(counts[0].sum())
    tiles = max(1, ceil(products / PRODUCTS), min(cores, ceil(products / 250_000)))
    s = strips(*counts, n, min(n, max(1, ceil(2 * stored / CELLS), ceil(sqrt(2 * tiles) - 0.5)), BUCKETS)) if stored else Strips((BUCKETS,))
    if max(counts[0].sum() if len(s.ends) == 1 else 0, *(c.sum() for c in np.split(counts[0 if s.n else 1], s.ends[:-1]))) > 2 * CELLS:
        return None
    with cleaned(records.sparkSession):
        sent = int(records.mapInArrow(_paired(s, True), "n long").agg(F.sum("n")).first()[0] or 0)
        if sent > sent_most * stored:
            cells = opened(records)
            found = sizes.product_cells(cells, cells.select(F.col("j").alias("i"), F.col("i").alias("j")))
            if min(products, found * many) < sent:  # sums of records are fewer than cells for tiles
                return records.mapInArrow(_own_products, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).filter(V.nonzero("float64", F.col("v")))
    pairs = len(s.ends) * (len(s.ends) + 1) // 2
    parts = min(pairs, max(2 * cores, -(-products // PRODUCTS), -(-2 * sent // CELLS)))
    met = records.mapInArrow(_paired(s), f"tile long, side int, {_RECORD}").repartition(parts, "tile").sortWithinPartitions("tile")
    return met.mapInArrow(_pairs(len(s.ends)), "i long, j long, v double").filter(V.nonzero("float64", F.col("v")))
