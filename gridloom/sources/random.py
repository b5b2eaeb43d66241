"""Random sparse matrices with an exact number of distinct cells.

Cell number r of the matrix is where a keyed permutation of all places sends r, so places are distinct without any
shuffle or check; values are a hash of the cell number."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators.matrix import COOArray, SparseMatrix, check_format

_ROUNDS = 6
#: Cells that are made, or whose numbers are read, at once.
CHUNK = 1 << 16


def _scramble(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64((key * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


def permuted(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where a permutation of range(n) sends x: a Feistel network, walked on while it leads outside."""
    bits = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << bits) - 1)

    def step(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(bits), v & mask
        for r in range(_ROUNDS):
            left, right = right, left ^ (_scramble(right, seed * _ROUNDS + r) & mask)
        return left << np.uint64(bits) | right

    out = step(x.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = step(out[far])
    return out


def numbers(at: np.ndarray, n: int, seed: int) -> np.ndarray:
    """What permuted sends to these places: its inverse, so equal numbers are equal places."""
    bits = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << bits) - 1)

    def back(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(bits), v & mask
        for r in reversed(range(_ROUNDS)):
            left, right = right ^ (_scramble(left, seed * _ROUNDS + r) & mask), left
        return left << np.uint64(bits) | right

    out = back(at.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = back(out[far])
    return out


def runs(a: SparseMatrix, seed: int) -> DataFrame:
    """Cells of a real matrix of this seed by runs of rising numbers: (first, last, n, distinct, least, most, i, j), few rows a task.

    The numbers are made again from the cells' places. Where no two runs overlap, distinct places are the sum of distinct,
    and no place has to be shuffled."""
    width, places = np.uint64(a.n_cols), a.n_rows * a.n_cols
    names = ["first", "last", "n", "distinct", "least", "most", "i", "j"]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        held, size = [], 0
        for batch in batches:
            held.append([batch.column(k).to_numpy() for k in range(3)])
            size += batch.num_rows
            if size >= CHUNK:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held, size = [], 0
        if size:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for i, j, v in chunks(batches):
            number = np.sort(numbers(i.astype(np.uint64) * width + j.astype(np.uint64), places, seed))
            got = [int(number[0]), int(number[-1]), len(v), 1 + int(np.count_nonzero(np.diff(number))), float(v.min()), float(v.max()), int(i.max()), int(j.max())]
            if now is not None and now[1] < got[0]:
                now = [now[0], got[1], now[2] + got[2], now[3] + got[3], min(now[4], got[4]), *(max(x, y) for x, y in zip(now[5:], got[5:], strict=True))]
                continue
            if now is not None:
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in now], names=names)
            now = got
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in now], names=names)

    return a.df.select("i", "j", "v").mapInArrow(run, "first long, last long, n long, distinct long, least double, most double, i long, j long")


#: Whole numbers that an index type holds, and the bits of a value type's fraction.
INDEX = {"int32": 2**31 - 1, "int64": 2**63 - 1}
FRACTION = {"float64": 53, "float32": 24, "float16": 11, "bfloat16": 8, "complex64": 24}


def _seed(rng: object, random_state: object) -> int:
    if rng is not None and random_state is not None:
        raise ValueError("rng and random_state are two names of one thing; give one of them")
    seed = rng if rng is not None else 0 if random_state is None else random_state
    if isinstance(seed, bool) or not isinstance(seed, (int, np.integer)):
        raise TypeError(f"the seed must be a whole number, got {type(seed).__name__}: cells are made on the executors, not by a generator of the driver")
    return int(seed) & 0x7FFFFFFF


def random_array(
    spark: SparkSession,
    shape: tuple[int, int],
    *,
    density: float = 0.01,
    format: str = "coo",
    dtype: str | None = None,
    rng: int | None = None,
    random_state: int | None = None,
    index_dtype: str = "int64",
    data_sampler: Callable[[int], np.ndarray] | None = None,
    canonical: bool = True,
) -> SparseMatrix:
    """round(m * n * density) cells (ties to even) at distinct places; values uniform in [0, 1), rounded to the value type
    (both parts of a complex one), or by data_sampler(size), which is called once for all cells, so its result must fit
    the driver. rng and random_state are two names of the seed; index_dtype bounds dimensions and the number of cells."""
    if len(shape) != 2 or any(isinstance(x, bool) or not isinstance(x, (int, np.integer)) for x in shape):
        raise TypeError(f"shape must be two whole numbers, got {shape!r}")
    m, n = (int(x) for x in shape)
    check_format(format)
    kind = dtype or "float64"
    if kind not in FRACTION:
        raise TypeError(f"unknown value type {dtype!r}")
    if index_dtype not in INDEX:
        raise TypeError("index_dtype must be 'int32' or 'int64'")
    if m < 0 or n < 0:
        raise ValueError("dimensions must not be negative")
    if not (isinstance(density, (int, float, np.floating)) and 0 <= density <= 1):
        raise ValueError("density must be between 0 and 1")
    if not canonical:
        raise ValueError("only canonical matrices are made")
    count = int(min(max(round(m * n * density), 0), m * n))
    if max(m, n, count) > INDEX[index_dtype] or m * n >= 2**62:
        raise OverflowError(f"{count} cells of a {m} by {n} matrix are too many for {index_dtype} places")
    places, seed, grain = m * n, _seed(rng, random_state), float(2 ** FRACTION[kind])

    def uniform(r: np.ndarray, key: int) -> np.ndarray:
        return np.floor((_scramble(r.astype(np.uint64), key) >> np.uint64(11)) * 2.0**-53 * grain) / grain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                r = np.arange(chunk * CHUNK, min(count, (chunk + 1) * CHUNK))
                at = permuted(r, places, seed)
                out = [(at // np.uint64(n)).astype(np.int64), (at % np.uint64(n)).astype(np.int64), uniform(r, seed ^ 0x55555555)]
                out += [uniform(r, seed ^ 0x33333333)] if "im" in names else []
                out += [r] if "r" in names else []
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)

    names = ["i", "j", "v", *(["im"] if kind == V.COMPLEX else []), *(["r"] if data_sampler is not None else [])]
    kinds = {"i": "long", "j": "long", "v": "double", "im": "double", "r": "long"}
    df = spark.range(-(-count // CHUNK)).mapInArrow(run, ", ".join(f"{x} {kinds[x]}" for x in names))
    if data_sampler is not None:
        values = np.asarray(data_sampler(count))
        if values.shape != (count,):
            raise ValueError(f"data_sampler must return {count} values")
        import pandas as pd

        own = spark.createDataFrame(pd.DataFrame({"r": np.arange(count), "v": values.real.astype(float), "im": values.imag.astype(float)}), "r long, v double, im double")
        df = df.select("i", "j", "r").join(own, "r")
    value = F.struct(F.col("v").alias("re"), F.col("im").alias("im")) if kind == V.COMPLEX else F.col("v")
    return COOArray(df.select("i", "j", value.alias("v")), (m, n), dtype=kind, canonical=True, stored=count).asformat(format)


def random(spark: SparkSession, m: int, n: int, density: float = 0.01, format: str = "coo", *, dtype: str | None = None, rng: int | None = None, random_state: int | None = None, data_rvs: Callable[[int], np.ndarray] | None = None) -> SparseMatrix:
    return random_array(spark, (m, n), density=density, format=format, dtype=dtype, rng=rng, random_state=random_state, data_sampler=data_rvs)


def rand(spark: SparkSession, m: int, n: int, density: float = 0.01, format: str = "coo", *, dtype: str | None = None, rng: int | None = None, random_state: int | None = None) -> SparseMatrix:
    return random_array(spark, (m, n), density=density, format=format, dtype=dtype, rng=rng, random_state=random_state)
