"""What the corpus operators share: tables, written cuts of the lineage, and byte-level text kernels.

The kernels work on a whole Arrow column at once (one byte buffer and its offsets), so that the cost per
word is a few numpy operations instead of Python calls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import lineage
from ..plans.lineage import release, shared_dir  # noqa: F401

#: Bytes of text that a kernel takes at once; a longer text is taken alone.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds what an Arrow batch holds, for texts of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def cut(df: DataFrame, what: str) -> DataFrame:
    return lineage.cut(df, f"llm-{what}")


def row_cut(df: DataFrame, what: str, key: str = "rid") -> DataFrame:
    """A cut with a number for each row, the same at each later read; doc_id may be null or repeated."""
    return cut(df.withColumn(key, F.monotonically_increasing_id()), what)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, whatever its extra columns are called."""
    taken = {x.lower() for x in df.columns}
    return [next(n for i in range(len(taken) + 1) if (n := f"llm_{name}" + f"_{i}" * (i > 0)) not in taken) for name in names]


# --- Arrow and bytes -----------------------------------------------------------------------------------


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    col = col.fill_null("") if col.null_count else col
    if pa.types.is_large_string(col.type):
        col = col.cast(pa.string())
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about most bytes of text."""
    if not batch.num_rows:
        return
    _, off = flat(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def map_text(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text", most: int = CHUNK_BYTES) -> DataFrame:
    """f over runs of rows of about most bytes of text; it returns a batch in the order of schema."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text, most):
                if (out := f(part)) is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def byte_class(allowed: Callable[[int], bool]) -> np.ndarray:
    return np.array([allowed(b) for b in range(256)])


#: Words [^\x20\x09-\x0D]+, as bytes.
SOLID = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words of letters and digits; every byte of a non-ASCII character counts as a letter.
ALNUM = byte_class(lambda b: b >= 0x80 or chr(b).isalnum())
NOT_NEWLINE = byte_class(lambda b: b != 0x0A)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true, none of them across a row's end."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def line_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the lines that splitting each row at \\n gives; an empty row has one empty line."""
    feeds = np.flatnonzero(data == 0x0A)
    row = np.searchsorted(off, feeds, "right") - 1
    rows = np.concatenate([np.arange(len(off) - 1), row])
    starts = np.concatenate([off[:-1], feeds + 1])
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    ends = np.empty_like(starts)
    ends[:-1] = np.where(rows[1:] == rows[:-1], starts[1:] - 1, off[rows[:-1] + 1])
    if len(ends):
        ends[-1] = off[-1]
    return starts, ends, rows


_BASE = 0x9E3779B97F4A7C15 | 1
#: Primes below 2**31, and a base of a polynomial hash for each.
_FIELDS = ((2147483647, 1540483477), (2147483629, 668265263))
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []
#: Bytes whose terms add up below 2**64: each is at most 256 times a number below 2**31.
_SUMMED = 1 << 24


def _geometric(n: int, base: int, prime: int) -> np.ndarray:
    """The first n powers of base modulo prime."""
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, prime)) % np.uint64(prime)
        k += m
    return out


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each field the first n powers of its base, and of its base's inverse."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(1 << 16, n + n // 8)
        _POWERS[:] = [(_geometric(size, b, p), _geometric(size, pow(b, -1, p), p).astype(np.uint32)) for p, b in _FIELDS]
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads each bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: two polynomials over prime fields, by prefix sums, so the cost is per byte, not per span.

    Unlike a polynomial modulo 2**64, which some pairs of long texts of two letters share at any base, a pair of n bytes
    collides with a chance of about (n / 2**31) ** 2."""
    n = len(data)
    x = data.astype(np.uint64) + np.uint64(1)
    both = np.zeros(len(starts), np.uint64)
    for (p, _), (up, down) in zip(_FIELDS, _powers(n + 1), strict=True):
        prime = np.uint64(p)
        sums = np.zeros(n + 1, np.uint64)
        for at in range(0, n, _SUMMED):
            part = sums[at + 1 : at + _SUMMED + 1]
            np.cumsum(x[at : at + _SUMMED] * up[at : min(n, at + _SUMMED)], out=part)
            if at:
                part += sums[at] % prime
        if n > _SUMMED:
            sums %= prime
        h = (sums[ends] + (prime if n > _SUMMED else np.uint64(0)) - sums[starts]) % prime * down[starts] % prime
        both = (both << np.uint64(31)) | h
    return mix(both ^ mix((ends - starts).astype(np.uint64)))


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit hashes (XXH3) of spans that are few for their bytes, such as lines: a row of two 64-bit words each."""
    buffer, digest = data.tobytes(), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(buffer[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), np.uint64).reshape(-1, 2)


def in_row(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes that are equal where both h and row are."""
    return mix(h + (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


def shingles(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k consecutive words from each place on, and the places (in h) that have k words in their row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s = np.zeros(n, np.uint64)
    for j in range(k):
        s = s * np.uint64(_BASE) + h[j : j + n]
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(s[at]), at


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.zeros(len(s), bool)
    if len(s) > 1:
        eq = s[1:] == s[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    out = np.empty(len(s), bool)
    out[order] = same
    return out


def later(keys: np.ndarray) -> np.ndarray:
    """Whether an equal key stands before each."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    out = np.zeros(len(s), bool)
    if len(s) > 1:
        out[order[1:]] = s[1:] == s[:-1]
    return out


def per_row(n: int, rows: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights, n).astype(np.int64) if weights is None or weights.dtype != float else np.bincount(rows, weights, n)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


# --- tables in memory -------------------------------------------------------------------------------------


class Table:
    """Numbers under 64-bit keys (not 0, spread evenly) by open addressing, for whole arrays of keys at a time."""

    def __init__(self, slots: int = 1 << 16):
        self._keys, self._values, self._used = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), 0

    def __len__(self) -> int:
        return self._used

    def clear(self) -> None:
        """Without keys, but as large as it has become."""
        self._keys[:], self._used = 0, 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number under each key, -1 if it isn't there."""
        out, last = np.full(len(keys), -1, np.int64), len(self._keys) - 1
        left, slot = np.arange(len(keys)), (keys & np.uint64(last)).astype(np.int64)
        while len(left):
            here = self._keys[slot]
            hit = here == keys[left]
            out[left[hit]] = self._values[slot[hit]]
            on = ~hit & (here != 0)
            left, slot = left[on], (slot[on] + 1) & last
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New, distinct keys."""
        while 4 * (self._used + len(keys)) > len(self._keys):
            old, kept = self._keys[self._keys != 0], self._values[self._keys != 0]
            self.__init__(2 * len(self._keys))
            self.add(old, kept)
        self._used += len(keys)
        last = len(self._keys) - 1
        left, slot = np.arange(len(keys)), (keys & np.uint64(last)).astype(np.int64)
        while len(left):
            free = self._keys[slot] == 0
            self._keys[slot[free]] = keys[left[free]]
            own = free & (self._keys[slot] == keys[left])  # of several that want a slot, one has it
            self._values[slot[own]] = values[left[own]]
            left, slot = left[~own], (slot[~own] + 1) & last


#: The lowest 0 to 8 bytes of a word.
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Lookup:
    """Sequences of ids under byte strings: strings meet by a hash, and their bytes are compared.

    A string's first 16 bytes are held as two words, which for most strings are all there is to hash and compare."""

    def __init__(self, kind: np.dtype, most: int):
        self.kind, self.most, self._table = np.dtype(kind), most, Table()
        self._start, self._size, self._at, self._bytes = (np.zeros(1 << 10, np.int32) for _ in range(4))
        self._low, self._high = np.zeros(1 << 10, np.uint64), np.zeros(1 << 10, np.uint64)
        self._ids, self._text = np.zeros(1 << 16, self.kind), np.zeros(1 << 16, np.uint8)
        self.clear()

    def clear(self) -> None:
        self._table.clear()
        self.known = self._n_ids = self._n_text = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(len(a) // 2, n - len(a)), a.dtype)])

    @staticmethod
    def _words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        at = np.ndarray((len(data) + 9,), np.dtype("<u8"), padded.data, strides=(1,))  # the word from each byte on
        return at[starts] & _LOWEST[np.minimum(sizes, 8)], at[starts + 8] & _LOWEST[np.clip(sizes - 8, 0, 8)]

    @staticmethod
    def _hash(low: np.ndarray, high: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        h = mix(low ^ mix(high + sizes.astype(np.uint64) * np.uint64(_BASE)))
        long = np.flatnonzero(sizes > 16)
        h[long] = digests(data, starts[long], starts[long] + sizes[long])[:, 0]
        return np.maximum(h, np.uint64(1))

    def _other(self, at: np.ndarray, low: np.ndarray, high: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether each string is another one than that of its number."""
        out = (self._bytes[at] != sizes) | (self._low[at] != low) | (self._high[at] != high)
        long = np.flatnonzero((sizes > 16) & ~out)
        if len(long):
            rest = sizes[long] - 16
            differ = data[ranges(starts[long] + 16, rest)] != self._text[ranges(self._at[at[long]].astype(np.int64), rest)]
            out[long[np.repeat(np.arange(len(long)), rest)[differ]]] = True
        return out

    def _add(self, h: np.ndarray, low: np.ndarray, high: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        n, k = len(h), self.known
        rest = np.maximum(sizes - 16, 0)
        text = data[ranges(starts + 16, rest)]
        for name, more in (*((x, k + n) for x in ("_start", "_size", "_at", "_bytes", "_low", "_high")), ("_ids", self._n_ids + len(ids)), ("_text", self._n_text + len(text))):
            setattr(self, name, self._room(getattr(self, name), more))
        self._ids[self._n_ids : self._n_ids + len(ids)] = ids
        self._text[self._n_text : self._n_text + len(text)] = text
        own = slice(k, k + n)
        self._start[own], self._size[own] = self._n_ids + np.cumsum(counts) - counts, counts
        self._at[own], self._bytes[own] = self._n_text + np.cumsum(rest) - rest, sizes
        self._low[own], self._high[own] = low, high
        self._table.add(h, np.arange(k, k + n, dtype=np.int32))
        self._n_ids, self._n_text, self.known = self._n_ids + len(ids), self._n_text + len(text), k + n

    def counts(self, at: np.ndarray) -> np.ndarray:
        return self._size[at].astype(np.int64)

    def ids(self, at: np.ndarray) -> np.ndarray:
        return self._ids[ranges(self._start[at].astype(np.int64), self.counts(at))]

    def learned(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, encode: Callable) -> np.ndarray:
        """The number of each string once encode, which gives counts and ids of the strings at some places, has been
        asked for those that weren't there; -2 for strings that cannot be kept: a hash met twice, or too many of them."""
        low, high = self._words(data, starts, sizes)
        h = self._hash(low, high, data, starts, sizes)
        at = self._table.find(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            one = new[np.unique(h[new], return_index=True)[1]]
            if self.known + len(one) > self.most:
                self.clear()
                new = np.arange(len(h))
                one = np.unique(h, return_index=True)[1]
            if len(one) > self.most:
                return np.full(len(h), -2, np.int64)
            self._add(h[one], low[one], high[one], data, starts[one], sizes[one], *encode(one))
            at[new] = self._table.find(h[new])
        at[self._other(at, low, high, data, starts, sizes)] = -2
        return at
