"""Token ids as binary shards in training order.

Texts become token ids (a byte-level BPE of a public vocabulary), an end token closes each, and the ids are cut
into sequences of SEQ ids, the last one filled with end tokens. Sequences are numbered in the order of the input's
partitions and rows; a keyed Feistel permutation with cycle-walking sends each number to a global slot, a bijection
on the number of sequences. Slot s is record s mod PER_SHARD of shard s div PER_SHARD: 16-bit little-endian ids
without a header, so that the n-th sequence of the training order is at a known byte of a known file and a run
resumes at any slot. Each shard is one task's: rows come by range partition, sorted, and are written to a file of
another name that is then renamed. A shard that is there already is left as it is: a task that runs again, or a whole
run into the same folder, would write the same bytes. The manifest, written before the shards, holds the layout and the number of
sequences; a folder whose manifest says otherwise is refused, one of the same input is completed. A mark is written last.

A first pass over the texts counts sequences by partition; only those counts reach the driver, and they go back as one
broadcast array. The second pass checks that each partition has as many again. Null and empty texts are a single end
token; a text of any length is one unit, held by one task; null and repeated ids and rows are kept as they are, a row's
place decides between ties; extra columns are ignored; an empty table gives no shard, a manifest and an empty result.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern that belongs to the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
SEQ, PER_SHARD, ROUNDS = 256, 1 << 16, 6
#: Parts that are looked up at most, and bytes of text that are encoded at once: what a worker holds stays small.
MOST, TEXT_BYTES = 200_000, 1 << 18
MANIFEST, COMPLETE = "manifest.json", "complete"


_BLANK = c.byte_class(lambda b: 9 <= b <= 13 or 28 <= b <= 32)


def _wide_blanks(data: np.ndarray) -> np.ndarray:
    """Where the UTF-8 sequence of a white-space character beyond ASCII begins."""
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if not len(lead):
        return lead
    pad = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, d = pad[lead], pad[lead + 1], pad[lead + 2]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    general = (a == 0xE2) & (((b == 0x80) & ((d <= 0x8A) | (d == 0xA8) | (d == 0xA9) | (d == 0xAF))) | ((b == 0x81) & (d == 0x9F)))
    return lead[two | general | (a == 0xE1) & (b == 0x9A) & (d == 0x80) | (a == 0xE3) & (b == 0x80) & (d == 0x80)]


class Tokenizer:
    """Ids of texts. A text in which single spaces stand between other characters is cut before them, where no token
    reaches across. The parts are looked up, a whole batch at a time; parts that aren't there yet are encoded together:
    each begins with a space, no token but a part's first does, and so their ids come apart again. Any other text is
    encoded whole."""

    def __init__(self, ranks: bytes):
        import tiktoken

        pairs = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines())}
        self.own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=pairs, special_tokens={})
        self._spaced = np.zeros(1 << 16, bool)
        self._spaced[[i for token, i in pairs.items() if token[:1] == b" "]] = True
        self._known = c.Lookup(np.uint16, MOST)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.own.encode_ordinary(text), "<u2")

    def _encode(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each part has, and the ids of all; nothing stands before a text's first part."""
        one = lambda i: self._ids(data[starts[i] : starts[i] + size[i]].tobytes().decode())
        counts, rest = np.zeros(len(starts), np.int64), np.flatnonzero(~first)
        ids = self._ids(data[c.ranges(starts[rest], size[rest])].tobytes().decode())
        edges = np.flatnonzero(self._spaced[ids])
        if len(edges) != len(rest):  # never seen; one by one is right in any case
            parts = [one(i) for i in range(len(starts))]
            return np.array([len(x) for x in parts], np.int64), np.concatenate(parts)
        counts[rest] = np.diff(np.append(edges, len(ids)))
        heads = {i: one(i) for i in np.flatnonzero(first).tolist()}
        counts[list(heads)] = [len(x) for x in heads.values()]
        out, at = np.zeros(counts.sum(), np.uint16), np.cumsum(counts) - counts
        out[c.ranges(at[rest], counts[rest])] = ids
        for i, own in heads.items():
            out[at[i] : at[i] + len(own)] = own
        return counts, out

    def batch(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """(ids, bounds, whole): text r has ids[bounds[r]:bounds[r + 1]], or whole[r] if that is there."""
        data, off = c.flat(col)
        n = len(off) - 1
        gaps = np.flatnonzero(data == 0x20)
        starts = np.concatenate([off[:-1], gaps])
        rows = np.concatenate([np.arange(n), np.searchsorted(off, gaps, "right") - 1])
        order = np.argsort(starts, kind="stable")
        # at one place: the empty texts that end there, the text that begins, its space
        starts, rows, first = starts[order], rows[order], order < n
        ends = np.append(starts[1:], off[-1])
        size = ends - starts
        filled = off[1:] > off[:-1]
        odd = np.zeros(n, bool)
        odd[rows[~first & (size == 1)]] = True
        odd[rows[first & (size == 0)]] = True
        inner = np.flatnonzero(~first & (size > 1))
        odd[rows[inner[_BLANK[data[starts[inner] + 1]]]]] = True
        some = np.flatnonzero(size > 0)
        odd[rows[some[_BLANK[data[ends[some] - 1]] & ~((data[ends[some] - 1] == 0x20) & first[some])]]] = True
        odd[np.searchsorted(off, _wide_blanks(data), "right") - 1] = True
        # a text without a space is one part, whatever it ends with; it is encoded whole all the same
        odd &= filled
        use = np.flatnonzero(filled[rows] & ~odd[rows])
        starts, rows, first, size = starts[use], rows[use], first[use], size[use]
        at = self._known.learned(data, starts, size, lambda i: self._encode(data, starts[i], size[i], first[i]))
        if (at < 0).any():  # another part of that hash, or more parts than the table holds: whole texts
            odd[rows[at < 0]] = True
            keep = ~odd[rows]
            rows, at = rows[keep], at[keep]
        counts = self._known.counts(at)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(rows, counts, n).astype(np.int64))])
        return self._known.ids(at), bounds, {int(r): self._ids(data[off[r] : off[r + 1]].tobytes().decode()) for r in np.flatnonzero(odd)}

    def encode_all(self, col: pa.Array) -> Iterator[bytes]:
        """The ids of each text as little-endian 16-bit integers; of null none."""
        ids, bounds, whole = self.batch(col)
        data = ids.astype("<u2").tobytes()
        for r, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
            yield whole[r].tobytes() if r in whole else data[2 * a : 2 * b]

    def counts(self, col: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        _, bounds, whole = self.batch(col)
        out = np.diff(bounds)
        for r, ids in whole.items():
            out[r] = len(ids)
        return out

    def encode(self, text: str) -> bytes:
        return next(self.encode_all(pa.array([text], pa.string())))


@lru_cache(1)
def tokenizer(ranks: bytes) -> Tokenizer:
    return Tokenizer(ranks)


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of range(n), applied to x: Feistel rounds on the next power of four, walked until inside."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> np.uint64(half), v & low
        for r in range(ROUNDS):
            a, b = b, a ^ (c.mix(b + c.mix(np.array([key * 1000 + r + 1], np.uint64))) & low)
        return a << np.uint64(half) | b

    out = once(x.astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def write_shards(docs: DataFrame, folder: str, ranks: bytes, id_col: str = "doc_id", text_col: str = "text", seq: int = SEQ, per_shard: int = PER_SHARD, key: int = 1) -> DataFrame:
    """A row per sequence: slot, shard, byte_at, doc_id, part, n_tokens, digest. folder gets the shards (any file system that pyarrow knows)."""
    from pyspark import TaskContext

    df = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    c.small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer(ranks)
        n = sum(int((tokens.counts(part.column(1)) // seq + 1).sum()) for batch in batches for part in c.pieces(batch, "text", TEXT_BYTES))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], names=["p", "n"])

    counted = df.mapInArrow(count, "p int, n long").toArrow()  # a row a partition
    p, n = (counted.column(k).to_numpy() for k in (0, 1))
    counts = np.zeros(int(p.max(initial=-1)) + 2, np.int64)
    counts[p + 1] = n
    ends = np.cumsum(counts)  # partition p has the numbers from ends[p] to ends[p + 1]
    total = int(ends[-1])
    shards = max(1, -(-total // per_shard))
    layout = {"sequences": total, "ids_each": seq, "per_shard": per_shard, "key": key, "dtype": "<u2", "fill": END}
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    if (was := _manifest(system, root)) not in (None, layout):
        raise ValueError(f"{folder} holds shards of another layout: {was}")
    if was is None:
        with system.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps(layout).encode())
    numbers = docs.sparkSession.sparkContext.broadcast(ends)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer(ranks)
        p, end = TaskContext.get().partitionId(), END.to_bytes(2, "little")
        at, stop = numbers.value[p : p + 2].tolist() if p + 1 < len(numbers.value) else (0, 0)
        for batch in (part for batch in batches for part in c.pieces(batch, "text", TEXT_BYTES)):
            ids = batch.column(0)
            rows: list[int] = []
            parts: list[int] = []
            sizes: list[int] = []
            records: list[bytes] = []

            def out() -> pa.RecordBatch:
                slots = feistel(np.arange(at, at + len(rows)), total, key)
                return pa.RecordBatch.from_arrays(
                    [pa.array((slots // per_shard).astype(np.int32)), pa.array(slots), ids.take(pa.array(rows)), pa.array(parts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(records, pa.binary())],
                    names=["shard", "slot", "doc_id", "part", "n_tokens", "record"],
                )

            for i, s in enumerate(tokens.encode_all(batch.column(1))):
                s += end
                for j in range(0, len(s), 2 * seq):
                    own = s[j : j + 2 * seq]
                    rows.append(i)
                    parts.append(j // (2 * seq))
                    sizes.append(len(own) // 2)
                    records.append(own)
                    if len(rows) == 4000:
                        yield out()
                        at += len(rows)
                        rows, parts, sizes, records = [], [], [], []
            if rows:
                yield out()
                at += len(rows)
        if at != stop:
            raise RuntimeError("the input changed between the two passes")

    placed = df.mapInArrow(place, "shard int, slot long, doc_id long, part int, n_tokens int, record binary")
    placed = placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        system, root = fs.FileSystem.from_uri(folder)
        sink = None
        current, part, due = -1, "", 0

        def done() -> None:
            sink.close()
            target = f"{root}/shard-{current:06d}.bin"
            if system.get_file_info(target).type == fs.FileType.NotFound:
                system.move(part, target)
            else:
                system.delete_file(part)

        fill = END.to_bytes(2, "little")
        for batch in batches:
            shard, slot, records = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(5).to_pylist()
            digests = []
            for k, s, record in zip(shard, slot, records, strict=True):
                if k != current:
                    if sink is not None:
                        done()
                    current, due = k, k * per_shard
                    part = f"{root}/_part-{current:06d}-{uuid.uuid4().hex}"
                    sink = system.open_output_stream(part)
                if s != due:
                    raise RuntimeError(f"slot {s} where {due} is due")
                due += 1
                full = record + fill * (seq - len(record) // 2)
                sink.write(full)
                digests.append(xxhash.xxh64_intdigest(full) - (1 << 63))
            byte_at = pa.array((np.array(slot, np.int64) % per_shard) * 2 * seq)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), byte_at, *(batch.column(i) for i in (2, 3, 4)), pa.array(digests, pa.int64())], names=["slot", "shard", "byte_at", "doc_id", "part", "n_tokens", "digest"])
        if sink is not None:
            done()

    slots = c.cut(placed.mapInArrow(write, "slot long, shard int, byte_at long, doc_id long, part int, n_tokens int, digest long"), "slots")
    system.open_output_stream(f"{root}/{COMPLETE}").close()
    return slots


def _manifest(system: fs.FileSystem, root: str) -> dict | None:
    if system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def read_slots(folder: str, start: int, stop: int, seq: int = SEQ, per_shard: int = PER_SHARD) -> Iterator[np.ndarray]:
    """The sequences of slots start to stop in training order, read sequentially from there on."""
    system, root = fs.FileSystem.from_uri(folder)
    while start < stop:
        shard, at = divmod(start, per_shard)
        n = min(stop - start, per_shard - at)
        with system.open_input_file(f"{root}/shard-{shard:06d}.bin") as f:
            f.seek(at * 2 * seq)
            for _ in range(n):
                yield np.frombuffer(f.read(2 * seq), "<u2")
        start += n
