"""Alignment of two tokenizers' tokens, and how often each pair of ids is aligned.

Both tokenizers cut the same bytes (a space and the text). Tokens of A and B are the two sides of a graph whose edges
are overlaps; its connected components, found by union-find, are exactly the groups between two byte offsets where
tokens of both end. A union hooks a token to the first token of A that the other side's token at its start overlaps,
which is never later than itself, so roots are the first tokens of groups; finds halve all paths of a batch at once.
Inside a component every token of A is linked with every token of B; large components are first summed by ids, so that
their links are expanded by distinct ids only, a bounded number at a time.

Pairs are counted over the corpus by chunk: a task sums the documents of at most CHUNK bytes of text and emits each pair
that stands there once, with the documents that hold it. These rows, fewer than the links by far, are summed by pair,
meet the sums again in a join that Spark can split (a pair of frequent words stands in every chunk), and go back to their
chunk, where the documents' links look up their counts. The rows are as many as distinct pairs of chunks: linear in the
input, whatever its size; no machine holds all pairs.

A null or empty text, and one whose joined tokens of A or B are other bytes than the space and the text (a normaliser
has changed it), has no tokens: its numbers are 0 and its digest is empty. A text of any length is one unit, held by one
task; ties for the highest count all count; null and repeated ids and rows are rows like all others, and each counts as
a document; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .sentencepiece_fst import read_model, same_rows
from .token_shards import PATTERN

BYTE_LEVEL, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text that are encoded at once, and whose links are summed before they leave a task.
TEXT_BYTES, CHUNK = 1 << 18, 12 << 20
#: Links that are expanded at once, and tokens on one side from which a component is summed by ids first.
LINKS, LARGE = 1 << 20, 8


# --- the tokenizers ----------------------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE tokenizer read from its JSON file; strings of special tokens are plain text."""

    def __init__(self, model: bytes):
        import tiktoken

        spec = json.loads(model)
        letters = byte_letters()
        special = {x["content"] for x in spec["added_tokens"]}
        ids = {bytes(letters[ch] for ch in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        made = [spec["model"]["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        plain = spec["normalizer"] is None and spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"]
        if not plain or sorted(made) != made or len(ids) != len(made) + 256:
            raise ValueError("not a byte-level BPE vocabulary whose ids are in the order of its merges")
        self.own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={})
        self.tokens = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.tokens[i] = token

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [self.own.encode_to_numpy(f" {t}") if t else np.zeros(0, np.uint32) for t in texts]


class Pieces:
    """A SentencePiece tokenizer, which puts the space before a text itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_proto=model)
        one = lambda i: bytes([int(self.own.id_to_piece(i)[3:5], 16)]) if self.own.is_byte(i) else self.own.id_to_piece(i).replace("▁", " ").encode()
        self.tokens = [one(i) for i in range(self.own.get_piece_size())]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.own.encode(texts, num_threads=1)


class _Strings:
    """Byte strings under numbers, for whole arrays of numbers."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(x) for x in strings], np.int64)
        self._start = np.cumsum(self.size) - self.size
        self._data = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self._data[c.ranges(self._start[ids], self.size[ids])]


# --- components and links ------------------------------------------------------------------------------


def components(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component numbers, from 0 in order, of the tokens of A and of B, whose ends cut the same bytes."""
    a_start, b_start = np.append(0, a_end[:-1]), np.append(0, b_end[:-1])
    first = np.searchsorted(a_end, b_start, "right")  # the first token of A that each token of B overlaps
    root = first[np.searchsorted(b_end, a_start, "right")]  # a union: by way of the token of B at its start
    while ((above := root[root]) != root).any():
        root = above
    number = np.cumsum(root == np.arange(len(root))) - 1
    return number[root], number[root[first]] if len(root) else first


def _by_ids(ids: np.ndarray, group: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, groups, occurrences), in the order of groups; in large groups equal ids are one."""
    if not large.any():
        return ids, group, np.ones(len(ids), np.int64)
    some = large[group]
    key, n = np.unique(group[some] << 32 | ids[some], return_counts=True)
    ids, group, n = np.concatenate([ids[~some], key & 0xFFFFFFFF]), np.concatenate([group[~some], key >> 32]), np.concatenate([np.ones((~some).sum(), np.int64), n])
    order = np.argsort(group, kind="stable")
    return ids[order], group[order], n[order]


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, n
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(n, at)


def links(a: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_group: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pair, links) of each distinct pair of a row, a pair being A's id times 2**32 plus B's; row is that of each group."""
    n = len(row)
    large = np.maximum(np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)) > LARGE
    a, a_group, a_n = _by_ids(a, a_group, large)
    b, b_group, b_n = _by_ids(b, b_group, large)
    b_size = np.bincount(b_group, minlength=n)
    b_first = np.cumsum(b_size) - b_size
    found, each = [], b_size[a_group]
    ends = np.cumsum(each)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LINKS, "right")))
        mine = np.repeat(np.arange(at, to), each[at:to])
        other = c.ranges(b_first[a_group[at:to]], each[at:to])
        # 17 and 16 bits of ids leave 31 for the row
        found.append(_summed(row[a_group[mine]] << 33 | a[mine] << 16 | b[other], a_n[mine] * b_n[other]))
        at = to
    keys, count = _summed(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return keys >> 33, (keys >> 16 & 0x1FFFF) << 32 | keys & 0xFFFF, count


class Aligner:
    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteLevel(a), Pieces(b)
        if len(self.a.tokens) > 1 << 17 or len(self.b.tokens) > 1 << 16:
            raise ValueError("vocabularies of more ids than a pair's bits hold")
        self.a_bytes, self.b_bytes = _Strings(self.a.tokens), _Strings(self.b.tokens)
        self.digits = _Strings([str(i).encode() for i in range(max(len(self.a.tokens), len(self.b.tokens)))])

    def _tokens(self, lists: list, own: _Strings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, bounds by row, byte bounds by row)."""
        count = np.array([len(x) for x in lists], np.int64)
        ids = np.concatenate([*lists, np.zeros(0, np.uint32)]).astype(np.int64) if lists and isinstance(lists[0], np.ndarray) else np.fromiter(chain.from_iterable(lists), np.int64, count.sum())
        bounds = np.concatenate([[0], np.cumsum(count)])
        return ids, bounds, np.concatenate([[0], np.cumsum(own.size[ids])])[bounds]

    def batch(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text n_a, n_b, n_groups and n_links, and the digest; and the links of all texts."""
        texts = [t or "" for t in texts]
        n = len(texts)
        said = [b" " + t.encode() if t else b"" for t in texts]
        off = np.concatenate([[0], np.cumsum([len(x) for x in said])])
        data = np.frombuffer(b"".join(said), np.uint8)
        a, a_off, a_at = self._tokens(self.a(texts), self.a_bytes)
        b, b_off, b_at = self._tokens(self.b(texts), self.b_bytes)
        good = same_rows(self.a_bytes.joined(a), a_at, data, off) & same_rows(self.b_bytes.joined(b), b_at, data, off) & (np.diff(off) > 0)
        n_a, n_b = np.where(good, np.diff(a_off), 0), np.where(good, np.diff(b_off), 0)
        a_row, b_row = np.repeat(np.arange(n), np.diff(a_off)), np.repeat(np.arange(n), np.diff(b_off))
        a, a_row, b, b_row = a[good[a_row]], a_row[good[a_row]], b[good[b_row]], b_row[good[b_row]]
        a_group, b_group = components(np.cumsum(self.a_bytes.size[a]), np.cumsum(self.b_bytes.size[b]))
        size_a, size_b = np.bincount(a_group), np.bincount(b_group)
        row = a_row[np.cumsum(size_a) - size_a] if len(a) else a_row
        n_groups = np.bincount(row, minlength=n)
        n_links = np.zeros(n, np.int64)
        np.add.at(n_links, row, size_a * size_b)
        return [n_a, n_b, n_groups, n_links], self._written(a, a_group, size_a, b, b_group, size_b, n_a + n_b), links(a, a_group, b, b_group, row)

    def _written(self, a: np.ndarray, a_group: np.ndarray, size_a: np.ndarray, b: np.ndarray, b_group: np.ndarray, size_b: np.ndarray, tokens: np.ndarray) -> list[str]:
        """The digest of each row's groups as text: a group's tokens of A, then those of B, each followed by its separator."""
        ids, mark = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        before_b, upto_a = np.cumsum(size_b) - size_b, np.cumsum(size_a)
        ids[np.arange(len(a)) + before_b[a_group]] = a
        ids[np.arange(len(b)) + upto_a[b_group]] = b
        mark[upto_a + before_b - 1] = ord("|")
        mark[upto_a + before_b + size_b - 1] = ord(";")
        size = self.digits.size[ids] + 1
        ends = np.cumsum(size)
        text = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
        text[c.ranges(ends - size, size - 1)] = self.digits.joined(ids)
        text[ends - 1] = mark
        buffer, bounds = text.tobytes(), np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(tokens)])].tolist()
        return [hashlib.sha256(buffer[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(bounds, bounds[1:], strict=False)]


@lru_cache(1)
def compiled(a: bytes, b: bytes) -> Aligner:
    return Aligner(a, b)


# --- over the corpus -----------------------------------------------------------------------------------

_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
_SCHEMA = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair array<long>, place array<int>, n array<long>"


class _Chunk:
    """Documents of one chunk: their numbers, and their links until they are summed."""

    def __init__(self, number: int):
        self.number, self.bytes, self.rows = number, 0, 0
        self.docs: list[pa.Table] = []
        self.held: list[tuple[np.ndarray, ...]] = []

    def add(self, ids: pa.Array, numbers: list[np.ndarray], digests: list[str], found: tuple[np.ndarray, ...], size: int) -> None:
        row, pair, n = found
        self.docs.append(pa.table([ids, *(pa.array(x.astype(np.int64)) for x in numbers), pa.array(digests, pa.string())], names=["doc_id", *_NUMBERS, "groups_sha256"]))
        # a pair's bits, and where each row's end, are all that is held
        self.held.append((np.bincount(row, minlength=len(ids)), pair, np.minimum(n, 0x7FFFFFFF).astype(np.int32) if n.max(initial=0) < 0x7FFFFFFF else n))
        self.rows += len(ids)
        self.bytes += size

    def batches(self) -> Iterator[pa.RecordBatch]:
        """A row with the chunk's distinct pairs and their documents, and one for each document with its links, as places among these."""
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        pairs, place, docs = np.unique(np.concatenate([x[1] for x in self.held]), return_inverse=True, return_counts=True)
        n, size = np.concatenate([x[2] for x in self.held]), np.concatenate([x[0] for x in self.held])
        self.held = []
        none = pa.nulls(1, pa.int64())
        lists = lambda off, x, kind=np.int64: pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(x.astype(kind)))
        for at in range(0, len(pairs), 1 << 16):
            some = slice(at, at + (1 << 16))
            off = [0, len(pairs[some])]
            yield pa.RecordBatch.from_arrays([pa.array([self.number]), none, none, none, none, none, pa.nulls(1, pa.string()), lists(off, pairs[some]), pa.nulls(1, pa.list_(pa.int32())), lists(off, docs[some])], names=names)
        table = pa.concat_tables(self.docs).combine_chunks()
        bounds = np.concatenate([[0], np.cumsum(size)])
        for at in range(0, self.rows, 64):
            to = min(self.rows, at + 64)
            off = bounds[at : to + 1] - bounds[at]
            own = table.slice(at, to - at).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(to - at, self.number)), *own.columns, pa.nulls(to - at, pa.list_(pa.int64())), lists(off, place[bounds[at] : bounds[to]], np.int32), lists(off, n[bounds[at] : bounds[to]])], names=names)


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk, a chunk's counts (kind 0) by pair before its documents: the documents with the sums of their links' counts."""
    chunk, counts, held = None, np.zeros(0, np.int64), []
    for batch in batches:
        numbers, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], (numbers[1:] != numbers[:-1]) | (kind[1:] != kind[:-1])]))
        for s, e in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows], strict=True):
            if numbers[s] != chunk:
                chunk, held, counts = numbers[s], [], np.zeros(0, np.int64)
            part = batch.slice(s, e - s)
            if kind[s] == 0:
                held.append(part.column(3).to_numpy())
                continue
            if held:
                counts, held = np.concatenate([counts, *held]), []
            place, n = part.column(9), part.column(10)
            off = place.offsets.to_numpy().astype(np.int64)
            at, times = place.values.to_numpy()[off[0] : off[-1]], n.values.to_numpy()[n.offsets[0].as_py() : n.offsets[-1].as_py()]
            row = np.repeat(np.arange(e - s), np.diff(off))
            best, total = np.zeros(e - s, np.int64), np.zeros(e - s, np.int64)
            np.add.at(best, row, times * (counts[at] < 0))  # counts that are the highest of their id come negative
            np.add.at(total, row, times * np.abs(counts[at]))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4, 9)), pa.array(best), pa.array(total), part.column(11)], names=["doc_id", *_NUMBERS, "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, a: bytes, b: bytes, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(chunk, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pair, place, n): rows of chunks, with their pairs and the
    documents that hold each, and rows of documents, with the places of their pairs among the chunk's and the links of each."""
    c.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first = compiled(a, b), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        now = _Chunk(first)
        for batch in batches:
            for part in c.pieces(batch, "text", TEXT_BYTES):
                size = part.column(1).nbytes
                if now.rows and now.bytes + size > chunk:
                    yield from now.batches()
                    now = _Chunk(now.number + 1)
                now.add(part.column(0), *own.batch(part.column(1).to_pylist()), size)
        if now.rows:
            yield from now.batches()

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, _SCHEMA)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best) over all documents: how many hold the pair linked, and whether that is the most of its id of A."""
    cells = aligned.filter("n_a is null").select(F.explode(F.arrays_zip("pair", "n")).alias("x")).select("x.pair", "x.n")
    counts = c.cut(cells.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", F.shiftright("pair", 32)).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, a: bytes, b: bytes, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """A row per document: its tokens, groups and links, how many links are the best of their id of A, and the sum of their counts."""
    aligned = c.cut(align(docs, a, b, id_col, text_col, chunk), "aligned")
    counts = pair_counts(aligned)
    cells = aligned.filter("n_a is null").select("chunk", F.explode("pair").alias("pair"))
    signed = F.when(F.col("best"), -F.col("n")).otherwise(F.col("n"))
    blank = [F.lit(None).cast(t).alias(x) for x, t in (*((x, "long") for x in ("doc_id", *_NUMBERS)), ("place", "array<int>"), ("n", "array<long>"), ("groups_sha256", "string"))]
    back = cells.join(counts, "pair").select("chunk", F.lit(0).alias("kind"), "pair", signed.alias("count"), *blank)
    none = F.lit(None).cast("long")
    own = aligned.filter("n_a is not null").select("chunk", F.lit(1).alias("kind"), none, none, "doc_id", *_NUMBERS, "place", "n", "groups_sha256")
    met = back.union(own).repartition("chunk").sortWithinPartitions("chunk", "kind", "pair")
    return met.mapInArrow(_looked_up, f"doc_id long, {', '.join(f'{x} long' for x in _NUMBERS)}, n_best long, count_sum long, groups_sha256 string")
