"""Line dedup by overlapping windows of three lines.

The lines of a text that have a word are hashed (trimmed, A-Z lower-cased; 128 bits). Each three in a row are a window,
and so are one or two in a row that hold more than LONG words: a passage may fill no more lines than that. A text with
only one or two such lines is a window too, however short. A window that occurs again, in the same or another text, is
kept where it occurs first, in the order of id, text and position. In every later occurrence its lines are covered;
covered lines that touch are merged to spans, and the spans go, with the blank lines inside them.

Null ids come first in that order and null texts stay null; empty texts and texts without words have no window and stay
as they are; of rows with equal id and text the first in the table's order is first; a text of any length is one unit,
held by one task; texts that tie in id are ordered by the hash of the text; an empty table gives an empty result.
Extra columns pass through, but those named as a result (n_lines, n_removed, removed) give way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

WINDOW = 3
#: Words above which one or two lines are a window.
LONG = 50
RESULTS = ("n_lines", "n_removed", "removed")


def _lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line: start, end, row, and whether it has a word."""
    starts, ends, rows = c.line_spans(data, off)
    solid = np.concatenate([[0], np.cumsum(c.SOLID[data])])
    return starts, ends, rows, solid[ends] > solid[starts]


SCHEMA = "text_hash long, pos int, n int, whole boolean, w1 long, w2 long"


def windows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """(doc_id, text_hash, pos, n, whole, w1, w2) of rows (doc_id, text_hash, text).

    pos counts lines with words, n is the window's lines, the hashes make 128 bits; one window of a text is whole."""
    data, off = c.flat(batch.column(2))
    ws, we = c.runs(c.SOLID[data], off)
    ls, le, lrow, has = _lines(data, off)
    ls, le, lrow = ls[has], le[has], lrow[has]
    if not len(ls):
        return None
    lo, hi = np.searchsorted(ws, ls), np.searchsorted(we, le, "right")
    h = c.digests(c.LOWER[data], ws[lo], we[hi - 1])
    words = np.concatenate([[0], np.cumsum(hi - lo)])
    count, start = np.bincount(lrow, minlength=batch.num_rows), np.searchsorted(lrow, np.arange(batch.num_rows))
    parts: list[tuple[np.ndarray, ...]] = []
    for n in range(1, WINDOW + 1):
        w1, at = c.shingles(h[:, 0], lrow, n)
        w2, _ = c.shingles(h[:, 1], lrow, n)
        keep = np.ones(len(at), bool) if n == WINDOW else (words[at + n] - words[at] > LONG) | (count[lrow[at]] == n)
        at = at[keep]
        row = lrow[at]
        whole = (at == start[row]) & (np.minimum(count[row], WINDOW) == n)
        # the number of lines goes into the key: a hash of one line is no hash of two
        parts.append((row, at - start[row], np.full(len(at), n), whole, *(c.mix(w[keep] + np.uint64(n)).view(np.int64) for w in (w1, w2))))
    row, pos, n, whole, w1, w2 = (np.concatenate(x) for x in zip(*parts, strict=True))
    take = pa.array(row)
    columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(whole), pa.array(w1), pa.array(w2)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))])


def strip(text: str, covered: list[int]) -> tuple[str, list[tuple[int, int]], int]:
    """The text without its covered lines, the spans of lines that went, and the number of lines."""
    lines = text.split("\n")
    solid = [i for i, line in enumerate(lines) if any(ch not in " \t\n\x0b\x0c\r" for ch in line)]
    spans: list[tuple[int, int]] = []
    before = None
    for k in sorted(k for k in covered if k < len(solid)):
        if before is not None and k == before + 1:
            spans[-1] = (spans[-1][0], solid[k] + 1)
        else:
            spans.append((solid[k], solid[k] + 1))
        before = k
    left, at = [], 0
    for a, b in spans:
        left += lines[at:a]
        at = b
    return "\n".join(left + lines[at:]), spans, len(lines)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with their text cleaned, and n_lines, n_removed and removed (spans of line numbers)."""
    from pyspark.sql import types as T

    docs = docs.drop(*RESULTS)
    key, hashed, cover, k1, k2 = c.fresh(docs, "id", "hash", "covered", "k1", "k2")
    kind = docs.schema[id_col].dataType.simpleString()

    def cut_windows(rows: DataFrame) -> DataFrame:
        return c.cut(c.map_text(rows.select(F.col(key).alias("doc_id"), F.col(hashed).alias("text_hash"), F.col(f"`{text_col}`").alias("text")), windows, f"doc_id {kind}, {SCHEMA}"), "windows")

    rows = docs.withColumns({key: F.col(f"`{id_col}`"), hashed: F.xxhash64(F.col(f"`{text_col}`"))})
    found = cut_windows(rows)
    if not found.filter("whole").groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        # rows of equal id and text: each needs a number of its own, which only a written table fixes
        c.release(found)
        rows = c.row_cut(docs.withColumn(key, F.col(f"`{id_col}`")), "rows", hashed)
        found = cut_windows(rows)
    place = F.struct("doc_id", "text_hash", "pos")
    many = c.cut(found.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("w1", "w2", "first"), "repeated")
    later = found.join(many, ["w1", "w2"]).filter(place != F.col("first"))
    covered = later.groupBy("doc_id", "text_hash").agg(F.collect_set(F.col("pos") * (WINDOW + 1) + F.col("n")).alias("pos")).select(F.col("doc_id").alias(k1), F.col("text_hash").alias(k2), F.col("pos").alias(cover))
    met = rows.join(covered, F.col(key).eqNullSafe(F.col(k1)) & (F.col(hashed) == F.col(k2)), "left").drop(k1, k2, key, hashed)
    at_text, at_cover = met.columns.index(text_col), met.columns.index(cover)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, counts, gone, spans = batch.column(at_text).to_pylist(), [], [], []
        for i, (text, pos) in enumerate(zip(texts, batch.column(at_cover).to_pylist(), strict=True)):
            if pos:
                texts[i], found, n = strip(text, list({p // (WINDOW + 1) + j for p in pos for j in range(p % (WINDOW + 1))}))
            else:
                found, n = [], text.count("\n") + 1 if text is not None else 0
            counts.append(n)
            gone.append(sum(b - a for a, b in found))
            spans.append([{"start": a, "end": b} for a, b in found])
        columns = [batch.column(i) for i in range(batch.num_columns)]
        columns[at_text] = pa.array(texts, pa.string())
        columns[at_cover : at_cover + 1] = [pa.array(counts, pa.int32()), pa.array(gone, pa.int32()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
        return pa.RecordBatch.from_arrays(columns, names=[f.name for f in out])

    out = [f for f in met.schema if f.name != cover]
    more = [T.StructField(n, t) for n, t in zip(RESULTS, (T.IntegerType(), T.IntegerType(), T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))), strict=True)]
    out += more
    return c.map_text(met, run, T.StructType(out), text_col)
