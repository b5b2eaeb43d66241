"""Quality rules with cross-document line frequency.

Per text: word and symbol counts, duplicate lines, repeated 3-word windows. Across documents: lines are trimmed, A-Z
lower-cased and hashed (64 bits of XXH3; a line is only ever compared with the frequent lines of its host), and for each
host and line the documents that hold it are counted, copies of a document too. A line that stands in more documents
than the limit is boilerplate; the limit is a share of the host's documents, and never below min_docs, so that it means
the same at every size of host and corpus. Boilerplate lines are removed; a text that loses more than max_lost of its
words to them is depleted and rejected.

Null texts count as empty; empty texts and texts without words fail the base; a null host is a host of its own; every row
is a document, whatever its id (null and repeated ids stay separate rows); a text of any length is one unit, held by one
task; extra columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

SYMBOLS = c.byte_class(lambda b: chr(b) in "#*$%&|<>")
#: Salts of a (host, line) key when lines meet their frequencies, so that no line's rows stand in one task.
SALTS = 16
SCHEMA = (
    "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, lines array<long>, line_words array<int>, text string"
)


def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, off = c.flat(batch.column(2))
    rows = batch.num_rows
    ws, we = c.runs(c.SOLID[data], off)
    wrow = np.searchsorted(off, ws, "right") - 1
    n_words = c.per_row(rows, wrow)
    brow_sum = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[off])
    word_chars = brow_sum(c.SOLID[data] & ((data & 0xC0) != 0x80))
    n_symbols = brow_sum(SYMBOLS[data])

    ls, le, lrow = c.line_spans(data, off)
    lo, hi = np.searchsorted(ws, ls), np.searchsorted(ws, le)
    with_word = hi > lo
    raw = c.digests(data, ls[with_word], le[with_word])[:, 0]
    wl_row = lrow[with_word]
    dup = c.later(c.in_row(raw, wl_row))
    n_dup = c.per_row(rows, wl_row[dup])

    hashes = c.span_hashes(data, ws, we)
    sh, at = c.shingles(hashes, wrow, 3)
    twice = at[c.repeated(c.in_row(sh, wrow[at]))]
    covered = np.zeros(len(ws), bool)
    for j in range(3):
        covered[twice + j] = True
    n_repeat = c.per_row(rows, wrow[covered])

    # each distinct line of a document once, with the words of all its occurrences
    first, last, counts = ws[lo[with_word]], we[hi[with_word] - 1], (hi - lo)[with_word]
    norm = c.digests(c.LOWER[data], first, last)[:, 0]
    order = np.lexsort((norm, wl_row))
    new = np.ones(len(order), bool)
    new[1:] = (norm[order[1:]] != norm[order[:-1]]) | (wl_row[order[1:]] != wl_row[order[:-1]])
    one = order[new]
    words = np.add.reduceat(counts[order], np.flatnonzero(new)) if len(one) else counts[:0]
    offsets = pa.array(np.searchsorted(wl_row[one], np.arange(rows + 1)), pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0).cast(pa.int64()), batch.column(1), pa.array(n_words), pa.array(word_chars.astype(np.int64)),
            pa.array(n_symbols.astype(np.int64)), pa.array(n_dup), pa.array(n_repeat),
            pa.ListArray.from_arrays(offsets, pa.array(norm[one].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(words.astype(np.int32))), batch.column(2),
        ],
        names=[x.split()[0] for x in SCHEMA.split(", ")],
    )


REMOVAL = "struct<text: string, removed: array<struct<start: int, end: int>>>"


def removal(text: pa.Array, frequent: pa.Array) -> pa.Array:
    """Each text without the lines whose hashes are in its list, and their spans in bytes of the text as it was."""
    data, off = c.flat(text)
    ws, we = c.runs(c.SOLID[data], off)
    ls, le, lrow = c.line_spans(data, off)
    lo, hi = np.searchsorted(ws, ls), np.searchsorted(ws, le)
    solid = np.flatnonzero(hi > lo)
    norm = c.digests(c.LOWER[data], ws[lo[solid]], we[hi[solid] - 1])[:, 0]
    lists = [x or [] for x in frequent.to_pylist()]
    own = np.array([h for x in lists for h in x], np.int64).view(np.uint64)
    gone = np.zeros(len(ls), bool)
    gone[solid] = np.isin(c.in_row(norm, lrow[solid]), c.in_row(own, np.repeat(np.arange(len(lists)), [len(x) for x in lists])))
    edges = np.searchsorted(lrow, np.arange(len(text) + 1))
    out = []
    for i, was in enumerate(text.to_pylist()):
        at = np.arange(edges[i], edges[i + 1])
        out_of = at[gone[at]]
        left = was if was is None or not len(out_of) else b"\n".join(data[ls[j] : le[j]].tobytes() for j in at[~gone[at]]).decode()
        out.append({"text": left, "removed": [{"start": int(ls[j] - off[i]), "end": int(le[j] - off[i])} for j in out_of]})
    return pa.array(out, pa.struct([("text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", max_share: float = 0.005, min_docs: int = 3, max_lost: float = 0.5) -> DataFrame:
    """A row per text: the measures, boilerplate_words, base_failed, kept, the text without boilerplate lines, and their spans (removed)."""
    df = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{host_col}`").cast("string").alias("host"), F.col(f"`{text_col}`").alias("text"))
    base = c.row_cut(c.map_text(df, measure, SCHEMA), "rules")
    lines = base.select("rid", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("rid", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    # a document has a line once, so rows are documents; counts combine before they shuffle
    counts = lines.groupBy("host", "line").count().filter(F.col("count") > min_docs).alias("n")
    hosts = base.groupBy("host").agg(F.count("*").alias("docs")).alias("h")
    frequent = (
        counts.join(hosts, F.col("n.host").eqNullSafe(F.col("h.host"))).filter(F.col("count") > max_share * F.col("docs"))
        .select("n.host", "line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    frequent = c.cut(frequent, "lines")
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int")).alias("a")
    b = frequent.alias("b")
    lost = (
        salted.join(b, F.col("a.host").eqNullSafe(F.col("b.host")) & (F.col("a.line") == F.col("b.line")) & (F.col("a.salt") == F.col("b.salt")))
        .groupBy("rid").agg(F.sum("words").alias("lost"), F.collect_list("a.line").alias("frequent"))
    )
    out = base.drop("lines", "line_words").join(lost, "rid", "left").withColumn("boilerplate_words", F.coalesce("lost", F.lit(0)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))

    @F.arrow_udf(REMOVAL)
    def without(text: pa.Array, frequent: pa.Array) -> pa.Array:
        return removal(text, frequent)

    out = out.withColumn("left", without("text", "frequent"))
    return out.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "boilerplate_words",
        failed.alias("base_failed"), (~failed & (F.col("boilerplate_words") <= max_lost * F.col("n_words"))).alias("kept"),
        F.col("left.text").alias("text"), F.col("left.removed").alias("removed"),
    )
