"""The prefix trie of conversations, with each node owned by its smallest member.

A conversation is a sequence of turns (role, text). A node of depth d is a distinct sequence of first d turns; its
members are the conversations that start with it; the root has depth 0. A prefix is known by the exclusive or of two
64-bit hashes of its turns, each with its depth, so a prefix costs one running aggregate and no text is ever compared
or shuffled.

Members of a node are members of its parent, so a conversation that is the smallest member of a node is the smallest
member of all nodes further down its path: it owns a suffix of that. The smallest member of each prefix therefore says
for each conversation from which depth on it owns (a group-by with partial minima: a window over the members of a
prefix would put all conversations in the root's task). Each node of a subtree has one owner, and that one is a member
of the subtree's top. So what a node saves, the sum over its subtree of (members - 1) times bytes, is the sum over its
members of all their bytes from there on minus the bytes that they own, and its leaves are the leaves that its members
own: one group-by over the prefixes of all conversations sums both.

Windows run over blocks of at most BLOCK turns of one conversation, so a conversation of any length is dealt over tasks;
its turns are numbered by a global sort. Turns come by turn number, null first, then by role, then by the hash of the
text (which only orders unequal texts of equal turn and role); repeated rows are turns like any others. Null roles and
texts are empty; rows without conv_id belong to no conversation and are left out; extra columns are ignored; a text of
any length is one hash; an empty table gives no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

#: Turns of one conversation that a window spans.
BLOCK = 1 << 12
#: Conversation ids that may be in one string on the way to a digest, as a power of two.
ENDS_BITS = 12
#: In the rebuilt conversations a family of FAMILY ids starts with turns of the first of them, fewer than SHARED.
FAMILY, SHARED = 5, 9

_PREFIX = ["depth", "p1", "p2"]


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, t1, t2, bytes): each turn's place from 1 on, its hashes and the bytes of its text."""
    said = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    who = F.coalesce(F.col(f"`{role}`"), F.lit(""))
    rows = conversations.filter(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), who.alias("role"),
        F.xxhash64(F.lit(1), who, said).alias("t1"), F.xxhash64(F.lit(2), said, who).alias("t2"), F.octet_length(said).cast("long").alias("bytes"),
    )
    # numbered along a global sort: a conversation's rows have consecutive numbers inside each partition, and a part's first number and count are small
    ordered = rows.orderBy("conv_id", F.col("turn").asc_nulls_first(), "role", "t1", "t2")
    placed = c.cut(ordered.select("conv_id", "t1", "t2", "bytes", F.monotonically_increasing_id().alias("at")).withColumn("part", F.shiftright("at", 33)), "turns")
    parts = placed.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).drop("n")
    return placed.join(parts, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("first") + F.col("skip")).alias("pos"), "t1", "t2", "bytes")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) rebuilt so that families share beginnings: conversation c has the first h turns of
    conversation c - c % FAMILY, then its own turns after its first h; h is crc32 of its decimal id, modulo SHARED."""
    sizes = placed.groupBy("conv_id").agg(F.max("pos").alias("n"))
    own = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % SHARED).alias("h"))
    convs = own.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = c.cut(convs.select("conv_id", "base", "h", "k"), "families")
    heads = placed.filter((F.col("pos") < SHARED) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    first = heads.join(convs.filter("h > 0"), "base").filter("pos <= h").select("conv_id", F.col("pos").alias("depth"), "t1", "t2", "bytes")
    rest = placed.join(convs, "conv_id").filter("pos > h").select("conv_id", (F.col("k") + F.col("pos") - F.col("h")).alias("depth"), "t1", "t2", "bytes")
    return convs.select("conv_id"), first.union(rest)


def paths(convs: DataFrame, steps: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each prefix of each conversation: conv_id, depth, its hashes p1 and p2, its parent's q1 and q2, the bytes
    of its last text and the bytes before that."""
    terms = steps.select("conv_id", "depth", F.xxhash64("depth", "t1", "t2").alias("x1"), F.xxhash64("t2", "t1", "depth").alias("x2"), "bytes", F.expr(f"(depth - 1) div {block}").alias("block"))
    along = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = terms.select("*", F.bit_xor("x1").over(along).alias("p1"), F.bit_xor("x2").over(along).alias("p2"), F.sum("bytes").over(along).alias("sum"))
    run = c.cut(run, "runs")
    # what the blocks before a block add up to; a conversation of one block has no row here
    blocks = run.groupBy("conv_id", "block").agg(*(F.bit_xor(x).alias(x) for x in ("x1", "x2")), F.sum("bytes").alias("sum"))
    past = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offset = blocks.select("conv_id", "block", F.bit_xor("x1").over(past).alias("o1"), F.bit_xor("x2").over(past).alias("o2"), F.sum("sum").over(past).alias("o")).filter("block > 0")
    late = run.filter("block > 0").join(offset, ["conv_id", "block"])
    late = late.withColumns({"p1": F.col("p1").bitwiseXOR(F.col("o1")), "p2": F.col("p2").bitwiseXOR(F.col("o2")), "sum": F.col("sum") + F.col("o")}).select(*run.columns)
    every = run.filter("block = 0").union(late)
    parents = [F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2")]
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", *(zero.alias(x) for x in ("depth", "p1", "p2", "q1", "q2", "bytes", "before")))
    return c.cut(every.select("conv_id", "depth", "p1", "p2", *parents, "bytes", (F.col("sum") - F.col("bytes")).alias("before")).union(roots), "paths")


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) from rows (depth, p1, p2, conv_id), ids ascending; no task holds more than a string of
    ids that lie close together, however many end in one node."""
    joined = ends.groupBy(*_PREFIX, F.shiftright("conv_id", ENDS_BITS).alias("near")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*_PREFIX, "ends_sha256"]
        at, digest = None, hashlib.sha256()
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key == at:
                    digest.update(b"," + ids.encode())
                    continue
                if at is not None:
                    done.append([*at, digest.hexdigest()])
                at, digest = key, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=names)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in [*at, digest.hexdigest()]], names=names)

    dealt = joined.repartition(*_PREFIX).sortWithinPartitions(*_PREFIX, "near").select(*_PREFIX, "ids")
    return dealt.mapInArrow(run, "depth long, p1 long, p2 long, ends_sha256 string")


def trie(found: DataFrame) -> DataFrame:
    """A row per node from the rows of paths: conv_id (its owner), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256."""
    some = found.groupBy(*_PREFIX).agg(F.min("conv_id").alias("owner"), *(F.any_value(x).alias(x) for x in ("q1", "q2", "before")))
    nodes = c.cut(some, "nodes")
    kids = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    marked = c.cut(nodes.join(kids, _PREFIX, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "marked")
    # from where on a conversation owns its path, what stands before that, and whether its end is a leaf of its own
    top = F.min_by(F.struct("q1", "q2", "before"), "depth")
    owners = marked.groupBy(F.col("owner").alias("conv_id")).agg(F.min("depth").alias("since"), top.alias("top"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf"))
    owners = owners.select("conv_id", "since", "top.q1", "top.q2", F.col("top.before").alias("shared"), "leaf")
    above = owners.filter("since > 0").select("conv_id", (F.col("since") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    above = above.join(marked.select(*_PREFIX, F.col("owner").alias("above")), _PREFIX).select("conv_id", "above")
    whole = found.groupBy("conv_id").agg(F.max("depth").alias("last"), F.max(F.col("before") + F.col("bytes")).alias("total"))
    stats = whole.join(owners.drop("q1", "q2"), "conv_id", "left").join(above, "conv_id", "left")
    stats = stats.select("conv_id", "last", F.coalesce("since", F.col("last") + 1).alias("since"), F.coalesce("shared", "total").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf"), "above")
    each = c.cut(found.drop("q1", "q2", "bytes").join(stats, "conv_id"), "marks")
    own = F.col("depth") >= F.col("since")
    parent = F.when(F.col("depth") == F.col("since"), F.col("above")).otherwise(F.col("conv_id"))
    zero = F.lit(0).cast("long")
    rows = each.select(
        *_PREFIX, F.when(own, F.col("conv_id")).alias("conv_id"), F.when(own, parent).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), zero.alias("n_children"),
        F.col("leaf").cast("long").alias("n_leaves"), F.when(own, zero).otherwise(F.col("shared") - F.col("before")).alias("saved_tokens"),
    )
    none = F.lit(None).cast("long")
    rows = rows.union(kids.select(*_PREFIX, none, none, zero, "n_children", zero, zero))
    sums = rows.groupBy(*_PREFIX).agg(*(F.max(x).alias(x) for x in ("conv_id", "parent_conv_id")), *(F.sum(x).alias(x) for x in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    ends = _digests(each.filter(F.col("depth") == F.col("last")).select(*_PREFIX, "conv_id"))
    out = sums.join(ends, _PREFIX, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The trie of the conversations as they are."""
    placed = turns(conversations, conv, turn, role, text).withColumnRenamed("pos", "depth")
    return trie(paths(placed.select("conv_id").distinct(), placed, block))


def family_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(paths(*rebuilt(turns(conversations)), block))
