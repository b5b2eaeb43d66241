"""URL filters by Bloom filter cascade, in DataFrame functions only.

A rule is a host and a path prefix; it fits the host and its subdomains where the url's path starts with the
rule's. A listed host blocks itself and its subdomains where no rule fits. For each url the keys that could be
listed are host suffixes with path prefixes (only those of a rule's number of labels and path length), and the
distinct keys of all urls are the universe. Per list, level 1 of the cascade encodes the listed keys, level 2 the
keys of the universe that pass level 1 by mistake, level 3 the listed keys that pass level 2 by mistake, and so on
until no mistake is left: for every key of the universe the answer is exact, and urls meet no join. Level 1 is as sharp
as it takes to leave about as many mistakes as there are listed keys, so later levels are smaller than it. A level of
all lists is built and tested together.

The filters are literals of the plan, each once, so their size is bounded: keys are dealt by a hash into as many segments
as keep the filters of a segment within MOST_BITS, and with more than one, each segment's cascade is one pass over the
urls, whose state is written before the next. The answer is the cascade's at every size.

Null urls, empty ones and urls without "://" have an empty host and path and no rule; an empty host is never listed; a
url of any length is one row; of rules that fit, the longest wins, and of equals the one with the longer host; a key that
is both blocked and allowed is blocked. Rows with null or equal ids stay rows; extra columns are ignored; an empty table
gives an empty result, empty lists block nothing.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Bits of the filters that one plan holds for a list: 8 MB.
MOST_BITS = 1 << 26
#: Mistakes of a level, as a share of the keys that it is asked for: at most this, and of level 1 as few as there are listed keys.
MISTAKES = 0.024
LISTS = ("block", "allow", "listed")
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UP, _LOW), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """The keys of a url that a list could hold, the longest first."""
    parts = F.split(host, r"\.", -1)
    n = F.size(parts)
    # as [length, host length] and key, so that sorting puts the longest first, and of equals the longer host
    out = []
    for k in labels:
        suffix = F.array_join(F.slice(parts, F.greatest(n - k + 1, F.lit(1)), F.lit(k)), ".")
        for length in lengths:
            key = F.concat(suffix, F.substring(path, 1, length))
            fits = (n >= k) & (suffix != "") & (F.length(path) >= length)
            out.append(F.when(fits, F.struct(F.length(key).alias("n"), F.length(suffix).alias("h"), key.alias("key"))))
    if not out:
        return F.array().cast("array<string>")
    return F.transform(F.sort_array(F.array_compact(F.array(*out)), asc=False), lambda x: x["key"])


def hashes_and_bits(mistakes: float) -> tuple[int, float]:
    """How many hashes, and how many bits a key, a filter with that share of mistakes has."""
    hashes = max(4, min(16, round(-math.log2(mistakes))))
    return hashes, -hashes / math.log(1 - mistakes ** (1 / hashes))


class Filter:
    """A Bloom filter of n keys: its bits, how many hashes, and their seed."""

    def __init__(self, n: int, mistakes: float, seed: int):
        self.hashes, per_key = hashes_and_bits(mistakes)
        self.size, self.seed, self.bits = 64 * math.ceil(n * per_key / 64), seed, b""

    def places(self, key: Column) -> Column:
        return F.array(*(F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(j)), F.lit(self.size)) for j in range(self.hashes)))

    def passes(self, key: Column) -> Column:
        """The bits are 64-bit words, each with its highest byte first."""

        def one(at: Column) -> Column:
            byte = F.floor(at / 64) * 8 + 7 - F.floor(F.pmod(at, F.lit(64)) / 8)
            value = F.conv(F.hex(F.substring(F.lit(self.bits), (byte + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return F.getbit(value, F.pmod(at, F.lit(8)).cast("int")) == 1

        return F.forall(self.places(key), one)


class Cascade:
    """Filters, level by level."""

    def __init__(self, levels: list[Filter]):
        self.levels = levels

    def __len__(self) -> int:
        return len(self.levels)

    def has(self, key: Column) -> Column:
        """Whether key is listed; exact for keys of the universe that the cascade was built with."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            answer = F.when(self.levels[i].passes(key), answer).otherwise(F.lit(i % 2 == 1))
        return answer if self.levels else F.lit(False)


def fill(rows: DataFrame, filters: dict[str, Filter]) -> None:
    """Sets the bits of each list's filter from rows (list, key): 4,096 bits of a filter are one row of the answer."""
    places = reduce(lambda other, name: F.when(F.col("list") == name, filters[name].places(F.col("key"))).otherwise(other), filters, F.array().cast("array<bigint>"))
    word = rows.select("list", F.explode(places).alias("p")).groupBy("list", F.floor(F.col("p") / 64).alias("w"))
    words = word.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))).alias("b"))
    held = words.groupBy("list", F.floor(F.col("w") / 64).alias("g")).agg(F.map_from_entries(F.collect_list(F.struct(F.pmod("w", F.lit(64)).alias("w"), "b"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex(F.coalesce(F.element_at("m", i.cast("long")), F.lit(0).cast("long"))), 16, "0"))
    bits = {name: bytearray(512 * math.ceil(f.size / 4096)) for name, f in filters.items()}
    for name, g, block in held.select("list", "g", F.unhex(F.array_join(every, ""))).collect():
        bits[name][512 * g : 512 * g + 512] = block
    for name, f in filters.items():
        f.bits = bytes(bits[name][: f.size // 8])


def first_share(n: float, asked: float) -> float:
    """The share of mistakes of a first level with n keys that is asked for so many others."""
    return max(1e-8, min(MISTAKES, n / max(1, asked)))


def build(universe: DataFrame, listed: DataFrame, asked: float) -> dict[str, Cascade]:
    """The cascade of each list (rows list, key; distinct) over universe (column key, distinct, about so many)."""
    want = dict(listed.groupBy("list").count().collect())
    levels: dict[str, list[Filter]] = {name: [] for name in LISTS}
    held = listed.groupBy("key").agg(F.collect_set("list").alias("lists"))
    tagged = c.cut(universe.join(held, "key", "left"), "keys")
    encode, other = listed, None
    while want:
        filters = {name: Filter(n, first_share(n, asked) if other is None else MISTAKES, 100 * LISTS.index(name) + len(levels[name])) for name, n in want.items()}
        fill(encode, filters)
        for name, f in filters.items():
            levels[name].append(f)
        if other is None:  # the keys of the universe, each for the lists that don't hold it
            names = [F.when(~F.coalesce(F.array_contains("lists", name), F.lit(False)) & f.passes(F.col("key")), F.lit(name)) for name, f in filters.items()]
            wrong = tagged.select(F.explode(F.array_compact(F.array(*names))).alias("list"), "key")
        else:
            own = reduce(lambda rest, name: F.when(F.col("list") == name, filters[name].passes(F.col("key"))).otherwise(rest), filters, F.lit(False))
            wrong = other.filter(own)
        wrong = c.cut(wrong, "mistakes")
        encode, other, want = wrong, encode, dict(wrong.groupBy("list").count().collect())
    return {name: Cascade(x) for name, x in levels.items()}


def url_filter(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A row per url: page_id, host, path, rule, verdict. rules: (verdict, host, path); listed: (host)."""
    host, path = host_path(F.col("url"))
    urls = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    labels = F.size(F.split("host", r"\.", -1))
    rows = rules.select(F.col("verdict").alias("list"), F.concat("host", "path").alias("key"), labels.alias("k"), F.length("path").alias("n"))
    rows = c.cut(rows.union(listed.select(F.lit("listed"), "host", labels, F.lit(0))).filter(F.col("list").isin(*LISTS) & F.col("key").isNotNull()).distinct(), "lists")
    shapes = rows.groupBy(F.col("list") == "listed").agg(F.sort_array(F.collect_set("k")), F.sort_array(F.collect_set("n"))).collect()  # few: numbers of labels, lengths of paths
    shapes = {named: (k, n) for named, k, n in shapes}
    keyed = urls.withColumn("rules", keys(F.col("host"), F.col("path"), *shapes.get(False, ([], [])))).withColumn("hosts", keys(F.col("host"), F.col("path"), *shapes.get(True, ([], []))))
    universe = c.cut(keyed.select(F.explode(F.concat("rules", "hosts")).alias("key")).distinct(), "universe")
    own = rows.select("list", "key").distinct()
    most = own.groupBy("list").count().agg(F.max("count")).first()[0] or 0
    asked = universe.count()
    segments = max(1, math.ceil(most * hashes_and_bits(first_share(most, asked))[1] / MOST_BITS)) if most else 1
    segment = lambda key: F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(segments))
    state = keyed.withColumns({"hit": F.lit(None).cast("struct<i:int,blocks:boolean,key:string>"), "named": F.lit(False)})
    for s in range(segments):
        inside = (lambda key: segment(key) == s) if segments > 1 else (lambda key: F.lit(True))  # noqa: B023, E731
        held = build(universe.filter(inside(F.col("key"))), own.filter(inside(F.col("key"))), asked / segments)

        def found(key: Column, i: Column) -> Column:
            blocks, allows = held["block"].has(key), held["allow"].has(key)  # noqa: B023
            return F.when(inside(key) & (blocks | allows), F.struct(i.alias("i"), blocks.alias("blocks"), key.alias("key")))  # noqa: B023

        now = F.get(F.array_compact(F.transform("rules", found)), F.lit(0))
        first = F.when(F.col("hit").isNull() | (now["i"] < F.col("hit.i")), now).otherwise(F.col("hit"))
        named = F.col("named") | F.exists("hosts", lambda key: inside(key) & held["listed"].has(key))  # noqa: B023
        state = state.withColumns({"hit": first, "named": named})
        if segments > 1:
            state = c.cut(state, "state")
    verdict = F.when(F.col("hit.blocks"), "block").when(F.col("hit").isNotNull(), "allow").when(F.col("named"), "block").otherwise("allow")
    return state.select("page_id", "host", "path", F.col("hit.key").alias("rule"), verdict.alias("verdict"))
