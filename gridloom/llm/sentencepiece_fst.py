"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled into machines. The normaliser N rewrites the longest strings that the model's character map
has, squeezes spaces if the model says so, and puts a space before the text. The lexicon L takes a string to a sequence
of pieces; its arcs are the paths of a trie of the pieces, weighted by the negated score, and for a character that no
piece has, one arc of its bytes' pieces (byte fallback) or of the unknown piece. For BPE models a grammar G reads pieces
and remembers the last one: it admits q after p if merging the string pq leaves the two apart, and a piece only if
merging its own string gives the piece. A sequence of pieces is what BPE makes of its string exactly if G admits
it, so the composition N ∘ L ∘ G has one path per input; for unigram models there is no G and the scores decide.
An input is composed with the machines, position by position, and the path of least weight (tropical semiring: weights
add along a path, the least wins, the first of equals) is read back. Decoding is the inverse machine.

Inputs are cut where no piece can reach across (before a run of spaces, around line feeds that no piece has), so the
shortest path is a concatenation of the parts' paths. Parts that were met before are looked up; new ones are composed
all at once, as arrays, a position of all of them at a time.

Null texts have null ids; empty texts have none; rows repeat and ids may be null, each row is encoded by itself; a text
of any length is one unit, held by one task; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Parts that are looked up, and the longest (in bytes) that is.
CACHED, LONGEST = 250_000, 160
#: Pairs of pieces whose answer is kept.
PAIRS = 400_000
#: Bytes of text that are encoded at once.
TEXT_BYTES = 1 << 18
#: States (parts times positions) that are composed at once.
STATES = 1 << 18
_INF = float("inf")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protocol buffer message."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    at = 0
    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n


class Normaliser:
    """N: rewrites strings of a character map, the longest first; then spaces. The result has spaces where pieces have ▁."""

    def __init__(self, charsmap: bytes, prefix: bool, squeeze: bool, kept: re.Pattern | None = None):
        self.prefix, self.squeeze, self.kept = prefix, squeeze, kept
        self.rules = dict(charsmap_rules(charsmap)) if charsmap else {}
        self._longest: dict[str, int] = {}
        for key in self.rules:
            self._longest[key[0]] = max(self._longest.get(key[0], 0), len(key))
        one = "".join(re.escape(k) for k in self.rules if len(k) == 1)
        firsts = "".join(re.escape(ch) for ch in {k[0] for k in self.rules if len(k) > 1})
        seconds = "".join(re.escape(ch) for ch in {k[1] for k in self.rules if len(k) > 1})
        starts = [f"[{one}]"] * bool(one) + [f"[{firsts}](?=[{seconds}])"] * bool(firsts)
        self._start = re.compile("|".join(starts)) if starts else None

    @property
    def plain(self) -> bool:
        """Whether only the space before the text is put."""
        return not self.rules and not self.squeeze and self.kept is None

    def _rewrite(self, text: str) -> str:
        if self._start is None:
            return text
        out, at = [], 0
        while m := self._start.search(text, at):
            i = m.start()
            n = next((n for n in range(min(self._longest[text[i]], len(text) - i), 0, -1) if text[i : i + n] in self.rules), 0)
            out += [text[at:i], self.rules[text[i : i + n]] if n else text[i]]
            at = i + (n or 1)
        return "".join(out) + text[at:]

    def __call__(self, text: str) -> str:
        if self.kept is not None:
            text = "".join(x if k % 2 else self._rewrite(x) for k, x in enumerate(self.kept.split(text)))
        else:
            text = self._rewrite(text)
        text = text.replace(SPACE, " ") if not self.squeeze else text
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" ")).replace(SPACE, " ")
        return (" " if self.prefix else "") + text if text else ""


def charsmap_rules(data: bytes) -> Iterator[tuple[str, str]]:
    """The rules of a compiled character map: a double-array trie of the keys, and their values, each closed by a zero byte."""
    size = struct.unpack_from("<I", data)[0]
    units, values = np.frombuffer(data, "<u4", size // 4, 4), data[4 + size :]
    every = np.arange(256)

    def base(at: int) -> int:
        unit = int(units[at])
        return at ^ (unit >> 10) << (8 if unit >> 9 & 1 else 0)

    left = [(base(0), b"")]
    while left:
        at, key = left.pop()
        places = at ^ every[1:]
        places = np.where(places < len(units), places, 0)
        for byte in (np.flatnonzero((units[places] & np.uint32(0x800000FF)) == every[1:]) + 1).tolist():
            place, own = at ^ byte, key + bytes([byte])
            below = base(place)
            if units[place] >> 8 & 1:
                start = int(units[below]) & 0x7FFFFFFF
                yield own.decode(), values[start : values.index(b"\0", start)].decode()
            left.append((below, own))


class Transducer:
    """The compiled machines of one model."""

    def __init__(self, model: bytes):
        pieces: list[tuple[str, float, int]] = []
        self.kind, prefix, squeeze, charsmap, self.fallback = UNIGRAM, True, True, b"", False
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
            elif number == 2:
                spec = dict(_fields(value))
                self.kind, self.fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
                if spec.get(24, 0):
                    raise ValueError("models with spaces as suffixes are not supported")
            elif number == 3:
                spec = dict(_fields(value))
                charsmap, prefix, squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
                if not spec.get(5, 1):
                    raise ValueError("models that don't escape spaces are not supported")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if any(kind == UNUSED or kind == USER_DEFINED and self.kind == UNIGRAM for _, _, kind in pieces):
            raise ValueError("unused pieces, and user-defined pieces of unigram models, are not supported")
        self.lexicon = {p: (i, -s) for i, (p, s, kind) in enumerate(pieces) if kind == NORMAL}
        self.user = {p.replace(SPACE, " "): i for i, (p, _, kind) in enumerate(pieces) if kind == USER_DEFINED}
        self.unknown = next(i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN)
        self.byte = [0] * 256
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte[int(p[3:5], 16)] = i
        self.longest = max(map(len, self.lexicon), default=1)
        self.strings = [p for p, _, _ in pieces]
        self._user = re.compile("(" + "|".join(re.escape(u) for u in sorted(self.user, key=len, reverse=True)) + ")") if self.user else None
        self.normaliser = Normaliser(charsmap, prefix, squeeze, self._user)
        self._inverse([(b"" if kind == CONTROL else bytes([int(p[3:5], 16)]) if kind == BYTE else b" \xe2\x81\x87 " if kind == UNKNOWN else p.replace(SPACE, " ").encode()) for p, _, kind in pieces])
        # where parts may be cut
        self._by_space = SPACE in self.lexicon and not any(SPACE in p.lstrip(SPACE) for p in self.lexicon)
        self._by_line = self.fallback and not any("\n" in p for p in self.lexicon)
        self._parts = re.compile((" *[^ \n]+| +|\n" if self._by_line else " *[^ ]+| +") if self._by_space else r"[^\n]+|\n" if self._by_line else r"(?s).+")
        # a character that no piece has costs more than any piece
        self.penalty = max((w for _, w in self.lexicon.values()), default=0.0) + 10.0
        self._known = c.Lookup(np.int32, CACHED)
        self._grammar()
        self._trie_arrays()

    # G
    def merges(self, text: str) -> list[str]:
        """What BPE makes of a short string: the adjacent pair with the best piece merges first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = _INF, -1
            for i in range(len(parts) - 1):
                w = self.lexicon.get(parts[i] + parts[i + 1], (0, _INF))[1]
                if w < best:
                    best, at = w, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts that the last merge joins when BPE makes the piece; none if it doesn't make it."""
        parts = list(piece)
        while len(parts) > 2:
            best, at = _INF, -1
            for i in range(len(parts) - 1):
                w = self.lexicon.get(parts[i] + parts[i + 1], (0, _INF))[1]
                if w < best:
                    best, at = w, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _grammar(self) -> None:
        """The pieces that may be on a path: all of a unigram model, those that merging makes of a BPE model, and how each is made."""
        self._made: dict[int, tuple[int, int]] = {}
        self._arcs: dict[str, int] = {}
        for p, (i, _) in self.lexicon.items():
            if self.kind == BPE and len(p) > 1:
                if (pair := self._last_merge(p)) is None:
                    continue
                self._made[i] = (self.lexicon[pair[0]][0], self.lexicon[pair[1]][0])
            self._arcs[p] = i
        self._weight = [0.0] * len(self.strings)
        for i, w in self.lexicon.values():
            self._weight[i] = w
        self._pairs = c.Table()

    def _trie_arrays(self) -> None:
        """L as a trie: the child of a node by a character (root 0), and the piece that ends in a node, -1 for none."""
        numbers, final, edges = {"": 0}, [-1], []
        for p, i in self._arcs.items():
            for k in range(1, len(p) + 1):
                if p[:k] not in numbers:
                    numbers[p[:k]] = len(final)
                    edges.append((numbers[p[: k - 1]], ord(p[k - 1])))
                    final.append(-1)
            final[numbers[p]] = i
        self._final, self._children = np.array(final), c.Table()
        if edges:
            at, ch = np.array(edges, np.int64).T
            self._children.add(self._edge(at, ch), np.arange(1, len(final), dtype=np.int32))
        self._cost = np.append(np.array(self._weight), self.penalty)  # the last is the fallback's, of number -1

    @staticmethod
    def _edge(node: np.ndarray, ch: np.ndarray) -> np.ndarray:
        return c.mix((node.astype(np.uint64) << np.uint64(21) | ch.astype(np.uint64)) + np.uint64(1))

    def apart(self, p: int, q: int) -> bool:
        """Whether merging p's and q's strings together never joins them: the merges that make p and q are undone from
        the last on, and at no time may the two parts that meet at the border have a merge that was due first."""
        lexicon, strings, weight, made = self.lexicon, self.strings, self._weight, self._made
        limit, strict = _INF, True
        while True:
            w = lexicon.get(strings[p] + strings[q], (0, _INF))[1]
            if w < limit or not strict and w == limit:
                return False
            a, b = made.get(p), made.get(q)
            if a is None and b is None:
                return True
            # of equal merges the leftmost comes first, so the right one is undone first, and a border merge precedes it
            if a is None or b is not None and weight[q] >= weight[p]:
                limit, strict, q = weight[q], False, b[0]
            else:
                limit, strict, p = weight[p], True, a[1]

    def _admitted(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """apart for arrays of pieces; p below 0 admits every q. Pairs that were met before are looked up."""
        out = p < 0
        at = np.flatnonzero(~out)
        number = p[at].astype(np.int64) * len(self.strings) + q[at]
        keys = c.mix(number.astype(np.uint64) + np.uint64(1))
        got = self._pairs.find(keys)
        if (got < 0).any():
            new, one = np.unique(keys[got < 0], return_index=True)
            pairs = number[got < 0][one].tolist()
            if len(self._pairs) + len(pairs) > PAIRS:
                self._pairs.clear()
                new, one = np.unique(keys, return_index=True)
                pairs = number[one].tolist()
            self._pairs.add(new, np.array([self.apart(*divmod(x, len(self.strings))) for x in pairs], np.int32))
            got = self._pairs.find(keys)
        out[at] = got == 1
        return out

    # input ∘ L ∘ G, and its shortest path
    def path(self, text: str) -> list[int]:
        """The pieces on the path of least weight of one string (with ▁ for spaces); a character that no piece has is -2 less its code."""
        n, arcs, weight = len(text), self._arcs, self._weight
        best, last, back = [0.0] + [_INF] * n, [-1] + [-2] * n, [0] * (n + 1)
        for i in range(n):
            if best[i] == _INF:
                continue
            for j in range(i + 1, min(n, i + self.longest) + 1):
                piece = arcs.get(text[i:j])
                if piece is not None and best[i] + weight[piece] < best[j] and (self.kind != BPE or last[i] < 0 or self.apart(last[i], piece)):
                    best[j], last[j], back[j] = best[i] + weight[piece], piece, i
            if text[i] not in arcs and best[i] + self.penalty < best[i + 1]:
                best[i + 1], last[i + 1], back[i + 1] = best[i] + self.penalty, -1, i
        out: list[int] = []
        at = n
        while at:
            out.append(last[at] if last[at] >= 0 else -2 - ord(text[back[at]]))
            at = back[at]
        return out[::-1]

    def paths(self, chars: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """path for many strings at once: the strings' numbers, in order, and the pieces, and how many each string has."""
        n, most = len(size), int(size.max(initial=0))
        part = np.repeat(np.arange(n), size)
        start = c.ranges(np.zeros(n, np.int64), size)
        place = c.ranges(first, size)
        node, alive, arcs = np.zeros(len(part), np.int64), np.arange(len(part)), []
        for step in range(min(most, self.longest)):  # every arc of every position, by walking the trie from all of them
            node = self._children.find(self._edge(node, chars[place[alive] + step]))
            alive, node = alive[node >= 0], node[node >= 0]
            piece = self._final[node]
            ends = piece >= 0
            arcs.append((alive[ends], np.full(int(ends.sum()), step + 1), piece[ends]))
            if step == 0:
                other = np.ones(len(part), bool)
                other[alive[ends]] = False
                other = np.flatnonzero(other)
                arcs.append((other, np.ones(len(other), np.int64), np.full(len(other), -1)))
            on = start[alive] + step + 1 < size[part[alive]]
            alive, node = alive[on], node[on]
            if not len(alive):
                break
        at, length, piece = (np.concatenate(x) for x in zip(*arcs, strict=True))
        order = np.argsort(start[at], kind="stable")
        at, length, piece = at[order], length[order], piece[order]
        edges = np.searchsorted(start[at], np.arange(most + 1))
        best, last, back = np.full((n, most + 1), _INF), np.full((n, most + 1), -2, np.int32), np.zeros((n, most + 1), np.int32)
        best[:, 0], last[:, 0] = 0.0, -1
        for i in range(most):
            own = slice(edges[i], edges[i + 1])
            p, to, q = part[at[own]], i + length[own], piece[own]
            weight = best[p, i] + self._cost[q]
            ok = np.flatnonzero(weight < best[p, to])
            if self.kind == BPE:
                ok = ok[(q[ok] < 0) | self._admitted(last[p[ok], i], q[ok])]
            best[p[ok], to[ok]], last[p[ok], to[ok]], back[p[ok], to[ok]] = weight[ok], q[ok], i
        found, here, who = [], size.astype(np.int64), np.arange(n)
        while len(who := who[here[who] > 0]):
            q, before = last[who, here[who]], back[who, here[who]]
            found.append((who, np.where(q >= 0, q, -2 - chars[first[who] + before].astype(np.int64))))
            here[who] = before
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
        whose = np.concatenate([x for x, _ in found][::-1])
        order = np.argsort(whose, kind="stable")
        return whose[order], np.concatenate([x for _, x in found][::-1])[order], np.bincount(whose, minlength=n)

    def _escape(self, ch: str) -> list[int]:
        return [self.byte[b] for b in ch.encode("utf-8", "replace")] if self.fallback else [self.unknown]

    def _expanded(self, whose: np.ndarray, pieces: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of n strings has, and the ids: characters that no piece has become their bytes' pieces, or one unknown piece for a run of them."""
        odd = pieces < -1
        if not odd.any():
            return np.bincount(whose, minlength=n), pieces
        codes, back = np.unique(pieces[odd], return_inverse=True)
        escapes = [self._escape(chr(-2 - x)) for x in codes.tolist()]
        counts = np.ones(len(pieces), np.int64)
        counts[odd] = np.array([len(e) for e in escapes])[back]
        if not self.fallback:
            again = odd[1:] & odd[:-1] & (whose[1:] == whose[:-1])
            counts[1:][again] = 0
        ends = np.cumsum(counts)
        out = np.repeat(pieces, counts)
        table, where = np.array([e + [0] * (4 - len(e)) for e in escapes]), np.flatnonzero(odd)
        for k in range(4):
            has = counts[where] > k
            out[ends[where[has]] - counts[where[has]] + k] = table[back[has], k]
        return np.bincount(whose, counts, n).astype(np.int64), out

    def _compose(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each part has, and the ids of all."""
        text = data[c.ranges(starts, sizes)]
        chars = np.frombuffer(text.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
        chars[chars == 0x20] = ord(SPACE)
        heads = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])[np.concatenate([[0], np.cumsum(sizes)])]
        first, size = heads[:-1], np.diff(heads)
        order = np.argsort(size, kind="stable")
        whose, pieces, at = [], [], 0
        while at < len(order):
            # strings of like sizes, so many that their table of states stays small
            to = at + max(1, int(np.searchsorted(size[order[at:]] * np.arange(1, len(order) - at + 1), STATES, "right")))
            some = order[at:to]
            own, found, _ = self.paths(chars, first[some], size[some])
            whose.append(some[own])
            pieces.append(found)
            at = to
        whose, pieces = np.concatenate(whose), np.concatenate(pieces)
        order = np.argsort(whose, kind="stable")
        return self._expanded(whose[order], pieces[order], len(starts))

    def _cut(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes of the parts of all rows."""
        start = np.zeros(len(data) + 1, bool)
        start[off] = True
        if self._by_space:
            space = data == 0x20
            start[:-1] |= space
            start[1:-1] &= ~(space[1:] & space[:-1]) | self._edges(off, len(data))[1:-1]
        if self._by_line:
            feed = data == 0x0A
            start[:-1] |= feed
            start[1:] |= feed
        starts = np.flatnonzero(start[:-1])
        return starts, np.diff(np.append(starts, len(data)))

    @staticmethod
    def _edges(off: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n + 1, bool)
        out[off] = True
        return out

    def _normal(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the normalised texts."""
        if not self.normaliser.plain:
            return c.flat(pa.array([self.normaliser(t) if t else "" for t in col.to_pylist()], pa.string()))
        data, off = c.flat(pc.replace_substring(col, SPACE, " "))
        if not self.normaliser.prefix:
            return data, off
        full = off[1:] > off[:-1]
        return np.insert(data, off[:-1][full], 0x20), off + np.concatenate([[0], np.cumsum(full)])

    def encode_batch(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and n + 1 bounds of the texts in them."""
        if self._user is not None:
            each = [self.encode(t) if t else [] for t in col.to_pylist()]
            return np.array([i for x in each for i in x], np.int32), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        data, off = self._normal(col)
        starts, sizes = self._cut(data, off)
        counts, at = np.zeros(len(starts), np.int64), np.full(len(starts), -2, np.int64)
        short = np.flatnonzero(sizes <= LONGEST)
        if len(short):
            at[short] = self._known.learned(data, starts[short], sizes[short], lambda i: self._compose(data, starts[short[i]], sizes[short[i]]))
        known, rest = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        counts[known] = self._known.counts(at[known])
        own = {k: np.array(self._escaped(self.path(data[starts[k] : starts[k] + sizes[k]].tobytes().decode().replace(" ", SPACE))), np.int32) for k in rest.tolist()}
        counts[rest] = [len(own[k]) for k in rest.tolist()]
        ends = np.cumsum(counts)
        out = np.zeros(ends[-1] if len(ends) else 0, np.int32)
        out[c.ranges(ends[known] - counts[known], counts[known])] = self._known.ids(at[known])
        for k, ids in own.items():
            out[ends[k] - counts[k] : ends[k]] = ids
        return out, np.concatenate([[0], ends])[np.searchsorted(starts, off)]

    def _escaped(self, pieces: list[int]) -> list[int]:
        return self._expanded(np.zeros(len(pieces), np.int64), np.array(pieces, np.int64), 1)[1].tolist()

    def encode(self, text: str) -> list[int]:
        """One text's ids, part by part."""
        out: list[int] = []
        normal = self.normaliser(text) if text else ""
        for k, between in enumerate(self._user.split(normal) if self._user else [normal]):
            if k % 2:
                out.append(self.user[between])
            else:
                for x in self._parts.findall(between):
                    out += self._escaped(self.path(x.replace(" ", SPACE)))
        return out

    # the inverse machine
    def _inverse(self, output: list[bytes]) -> None:
        self._bytes, self._length = np.frombuffer(b"".join(output), np.uint8), np.array([len(x) for x in output], np.int64)
        self._from = np.cumsum(self._length) - self._length

    def decode_batch(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts and their n + 1 offsets, from their ids and bounds."""
        size = self._length[ids]
        data = self._bytes[c.ranges(self._from[ids], size)]
        off = np.concatenate([[0], np.cumsum(size)])[bounds]
        if self.normaliser.prefix or self.normaliser.squeeze:
            first = off[:-1][off[1:] > off[:-1]]
            first = first[data[first] == 0x20]
            data = np.delete(data, first)
            off = off - np.searchsorted(first, off)
        return data, off

    def decode(self, ids: list[int]) -> str:
        return self.decode_batch(np.array(ids, np.int64), np.array([0, len(ids)]))[0].tobytes().decode("utf-8", "replace")


def same_rows(a: np.ndarray, a_off: np.ndarray, b: np.ndarray, b_off: np.ndarray) -> np.ndarray:
    """Whether each row of bytes is the same in a and b."""
    same = np.diff(a_off) == np.diff(b_off)
    size = np.where(same, np.diff(a_off), 0)
    differ = a[c.ranges(a_off[:-1], size)] != b[c.ranges(b_off[:-1], size)]
    same[np.repeat(np.arange(len(size)), size)[differ]] = False
    return same


@lru_cache(2)
def compiled(model: bytes) -> Transducer:
    return Transducer(model)


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, ids, n_tokens, round_trip (whether decoding the ids gives the text again)."""
    df = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fst, texts = compiled(model), batch.column(1)
        ids, bounds = fst.encode_batch(texts)
        same = same_rows(*fst.decode_batch(ids, bounds), *c.flat(texts))
        null = texts.is_null().to_numpy(zero_copy_only=False)
        offsets = pa.array(bounds.astype(np.int32), mask=np.append(null, False))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(np.diff(bounds).astype(np.int32)), pa.array(same, mask=null)], names=["doc_id", "ids", "n_tokens", "round_trip"])

    kind = docs.schema[id_col].dataType.simpleString()
    return c.map_text(df, run, f"doc_id {kind}, ids array<int>, n_tokens int, round_trip boolean", most=TEXT_BYTES)


def decode(encoded: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """A row per row: doc_id, text."""
    c.small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(model)
        for batch in batches:
            texts = [None if ids is None else fst.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
