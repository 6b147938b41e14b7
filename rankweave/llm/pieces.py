"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled to three machines. The normaliser is a one-state transducer
that turns blanks into the block mark and puts one before the text. The piece machine
has an arc for each piece, spelled over characters. The fallback machine has an arc for
every other character, which gives its UTF-8 bytes as byte pieces. They are composed
with each input on the fly, and the shortest path in the tropical semiring (least sum
of weights) is the encoding.

The weights depend on the model's kind. For a unigram model an arc weighs minus the
piece's score, so the path is the likeliest segmentation. A model of merges gives no
sum that could be minimised; there the arcs carry the last piece as their state, and
an arc after another weighs nothing if merging the two pieces' characters from scratch
gives these two pieces back, and infinity if not. The one path of finite weight is what
merging gives: a cut survives all merges if and only if it survives those of its two
neighbours. At most one such path reaches each position, so the walk is linear.

The tables are bounded by the model file, which is read on the executors from a path
that they all have.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame

from rankweave.llm.common import map_texts

BLANK = "▁"
# Kinds of pieces and models in the file format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2
# Words whose codes a worker keeps; beyond it the store is emptied, at no loss.
CACHE_WORDS = 300_000
# Pairs of arcs whose weight a worker keeps, likewise.
CACHE_PAIRS = 1_000_000
# Longest word that is kept; longer ones are rarely met twice.
CACHE_LENGTH = 40
INFINITY = float("inf")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        elif tag & 7 == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if tag & 7 == 1 else 4
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Transducer:
    """A compiled model; ``encode`` and ``decode`` work on whole texts."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = file.read()
        self.kind, rules, prefix, trim, escape = UNIGRAM, b"", True, True, True
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        for number, value in _fields(data):
            if number == 1:
                part = dict(_fields(value))
                self.pieces.append(part.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", part[2])[0] if 2 in part else 0.0)
                self.kinds.append(part.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                part = dict(_fields(value))
                rules = part.get(2, b"")
                prefix, trim, escape = (bool(part.get(n, 1)) for n in (3, 4, 5))
        if self.kind not in (UNIGRAM, MERGES) or rules or not escape or USER in self.kinds:
            raise ValueError("only unigram and merge models without character rules and user pieces are compiled")
        self.prefix, self.trim = prefix, trim
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.arcs = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL and p}
        # Every beginning of a piece; -1 where it is none itself.
        self.spelled = {p[:n]: -1 for p in self.arcs for n in range(1, len(p))} | self.arcs
        # No piece crosses from a letter to a block mark: words can be walked singly.
        self.splits = not any(BLANK in p.lstrip(BLANK) for p in self.arcs)
        self.word = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}

    def normalise(self, text: str) -> str:
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        return (BLANK if self.prefix and text else "") + text.replace(" ", BLANK)

    def merge(self, text: str) -> list[str]:
        """Merge from scratch: the best-scored joint of neighbours first, then the leftmost."""
        parts = list(text)
        while True:
            best, at = -INFINITY, -1
            for i in range(len(parts) - 1):
                arc = self.arcs.get(parts[i] + parts[i + 1])
                if arc is not None and self.scores[arc] > best:
                    best, at = self.scores[arc], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _spelling(self, arc: int) -> str:
        """The characters of an arc; numbers beyond the pieces are single characters."""
        return self.pieces[arc] if arc < len(self.pieces) else chr(arc - len(self.pieces))

    def _follows(self, left: int, right: int) -> bool:
        """Whether an arc after another has a finite weight."""
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        parts = [self._spelling(left), self._spelling(right)]
        known = self.pairs[left << 21 | right] = self.merge("".join(parts)) == parts
        return known

    def _merged_path(self, word: str) -> list[int]:
        """The arcs of the one path of finite weight, from the position it reaches last."""
        n, spelled, pairs, beyond = len(word), self.spelled, self.pairs, len(self.pieces)
        # Of each position: the last arc of the path that reaches it, and its beginning.
        last, origin = [-1] * (n + 1), [0] * (n + 1)
        for begin in range(n):
            before = last[begin]
            for end in range(begin + 1, n + 1):
                arc = spelled.get(word[begin:end])
                if arc is None or arc < 0:
                    if end == begin + 1:
                        single = beyond + ord(word[begin])
                        if last[end] < 0 and (not begin or self._joint(before, single)):
                            last[end], origin[end] = single, begin
                    if arc is None:
                        break
                elif last[end] < 0:
                    if begin:
                        fits = pairs.get(before << 21 | arc)
                        if not (self._follows(before, arc) if fits is None else fits):
                            continue
                    last[end], origin[end] = arc, begin
        path, end = [], n
        while end:
            path.append(last[end])
            end = origin[end]
        return path[::-1]

    def _joint(self, left: int, right: int) -> bool:
        fits = self.pairs.get(left << 21 | right)
        return self._follows(left, right) if fits is None else fits

    def _likeliest_path(self, word: str) -> list[int]:
        """The arcs of the path with the least sum of minus the pieces' scores."""
        n, beyond = len(word), len(self.pieces)
        weight, origin, last = [0.0] + [INFINITY] * n, [0] * (n + 1), [-1] * (n + 1)
        for begin in range(n):
            for end in range(begin + 1, n + 1):
                arc = self.spelled.get(word[begin:end])
                if arc is not None and arc >= 0:
                    cost = weight[begin] - self.scores[arc]
                elif end == begin + 1:
                    arc_or_char, cost = beyond + ord(word[begin]), weight[begin] + self.fallback
                    if cost < weight[end]:
                        weight[end], origin[end], last[end] = cost, begin, arc_or_char
                    if arc is None:
                        break
                    continue
                elif arc is None:
                    break
                else:
                    continue
                if cost < weight[end]:
                    weight[end], origin[end], last[end] = cost, begin, arc
        path, end = [], n
        while end:
            path.append(last[end])
            end = origin[end]
        return path[::-1]

    def _path(self, word: str) -> tuple[int, ...]:
        """The ids on the shortest path through a word."""
        arcs = self._merged_path(word) if self.kind == MERGES else self._likeliest_path(word)
        if max(arcs) < len(self.pieces):
            return tuple(arcs)
        return tuple(i for arc in arcs for i in self._ids(arc))

    @functools.cached_property
    def fallback(self) -> float:
        """Weight of a character that is no piece: worse than the worst piece by ten."""
        return 10.0 - min((self.scores[i] for i in self.arcs.values()), default=0.0)

    def _ids(self, arc: int) -> list[int]:
        if arc < len(self.pieces):
            return [arc]
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in self._spelling(arc).encode("utf-8", "replace")]

    def encode(self, text: str) -> list[int]:
        normal = self.normalise(text)
        out: list[int] = []
        known = self.known
        for word in self.word.findall(normal) if self.splits else [normal] if normal else []:
            ids = known.get(word)
            if ids is None:
                ids = self._path(word)
                if len(word) <= CACHE_LENGTH:
                    if len(known) > CACHE_WORDS:
                        known.clear()
                    known[word] = ids
            out += ids
        return out

    @functools.cached_property
    def _spelled(self) -> list[bytes]:
        """The bytes of each id; control pieces have none."""
        out = []
        for i, (piece, kind) in enumerate(zip(self.pieces, self.kinds)):
            if kind == BYTE:
                out.append(bytes([self.byte_of[i]]))
            elif kind == UNKNOWN:
                out.append(f" {chr(0x2047)} ".encode())
            else:
                out.append(b"" if kind == CONTROL else piece.replace(BLANK, " ").encode())
        return out

    def decode(self, ids: list[int]) -> str:
        """The text that ids spell; bytes that are no UTF-8 become the replacement mark.

        The blank that was put before the text is taken off again.
        """
        spelled = self._spelled
        text = b"".join([spelled[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """The compiled model; a Python worker keeps it, with its word store, between tasks."""
    return Transducer(path)


def encode(
    docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", with_text: bool = False
) -> DataFrame:
    """(key, ids, n_pieces) of each row; with ``with_text`` also decoded and exact.

    ``exact`` says that decoding gives the text again, which holds unless the text has
    the block mark itself (it is written as a blank) or the model trims blanks. A null
    text has null ids and no pieces; an empty one no ids. Every row gives one row, null
    keys and repeated rows included; other columns are not carried. ``model`` is the
    path of the model file on every machine.
    """

    def start():
        machine = transducer(model)

        def work(texts):
            ids = [None if t is None else machine.encode(t) for t in texts]
            columns = [ids, [len(i) if i else 0 for i in ids]]
            if with_text:
                back = [None if i is None else machine.decode(i) for i in ids]
                columns += [back, [b == t for b, t in zip(back, texts)]]
            return None, columns

        return work

    fields = {"ids": "array<int>", "n_pieces": "long"}
    if with_text:
        fields |= {"decoded": "string", "exact": "boolean"}
    return map_texts(docs, [key], text, fields, start)


def decode(coded: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of each row of ids; null ids give a null text.

    Ids outside the model raise an error.
    """

    def start():
        machine = transducer(model)
        return lambda rows: (None, [[None if r is None else machine.decode(r) for r in rows]])

    return map_texts(coded, [key], ids, {"text": "string"}, start)
