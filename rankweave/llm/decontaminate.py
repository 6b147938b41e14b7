"""Benchmark passages in documents, also edited ones.

Edit distance (over words) is mapped to Hamming distance by random walks: a walk reads
the word it stands at, writes it down, and moves on or stays by a random bit that depends
on the step and the word. Two texts walk together where they agree, and often find
together again after an edit. Some written positions are sampled to make a key, from the whole
walk and from shorter and shorter beginnings of it: words left out or put in all along a
passage part two walks for good, but seldom in their first steps. So longer classes have
more keys, and a window within the allowed edits of an item has a key in common with it
with probability ``RECALL`` or more. Candidates are verified by their exact edit distance.

Windows are as long as the items, which are put into classes of similar length. The walk
need not begin where no item can be. With d edits a window of n words keeps n - d words
of the item, and n - 1 - 2d of its pairs of neighbouring words, none of them more often than
the item has it; windows with fewer words or pairs of any item are passed over, which
loses nothing.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import map_texts
from rankweave.session import at_most, broadcast_if_small, stored

WORD = re.compile(r"[^\W_]+")
# Edits allowed for each hundred words of an item.
PERCENT = 20
# Items with fewer words have no edits and are found by one key of all their words.
LEAST_WORDS = 5
# Target share of the items with as many edits as allowed, of any kind, that are found.
RECALL = 0.99
# Walks, keys for each beginning of a walk, and positions sampled for each key.
WALKS, KEYS, SAMPLED = 24, 6, 3
# Steps of the shortest beginning, at least; each is half of the next.
SHORTEST = 8
# Steps of a walk for each word of a window: it should not walk out of the item.
STEPS = 1.6
# Ratio of the lengths of two neighbouring classes.
CLASS_RATIO = 1.12
# Distinct words of all items that are sent to the tasks (about 100 bytes each); beyond,
# words are hashed one by one and every window is walked.
VOCABULARY = 500_000
# Item keys up to this number are broadcast (about 40 bytes each), and windows' other keys
# are left out where they are made; beyond, all keys of the windows are joined.
BROADCAST_KEYS = 1_000_000
# Slots, as bits of a key, of the table that tells most other keys at once.
SLOT_BITS = 24
# Texts, and windows, that are held at once.
TEXTS, WINDOWS = 256, 2_048
# Bytes of the words that walks have written, held at once.
WRITTEN = 8 << 20

STRANGER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def symbol(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) | 1


def pair(stream: np.ndarray) -> np.ndarray:
    """A code of each two neighbouring symbols."""
    return (stream[:-1] ^ stream[:-1] >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93) + stream[1:]


def pair_table(twos: list[tuple[list[str], int, list[int]]], bases: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted codes of pairs of words, the most times that an item has each, and in which classes."""
    codes, inside = np.zeros(len(twos), np.uint64), np.zeros((len(twos), len(bases)), bool)
    for i, (words, _, own) in enumerate(twos):
        codes[i] = pair(np.array([symbol(w) for w in words], np.uint64))[0]
        inside[i, [bases.index(b) for b in own]] = True
    order = np.argsort(codes)
    return codes[order], np.array([t for _, t, _ in twos], np.int64)[order], inside[order]


def class_of(words: int) -> int:
    """Words of the windows that items of this many words are compared with."""
    if words < LEAST_WORDS:
        return words
    base = float(LEAST_WORDS)
    while base * CLASS_RATIO <= words:
        base *= CLASS_RATIO
    return int(base)


def edits(words: int) -> int:
    return words * PERCENT // 100


def longest_of(base: int) -> int:
    """The most words of an item in a class."""
    words = base
    while class_of(words + 1) == base:
        words += 1
    return words


def beginnings(base: int) -> list[int]:
    """Steps of a walk of a class, then of its shorter beginnings."""
    steps = [max(SAMPLED, int(base * STEPS))]
    while steps[-1] // 2 >= SHORTEST:
        steps.append(steps[-1] // 2)
    return steps


def mixed(value: np.ndarray, word: np.ndarray) -> np.ndarray:
    value = (value ^ word) * np.uint64(0xD6E8FEB86659FD93)
    return value ^ value >> np.uint64(32)


def walk_keys(stream: np.ndarray, starts: np.ndarray, base: int) -> np.ndarray:
    """The keys of the windows of a symbol stream that begin at ``starts``, a row for each.

    The stream must go on for the steps of a walk behind each start.
    """
    if base < LEAST_WORDS:
        value = np.full(len(starts), base * 4096, np.uint64)
        for step in range(base):
            value = mixed(value, stream[starts + step])
        return value[:, None]
    parts = np.repeat(beginnings(base), KEYS)
    steps = parts[0]
    random = np.random.Generator(np.random.PCG64(base))
    bits, sampled = np.empty((steps, WALKS, 1), np.uint64), np.empty((WALKS, len(parts), SAMPLED), np.int64)
    for walk in range(WALKS):
        bits[:, walk, 0] = random.integers(0, 1 << 63, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for number, part in enumerate(parts):
            sampled[walk, number] = np.sort(random.choice(part, SAMPLED, replace=False))
    numbers = np.arange(base * 4096, base * 4096 + WALKS * len(parts), dtype=np.uint64)
    out = np.empty((len(starts), len(numbers)), np.uint64)
    walks = np.arange(WALKS)[:, None]
    # All walks of some windows at once.
    some = max(1, WRITTEN // (8 * steps * WALKS))
    for low in range(0, len(starts), some):
        own = starts[low : low + some]
        at, written = np.tile(own, (WALKS, 1)), np.empty((steps, WALKS, len(own)), np.uint64)
        for step in range(steps):
            word = np.take(stream, at, out=written[step])
            at += (word * bits[step] >> np.uint64(63)).view(np.int64)
        value = np.broadcast_to(numbers.reshape(WALKS, -1, 1), (*sampled.shape[:2], len(own)))
        for nth in range(SAMPLED):
            value = mixed(value, written[sampled[:, :, nth], walks])
        out[low : low + some] = value.reshape(len(numbers), -1).T
    return out


def prefix_distance(item: list[str], region: list[str]) -> tuple[int, int]:
    """Least edit distance of ``item`` to a beginning of ``region``, and that beginning's words.

    Bit-parallel: the differences of a column of the edit matrix are the bits of two
    numbers, so a word of the region costs a few operations on integers.
    """
    size, masks = len(item), {}
    for i, word in enumerate(item):
        masks[word] = masks.get(word, 0) | 1 << i
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score = full, 0, size
    best = (size, 0)
    for n, word in enumerate(region, 1):
        match = masks.get(word, 0)
        across = ((match & up) + up ^ up) | match | down
        right, left = down | ~(across | up) & full, up & across
        score += bool(right & top) - bool(left & top)
        right, left = right << 1 | 1, left << 1
        up, down = (left | ~(across | down | right)) & full, right & (across | down) & full
        if score < best[0]:
            best = (score, n)
    return best


def leaks(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(key, text_hash, item, start_word, end_word, distance, similarity), best place of each.

    An item of n words leaks into a text if some run of the text's words is within
    n * ``PERCENT`` / 100 word edits of it. There is one row for each (key, text, item) that
    does: the place with the least distance, then the first; repeated rows give it once.
    Null texts hold nothing; null items and those without words take no part; items under
    ``LEAST_WORDS`` words have no edits, so only their exact words are found;
    null keys are kept. Clean texts have no row, and neither has an empty table.
    """
    spark = docs.sparkSession
    coded = stored(_items(items, item, item_text), "items")
    bases = sorted(r["base"] for r in coded.select("base").distinct().collect())
    vocabulary = coded.select(F.explode(F.split("words", " ")).alias("w")).distinct()
    known = neighbours = None
    if at_most(vocabulary, VOCABULARY):
        known = {r["w"]: symbol(r["w"]) for r in vocabulary.toLocalIterator()}
        words = F.split("words", " ")
        twos = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.slice(words, i, 2))
        # Of each pair, the most times that an item has it, and the classes of its items.
        twos = coded.where(F.size(words) > 1).select("item", "words", "base", F.explode(twos).alias("two")).groupBy("item", "words", "base", "two").count()
        twos = twos.groupBy("two").agg(F.max("count").alias("times"), F.collect_set("base").alias("bases"))
        if at_most(twos, VOCABULARY):
            neighbours = pair_table([(r["two"], r["times"], r["bases"]) for r in twos.toLocalIterator()], bases)
    keys = coded.select("item", "base", F.explode("keys").alias("k")).distinct()
    few, asked_for = at_most(keys, BROADCAST_KEYS), None
    if few:
        rows = keys.select("k").distinct().toLocalIterator()
        asked_for = np.sort(np.fromiter((r["k"] for r in rows), np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast((known, neighbours, bases, asked_for))

    read = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    windows = map_texts(
        read,
        ["id", "text_hash"],
        "text",
        {"base": "int", "start": "long", "region": "string", "keys": "array<long>"},
        lambda: _windows(*shared.value),
    )
    windows = stored(windows, "windows")
    asked = windows.select("id", "text_hash", "base", "start", F.explode("keys").alias("k"))
    side = F.broadcast(keys) if few else keys
    pairs = asked.join(side, ["base", "k"]).select("id", "text_hash", "base", "start", "item").distinct()
    place = windows.select(
        F.col("id").alias("w_id"), F.col("text_hash").alias("w_hash"), F.col("base").alias("w_base"), F.col("start").alias("w_start"), "region"
    ).distinct()
    candidates = (
        pairs.join(
            place,
            F.col("id").eqNullSafe(F.col("w_id"))
            & (F.col("text_hash") == F.col("w_hash"))
            & (F.col("base") == F.col("w_base"))
            & (F.col("start") == F.col("w_start")),
        )
        .join(coded.select(F.col("item").alias("i_item"), F.col("words").alias("item_words")).distinct(), F.col("item").eqNullSafe(F.col("i_item")))
        .select("id", "text_hash", "item", "start", F.concat_ws("\n", "item_words", "region").alias("both"))
    )

    def verifier():
        def verify(texts):
            at, ends, distances, similarities = [], [], [], []
            for row, both in enumerate(texts):
                said, region = (part.split(" ") for part in both.split("\n"))
                distance, length = prefix_distance(said, region)
                if distance <= edits(len(said)):
                    at.append(row)
                    ends.append(length)
                    distances.append(distance)
                    similarities.append(1 - distance / len(said))
            return at, [ends, distances, similarities]

        return verify

    held = map_texts(
        candidates, ["id", "text_hash", "item", "start"], "both", {"length": "long", "distance": "int", "similarity": "double"}, verifier
    )
    best = held.groupBy("id", "text_hash", "item").agg(
        F.min(F.struct("distance", "start", "length", "similarity")).alias("b")
    )
    return best.select(
        F.col("id").alias(key),
        "text_hash",
        F.col("item").alias(item),
        F.col("b.start").alias("start_word"),
        (F.col("b.start") + F.col("b.length")).alias("end_word"),
        F.col("b.distance").alias("distance"),
        F.col("b.similarity").alias("similarity"),
    )


def without_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item."""
    found = leaks(docs, items, key, text, **names).select(F.col(key).alias("__key"), F.col("text_hash").alias("__hash")).distinct()
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.xxhash64(text) == F.col("__hash"))
    return docs.join(broadcast_if_small(stored(found, "leaks")), same, "left_anti")


def _items(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, words, base, keys) of every item that takes part."""

    def start():
        def work(texts):
            at, joined, bases, keys = [], [], [], []
            for row, said in enumerate(texts):
                words = words_of(said)
                if not words:
                    continue
                base = class_of(len(words))
                stream = np.full(len(words) + int(base * STEPS) + SAMPLED, STRANGER)
                stream[: len(words)] = [symbol(w) for w in words]
                at.append(row)
                joined.append(" ".join(words))
                bases.append(base)
                keys.append(walk_keys(stream, np.zeros(1, np.int64), base)[0].view(np.int64))
            return at, [joined, bases, keys]

        return work

    named = items.select(F.col(item).alias("item"), F.col(text).alias("text"))
    return map_texts(named, ["item"], "text", {"words": "string", "base": "int", "keys": "array<long>"}, start)


def _windows(known: dict[str, int] | None, neighbours: tuple | None, bases: list[int], asked_for: np.ndarray | None):
    """A function that gives the windows of texts in which an item may begin, part by part.

    With ``asked_for``, the sorted keys of the items, only these keys and windows that have one.
    """
    slots = None
    if asked_for is not None:
        slots = np.zeros(1 << SLOT_BITS, bool)
        slots[asked_for >> np.uint64(64 - SLOT_BITS)] = True
    reach = {base: longest_of(base) for base in bases}
    gap = int(max(bases, default=1) * STEPS) + SAMPLED

    def work(texts):
        for low in range(0, len(texts), TEXTS):
            words = [words_of(t) for t in texts[low : low + TEXTS]]
            first = np.concatenate([[0], np.cumsum([len(w) + gap for w in words])])
            stream = np.full(first[-1], STRANGER)
            for begin, own in zip(first, words):
                coded = [symbol(w) for w in own] if known is None else list(map(known.get, own, [int(STRANGER)] * len(own)))
                stream[begin : begin + len(own)] = coded
            pairs = None if neighbours is None else _paired(stream, *neighbours[:2])
            sums = None if known is None else np.concatenate([[0], np.cumsum(stream != STRANGER)])
            for number, base in enumerate(bases):
                mine = None if pairs is None else tuple(x[neighbours[2][pairs[2], number]] for x in pairs[:2])
                starts = _starts(len(stream), mine, sums, base, edits(reach[base]), gap)
                owner = np.searchsorted(first, starts, "right") - 1
                inside = starts - first[owner] < first[owner + 1] - first[owner] - gap
                starts, owner = starts[inside], owner[inside]
                if slots is not None and base < LEAST_WORDS:
                    exact, _ = _asked(walk_keys(stream, starts, base), slots, asked_for)
                    starts, owner = starts[exact], owner[exact]
                span = reach[base] + edits(reach[base])
                # Equal windows of a text have equal keys and distances: the first stands for all.
                seen: set[tuple[int, int]] = set()
                for i in range(0, len(starts), WINDOWS):
                    rows, places, regions = [], [], []
                    for start, row in zip(starts[i : i + WINDOWS].tolist(), owner[i : i + WINDOWS].tolist()):
                        at = start - int(first[row])
                        region = " ".join(words[row][at : at + span])
                        mark = (row, symbol(region))
                        if mark not in seen:
                            seen.add(mark)
                            rows.append(row)
                            places.append(at)
                            regions.append(region)
                    if rows:
                        rows = np.array(rows)
                        keys = walk_keys(stream, first[rows] + np.array(places), base)
                        if slots is None:
                            yield rows + low, ([base] * len(places), places, regions, list(keys.view(np.int64)))
                            continue
                        having, mine = _asked(keys, slots, asked_for)
                        yield rows[having] + low, (
                            [base] * len(having), [places[h] for h in having], [regions[h] for h in having], mine
                        )

    return work


def _asked(keys: np.ndarray, slots: np.ndarray, asked_for: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows with a key of ``asked_for``, and such keys of each."""
    row, column = np.nonzero(slots[keys >> np.uint64(64 - SLOT_BITS)])
    value = keys[row, column]
    at = np.minimum(np.searchsorted(asked_for, value), max(len(asked_for) - 1, 0))
    real = asked_for[at] == value if len(asked_for) else np.zeros(len(value), bool)
    having, begins = np.unique(row[real], return_index=True)
    return having, np.split(value[real].view(np.int64), begins[1:]) if len(having) else []


def _starts(
    length: int, pairs: tuple[np.ndarray, np.ndarray] | None, sums: np.ndarray | None, base: int, most: int, gap: int
) -> np.ndarray:
    """The positions at which a window is within reach of some item, as far as counts tell.

    ``sums`` counts the known words before each position of a stream of this length.
    """
    size = length - gap
    if sums is None:
        return np.arange(size)
    near = sums[base : base + size] - sums[:size] >= base - most
    if pairs is not None:
        # A pair at j counts in the windows that have it, but not its like of before.
        at, before = pairs
        low = np.maximum(np.maximum(before + 1, at - base + 2), 0)
        counts = np.cumsum(np.bincount(low, minlength=length + 1) - np.bincount(at + 1, minlength=length + 1))
        near &= counts[:size] >= base - 1 - 2 * most
    return np.flatnonzero(near)


def _paired(stream: np.ndarray, codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of items' pairs, for each that of the like that is one too many, and its number.

    The like is the same pair's occurrence as many places before as an item may have it;
    -1 where there is none.
    """
    ours = stream != STRANGER
    at = np.flatnonzero(ours[:-1] & ours[1:])
    if not len(codes) or not len(at):
        return (np.zeros(0, np.int64),) * 3
    number = np.minimum(np.searchsorted(codes, found := pair(stream)[at]), len(codes) - 1)
    at, number = at[codes[number] == found], number[codes[number] == found]
    order = np.argsort(number, kind="stable")
    kind, place = number[order], at[order]
    back = np.arange(len(order)) - times[kind]
    same = (back >= 0) & (kind[np.maximum(back, 0)] == kind)
    before = np.empty(len(order), np.int64)
    before[order] = np.where(same, place[np.maximum(back, 0)], -1)
    return at, before, number
