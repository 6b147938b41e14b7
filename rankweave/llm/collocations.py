"""Phrase collocations by the stripes pattern.

A prefix keys an associative counter of next words. Tasks count the phrases of a slice of
their texts and send stripes: prefix, next words, counts. Stripes are merged elementwise by
sums, and the merged table answers everything that is asked of phrases of one length:

* an entry is an extension of the prefix with its count, a row of its own: whole stripes are
  never gathered, and entries that are not frequent are left out as soon as they are merged;
* the sum of the empty prefix's stripe, with the empty word for all words that are not
  frequent, is the number of words;
* the largest entry is the most frequent longer phrase that begins with the prefix.

Three passes count words (the empty prefix), pairs, and all longer phrases. A phrase as
frequent as asked for has frequent parts only, so pairs are counted where both words are
frequent, longer phrases where all their pairs are; a bitmap of bounded size holds the
hashes of the frequent parts. It has no false negatives, so counts of frequent phrases are
exact, whatever it lets through.

The stripes of hot prefixes, those of one place in ``HOT`` or more, are cut into ``PARTS``
by their next words, so no task has to merge the whole stripe of one. There are at most
``HOT`` such prefixes of a length.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.session import BROADCAST_ROWS, at_most, stored

# Parts of a hot prefix's stripe, by its next words, and the bound on hot prefixes.
PARTS, HOT = 16, 4096
# Words that a task counts at once, and distinct words that it remembers meanwhile: what a
# Python worker holds grows with both.
SLICE_WORDS, VOCABULARY = 1_000_000, 400_000
# Bits of the bitmap for each frequent phrase, and the bounds of its size (2^27: 16 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27
# Candidates ranked in one task before the last ranking.
RANKED = 50_000

_BREAK = b"."
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\v\f\r\t", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 10 + b" ")
# The next words of a stripe are one text, blanks between them.
_SCHEMA = "grp string, prefix string, part int, words string, counts array<long>"
_ARROW = pa.schema([("grp", pa.string()), ("prefix", pa.string()), ("part", pa.int32()), ("words", pa.string()), ("counts", pa.list_(pa.int64()))])


def _mixed(x: np.ndarray) -> np.ndarray:
    # A published 64-bit mixer.
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hash(group: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(group.encode("utf-8", "surrogatepass") + b"\0" + word)


def _phrase_hash(columns: list[np.ndarray]) -> np.ndarray:
    """Of phrases whose words' hashes stand in columns."""
    value = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        value = _mixed(value + np.uint64(0x9E3779B97F4A7C15) + column)
    return value


class _Numbers(dict):
    """Numbers of a group's words; 0 is a break."""

    def __init__(self, counter: _Counter, group: str):
        super().__init__({_BREAK: 0})
        self.counter, self.group = counter, group

    def __missing__(self, word: bytes) -> int:
        words = self.counter.words
        self[word] = number = len(words)
        words.append(word)
        self.counter.hashes.append(_word_hash(self.group, word))
        self.counter.owners.append(self.counter.group_number[self.group])
        return number


class _Counter:
    """Counts the phrases of ``sizes`` words of a slice, and gives them as stripes.

    ``bitmap`` has the frequent phrases of ``width`` words; sizes are larger.
    """

    def __init__(self, sizes: list[int], width: int, bitmap: np.ndarray | None, hot: np.ndarray):
        self.sizes, self.width, self.bitmap, self.hot = sizes, width, bitmap, hot
        self.forget()

    def forget(self) -> None:
        self.words, self.hashes, self.owners = [_BREAK], array("Q", [0]), array("q", [0])
        self.groups: list[str] = []
        self.group_number: dict[str, int] = {}
        self.numbers: dict[str, _Numbers] = {}
        self.held: list[np.ndarray] = []
        self.count = 0

    def add(self, group: str, text: str) -> None:
        if group not in self.numbers:
            self.group_number[group] = len(self.groups)
            self.groups.append(group)
            self.numbers[group] = _Numbers(self, group)
        said = text.encode("utf-8", "surrogatepass").translate(_TABLE).replace(_BREAK, b" . ").split()
        said.append(_BREAK)
        self.held.append(np.fromiter(map(self.numbers[group].__getitem__, said), np.int64, len(said)))
        self.count += len(said)

    def full(self) -> bool:
        return self.count >= SLICE_WORDS

    def stripes(self) -> Iterator[pa.RecordBatch]:
        """The stripes of what was added; then nothing is held but known words."""
        if not self.held:
            return
        # Breaks at the end, so that every place has as many next ones as are looked at.
        at = np.concatenate([*self.held, np.zeros(max(self.sizes), np.int64)])
        self.held, self.count = [], 0
        words = pa.array(self.words, pa.binary()).cast(pa.string())
        frequent, hot = self._frequent(at) if self.width else (None, None)
        for size in self.sizes:
            batch = self._of_size(at, size, frequent, hot, words)
            for begin in range(0, batch.num_rows, 20_000):
                yield batch.slice(begin, 20_000)
        if len(self.words) > VOCABULARY:
            self.forget()
        # Else the pool keeps what the largest slice took, for each of an executor's workers.
        pa.default_memory_pool().release_unused()

    def _of_size(self, at: np.ndarray, size: int, frequent: np.ndarray | None, hot: np.ndarray | None, words: pa.Array) -> pa.RecordBatch:
        if size == 1:
            rows = np.flatnonzero(at > 0)
            code, known, counted = np.array(self.owners)[at[rows]], [], at[rows]
            part = (np.array(self.hashes) % np.uint64(PARTS)).astype(np.int64)[counted]
        else:
            after = size - self.width
            ends = len(at) - size
            whole = frequent[:ends].copy()
            # The word after a prefix counts if the last words with it are frequent.
            for i in range(1, after + 1):
                whole &= frequent[i : i + ends]
            rows = np.flatnonzero(whole)
            code, known = at[rows], []
            for i in range(1, size - 1):
                values, code = np.unique(code << 32 | at[rows + i], return_inverse=True)
                known.append(values)
            counted = at[rows + size - 1]
            part = np.where(hot[rows], (np.array(self.hashes) % np.uint64(PARTS)).astype(np.int64)[counted], 0)
        keys, counts = np.unique(code << 36 | part << 32 | counted, return_counts=True)
        begins = np.flatnonzero(np.diff(keys >> 32, prepend=-1))
        nexts = words.take(pa.array(keys & 0xFFFFFFFF))
        owner, prefix = self._named(keys[begins] >> 36, known, words, size)
        offsets = np.append(begins, len(keys)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                owner,
                prefix,
                pa.array(keys[begins] >> 32 & 15, pa.int32()),
                pc.binary_join(pa.ListArray.from_arrays(offsets, nexts), " "),
                pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
            ],
            schema=_ARROW,
        )

    def _frequent(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the ``width`` words from each place on are in one piece and may be frequent; whether they are hot."""
        ends = len(at) - self.width
        columns = [at[i : i + ends] for i in range(self.width)]
        inside = np.logical_and.reduce([c > 0 for c in columns])
        hashes = np.array(self.hashes)
        hashes = _phrase_hash([hashes[c] for c in columns])
        inside &= _has(self.bitmap, hashes)
        hot = np.isin(hashes, self.hot)
        rest = np.zeros(self.width, bool)
        return np.concatenate([inside, rest]), np.concatenate([hot, rest])

    def _named(self, code: np.ndarray, known: list[np.ndarray], words: pa.Array, size: int) -> tuple[pa.Array, pa.Array]:
        """Groups and texts of prefix codes."""
        groups = pa.array(self.groups, pa.string())
        if size == 1:
            return groups.take(pa.array(code)), pa.array([""] * len(code), pa.string())
        columns = []
        for values in reversed(known):
            columns.append(values[code] & 0xFFFFFFFF)
            code = values[code] >> 32
        columns.append(code)
        texts = [words.take(pa.array(c)) for c in reversed(columns)]
        owner = groups.take(pa.array(np.array(self.owners)[code]))
        return owner, texts[0] if len(texts) == 1 else pc.binary_join_element_wise(*texts, " ")


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit numbers for each hash; ``bits`` is a power of two."""
    return hashes & np.uint64(bits - 1), (hashes >> np.uint64(32)) * np.uint64(0x9E3779B1) & np.uint64(bits - 1)


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for place in _places(hashes, len(bitmap) * 64):
        found &= (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def _hashes(rows: list[tuple[str, str]]) -> np.ndarray:
    """Of (group, phrase) pairs with equal numbers of words."""
    columns = zip(*[[_word_hash(g, w) for w in p.encode("utf-8", "surrogatepass").split(b" ")] for g, p in rows])
    return _phrase_hash([np.array(c, np.uint64) for c in columns]) if rows else np.zeros(0, np.uint64)


def _hot(phrases: DataFrame, words: int) -> np.ndarray:
    """Sorted hashes of the phrases at one of ``HOT`` places or more: at most ``HOT``."""
    found = phrases.where(F.col("f") * HOT >= words).select("grp", "phrase").collect()
    return np.sort(_hashes([tuple(r) for r in found]))


def _bitmap(phrases: DataFrame) -> np.ndarray:
    """The bitmap of (grp, phrase) rows. The driver gets at most ``MOST_BITS`` / 64 numbers."""
    bits = LEAST_BITS
    wanted = min(MOST_BITS, BITS_EACH * phrases.count())
    while bits < wanted:
        bits *= 2

    def run(batches):
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            place = np.concatenate(_places(_hashes(rows), bits))
            slot = (place >> np.uint64(6)).astype(np.int64)
            mask = (np.uint64(1) << (place & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(mask)], ["slot", "mask"])

    found = phrases.select("grp", "phrase").mapInArrow(run, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[found["slot"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64).view(np.uint64)
    return out


def stripes(said: DataFrame, sizes: list[int], least: int, width: int = 0, bitmap: np.ndarray | None = None, hot: np.ndarray | None = None) -> DataFrame:
    """(grp, prefix, word, f) of (grp, text) rows: entries of the merged stripes of ``sizes`` words.

    They are next words with counts of at least ``least``; those of single words have the sum
    of the others under the empty word, in up to ``PARTS`` rows a group. From two words on,
    ``bitmap`` tells which phrases of ``width`` words may be frequent, and the hashes ``hot``
    whose stripes, and those of what they begin, are cut into parts.
    """
    held = said.sparkSession.sparkContext.broadcast((bitmap, np.zeros(0, np.uint64) if hot is None else hot))

    def run(batches):
        counter = _Counter(sizes, width, *held.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                for group, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    counter.add(group, text)
                    if counter.full():
                        yield from counter.stripes()
        yield from counter.stripes()

    local = said.select("grp", "text").mapInArrow(run, _SCHEMA)
    keys = ["grp", "prefix", "part"]
    entries = local.repartition(*keys).select(*keys, F.explode(F.arrays_zip(F.split("words", " ").alias("words"), "counts")).alias("e"))
    merged = entries.groupBy(*keys, F.col("e.words").alias("word")).agg(F.sum("e.counts").alias("f"))
    frequent = F.col("f") >= least
    if width:
        return merged.where(frequent).select("grp", "prefix", "word", "f")
    named = merged.withColumn("word", F.when(frequent, F.col("word")).otherwise(""))
    return named.groupBy(*keys, "word").agg(F.sum("f").alias("f")).select("grp", "prefix", "word", "f")


def _extensions(merged: DataFrame) -> DataFrame:
    """(grp, prefix, phrase, f): the frequent entries of stripes as phrases."""
    whole = F.when(F.col("prefix") == "", F.col("word")).otherwise(F.concat_ws(" ", "prefix", "word"))
    return merged.where(F.col("word") != "").select("grp", "prefix", whole.alias("phrase"), "f")


def _words(first: Column, last: Column) -> Column:
    return F.array_join(F.slice("w", first, last - first + 1), " ")


def collocations(
    docs: DataFrame, group: str = "lang", text: str = "text", longest: int = 4, least: int = 30, percent: int = 80, top: int = 2000
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each group's first ``top`` phrases by score.

    Texts are lower-cased in A-Z and cut at ``.,;:!?`` and line ends into pieces, pieces at
    blanks and tabs into words. Candidates are phrases of 2 to ``longest`` words with count
    a >= ``least``. Cut after k words, a candidate has l and r, the counts of both parts,
    and scores floor(2000000 * a / (l + r)); the cut of the least score holds, the smallest
    k among equals. A candidate inside a longer one with 100 * f >= ``percent`` * a is left
    out. ``n`` counts the group's words. Equal scores go by a, then by the phrase's bytes.

    A NULL group is ``und``; NULL and empty texts hold nothing; repeated rows count each
    time; an empty table or one without candidates gives no row. The group's column is
    called ``lang`` in the result; other columns are left out, whatever their names.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words at least and are counted from one place on")
    said = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("grp"), F.col(text).alias("text"))
    first = stored(stripes(said, [1], least), "stripes")
    words = first.agg(F.sum("f")).first()[0] or 0
    singles = _extensions(first)
    second = stored(stripes(said, [2], least, 1, _bitmap(singles), _hot(singles, words)), "stripes")
    tables = [first, second]
    if longest > 2:
        pairs = _extensions(second)
        longer = stored(stripes(said, list(range(3, longest + 1)), least, 2, _bitmap(pairs), _hot(pairs, words)), "stripes")
        tables += [longer.where(F.size(F.split("prefix", " ")) == size - 1) for size in range(3, longest + 1)]
    counts = _extensions(tables[0])
    for merged in tables[1:-1]:
        counts = counts.unionByName(_extensions(merged))
    counts = counts.select("grp", F.col("phrase").alias("part"), "f")
    scored = _scored(tables[1:], counts, words)
    kept = _without_subsumed(scored, tables, percent)
    totals = tables[0].groupBy("grp").agg(F.sum("f").alias("n"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    kept = stored(kept, "candidates")
    salts = kept.count() // RANKED + 1
    first = Window.partitionBy("grp", "salt").orderBy(*order)
    last = Window.partitionBy("grp").orderBy(*order)
    ranked = (
        kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
        .withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= top)
        .withColumn("rank", F.row_number().over(last).cast("long"))
        .where(F.col("rank") <= top)
    )
    return ranked.join(totals, "grp").select(F.col("grp").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")


def _scored(tables: list[DataFrame], counts: DataFrame, words: int) -> DataFrame:
    """(grp, phrase, a, l, r, score, size) of all candidates, by their least cut.

    ``counts`` are those of their parts, of which at most ``HOT`` of a length hold one of
    ``HOT`` of all ``words`` or more.
    """
    found = None
    for merged in tables:
        own = _extensions(merged).select("grp", "phrase", F.col("f").alias("a"))
        found = own if found is None else found.unionByName(own)
    cut = found.withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    parts = F.array(
        F.struct(F.lit(True).alias("left"), _words(F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit(False).alias("left"), _words(F.col("k") + 1, F.size("w")).alias("part")),
    )
    sides = cut.select("grp", "phrase", "a", F.size("w").alias("size"), "k", F.explode(parts).alias("p")).select("grp", "phrase", "a", "size", "k", "p.*")
    # A frequent word is a part of many candidates, so the few hot parts are met where the
    # candidates are. Spark's estimate of the others is that of packed files: they are counted.
    hot = counts.where(F.col("f") * HOT >= words)
    cold = counts.where(F.col("f") * HOT < words)
    cold = F.broadcast(cold) if at_most(cold, BROADCAST_ROWS) else cold.hint("merge")
    known = sides.join(F.broadcast(hot), ["grp", "part"], "left")
    met = known.where("f IS NOT NULL").unionByName(known.where("f IS NULL").drop("f").join(cold, ["grp", "part"]))
    cuts = met.groupBy("grp", "phrase", "k").agg(
        F.first("a").alias("a"), F.first("size").alias("size"), F.sum(F.when(F.col("left"), F.col("f"))).alias("l"), F.sum(F.when(~F.col("left"), F.col("f"))).alias("r")
    )
    score = F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    best = cuts.withColumn("score", score).groupBy("grp", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("size").alias("size")
    )
    return best.select("grp", "phrase", "a", "cut.l", "cut.r", "cut.score", "size")


def _without_subsumed(scored: DataFrame, tables: list[DataFrame], percent: int) -> DataFrame:
    """Candidates that no longer one explains.

    One more word is enough to look at: whatever lies inside a candidate two words longer
    lies inside one between, which is at least as frequent.
    """
    longer = None
    for merged in tables[2:]:
        after = merged.select("grp", F.col("prefix").alias("phrase"), F.col("f").alias("over"))
        before = _extensions(merged).select("grp", F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("phrase"), F.col("f").alias("over"))
        both = after.unionByName(before)
        longer = both if longer is None else longer.unionByName(both)
    if longer is None:
        return scored
    most = longer.groupBy("grp", "phrase").agg(F.max("over").alias("over"))
    exact = "cast({} as decimal(5, 0)) * cast({} as decimal(19, 0))"
    # Both sides are already dealt by these columns.
    held = scored.join(most.hint("merge"), ["grp", "phrase"], "left")
    return held.where(f"over IS NULL OR {exact.format(100, 'over')} < {exact.format(percent, 'a')}").drop("over")
