"""Homomorphic fingerprints of documents: sums of wide vectors hashed from paragraphs.

A paragraph is a stretch between line breaks that is not empty. Its vector has

* ``WIDE`` numbers cut from its SHA-256, added modulo 2^32: for equality;
* ``SIGNS`` numbers, each the sum of +1 or -1 for every sentence of the paragraph, by a bit
  of the sentence's SHA-256, added modulo 2^16: for likeness.

A document's fingerprint is the sum over its paragraphs, so it does not depend on their
order, and paragraphs are put in or taken out by adding or subtracting their fingerprint.
The scalar product of two vectors of signs estimates, per number, how many sentences the
documents share.

Everything is a column expression; no Python runs on executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.session import running_total, stored

WIDE, WORDS, BITS = 8, 4, 60
SIGNS = WORDS * BITS
# Four counters of 15 bits share a long while the bits of so many sentences are added up.
FIELD = BITS // 4
CHUNK = (1 << FIELD) - 1
_MASK = sum(1 << FIELD * i for i in range(4))


def _pieces(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern), lambda x: x != "")


def paragraphs(text: Column) -> Column:
    """The stretches of a text between its line breaks, but for empty ones."""
    return _pieces(text, r"[\n\r]")


def sentences(text: Column) -> Column:
    """The stretches between line breaks and closing marks, but for blank ones, without blanks at their ends."""
    return F.filter(F.transform(F.split(text, r"[\n\r.!?]"), lambda x: F.btrim(x, F.lit(" \t"))), lambda x: x != "")


def _number(digits: Column, first: int, count: int) -> Column:
    return F.conv(F.substring(digits, first, count), 16, 10).cast("long")


def fingerprint(text: Column) -> Column:
    """array<long> of ``WIDE`` + ``SIGNS`` numbers; NULL and empty texts have zeros.

    Numbers are reduced: the first to [0, 2^32), the others to [-2^15, 2^15).
    """
    zero = F.lit(0).cast("long")
    steps = F.sequence(F.lit(0), F.lit(FIELD - 1))

    def wide(rows: Column) -> Column:
        def total(i: int) -> Column:
            return F.aggregate(rows, zero, lambda so_far, row: (so_far + row[i]) % 2**32)

        return F.array(*map(total, range(WIDE)))

    def signs(digests: Column) -> Column:
        count = F.size(digests).cast("long")

        def of_word(word: int) -> Column:
            def sums(bits: Column) -> Column:
                cuts = F.sequence(F.lit(0), F.floor(F.size(bits) / CHUNK).cast("int"))
                return _with(F.transform(cuts, lambda c: F.slice(bits, c * CHUNK + 1, CHUNK)), of_chunks)

            def of_chunks(chunks: Column) -> Column:
                def four(j: Column) -> Column:
                    def packed(chunk: Column) -> Column:
                        return F.aggregate(chunk, zero, lambda so_far, b: so_far + F.call_function("shiftright", b, j).bitwiseAND(F.lit(_MASK)))

                    def unpacked(sums: Column) -> Column:
                        def ones(i: int) -> Column:
                            return F.aggregate(sums, zero, lambda so_far, s: so_far + F.shiftright(s, FIELD * i).bitwiseAND(F.lit(CHUNK)))

                        return F.array(*[_signed(2 * ones(i) - count) for i in range(4)])

                    return _with(F.transform(chunks, packed), unpacked)

                return F.flatten(F.transform(steps, four))

            return _with(F.transform(digests, lambda d: _number(d, 1 + 15 * word, BITS // 4)), sums)

        return F.concat(*map(of_word, range(WORDS)))

    def both(text: Column) -> Column:
        rows = F.transform(paragraphs(text), lambda p: _with(F.sha2(p, 256), lambda d: F.array(*[_number(d, 1 + 8 * i, 8) for i in range(WIDE)])))
        return F.concat(_with(rows, wide), _with(F.transform(sentences(text), lambda s: F.sha2(s, 256)), signs))

    return _with(F.coalesce(text, F.lit("")), both)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands there."""
    return F.transform(F.array(value), use)[0]


def _signed(x: Column) -> Column:
    """Modulo 2^16, between -2^15 and 2^15."""
    return F.pmod(x + 2**15, F.lit(2**16)) - 2**15


def _combined(left: Column, right: Column, sign: int) -> Column:
    sums = F.zip_with(left, right, lambda a, b: a + sign * b)
    return F.transform(sums, lambda x, i: F.when(i < WIDE, F.pmod(x, F.lit(2**32))).otherwise(_signed(x)))


def added(left: Column, right: Column) -> Column:
    """The fingerprint of both documents' paragraphs together."""
    return _combined(left, right, 1)


def removed(left: Column, right: Column) -> Column:
    """The fingerprint of the first document without the second one's paragraphs."""
    return _combined(left, right, -1)


def likeness(left: Column, right: Column) -> Column:
    """0 to 1: shared sentences by the mean of both numbers of sentences, as estimated; 1 for equal fingerprints.

    Unrelated documents are near 0, with a standard deviation of 1 / sqrt(SIGNS) = 0.06.
    """

    def product(a, b):
        signs = F.zip_with(F.slice(a, WIDE + 1, SIGNS), F.slice(b, WIDE + 1, SIGNS), lambda x, y: x * y)
        return F.aggregate(signs, F.lit(0).cast("long"), lambda total, x: total + x)

    both = product(left, left) + product(right, right)
    near = F.greatest(F.lit(0.0), 2 * product(left, right) / F.nullif(both, F.lit(0).cast("long")).cast("double"))
    return F.when(left == right, F.lit(1.0)).otherwise(F.coalesce(near, F.lit(0.0)))


def encoded(print_: Column) -> Column:
    """Lowercase hex: 8 digits for each of the first numbers, 4 for each sign."""
    digits = F.transform(print_, lambda x, i: F.when(i < WIDE, F.lpad(F.hex(x), 8, "0")).otherwise(F.lpad(F.hex(F.pmod(x, F.lit(2**16))), 4, "0")))
    return F.lower(F.array_join(digits, ""))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every row; repeated rows, NULL keys and NULL texts included."""
    return docs.select(F.col(key), fingerprint(F.col(text)).alias("fingerprint"))


def dataset_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: the fingerprint of all paragraphs of a table, zeros for an empty one.

    Numbers are summed apart, so the tasks keep as many sums as a fingerprint has.
    """
    each = docs.select(F.posexplode(fingerprint(F.col(text))).alias("i", "x"))
    every = docs.sparkSession.range(WIDE + SIGNS).select(F.col("id").cast("int").alias("i"))
    sums = every.join(each.groupBy("i").agg(F.sum("x").alias("x")), "i", "left").select("i", F.coalesce("x", F.lit(0).cast("long")).alias("x"))
    whole = sums.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("x"))
    return whole.select(_combined(F.col("x"), F.transform("x", lambda x: F.lit(0).cast("long")), 1).alias("fingerprint"))


def edited_by_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, edited, next_print): every text, its last third replaced, and the next one's fingerprint.

    The next document is the one before in ascending order of (key, hash of the text), NULL
    keys first; before the first stands the last. The last floor(n / 3) of n code points
    give way to as many of the next text's first ones, or all it has. NULL texts are empty.
    Rows that repeat key and text are next to each other; a table of one row is next to
    itself. Only the borrowed beginnings and fingerprints move to another document's row.
    """
    said = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text")).withColumn("__hash", F.xxhash64("__text"))
    # Names without NULL, so the texts are dealt once for all joins.
    said = said.withColumns({"__id": F.coalesce(F.col("__key").cast("string"), F.lit("")), "__void": F.col("__key").isNull()})
    names = ["__id", "__void", "__hash"]
    ids = said.groupBy(*names).agg(F.first("__key").alias("__key"), F.max(F.length("__text")).cast("long").alias("__n"), F.count("*").alias("__copies"))
    ids = ids.select(F.lit(0).alias("__all"), *names, "__key", "__n", "__copies", F.lit(1).alias("__one"))
    order = stored(running_total(ids, ["__all"], ["__key", "__hash"], "__one", "__pos").drop("__all", "__one"), "order")
    last = order.count()
    # Each text gives its beginning to the one after it in ascending order.
    takers = order.select(
        F.when(F.col("__pos") == 1, F.lit(last)).otherwise(F.col("__pos") - 1).cast("long").alias("__pos"),
        *[F.col(c).alias(f"__to{c}") for c in names],
        F.expr("__n div 3").alias("__want"),
    )
    links = order.join(takers, "__pos").drop("__pos")
    texts = said.groupBy(*names).agg(F.first("__text").alias("__text"))
    full = texts.join(links, names)
    given = full.select(
        *[F.col(f"__to{c}").alias(c) for c in names],
        F.substring("__text", F.lit(1), F.col("__want").cast("int")).alias("__start"),
        fingerprint(F.col("__text")).alias("__next"),
    )
    met = full.select(*names, "__key", "__text", "__n", "__copies").join(given, names)
    # All copies but one are followed by a copy.
    each = met.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    cut = F.expr("__n div 3").cast("int")
    own = F.col("__copy") > 1
    start = F.when(own, F.substring("__text", F.lit(1), cut)).otherwise(F.col("__start"))
    head = F.substring("__text", F.lit(1), (F.col("__n") - cut).cast("int"))
    return each.select(
        F.col("__key").alias(key),
        F.col("__text").alias("text"),
        F.concat(head, start).alias("edited"),
        F.when(own, F.lit(None)).otherwise(F.col("__next")).alias("next_print"),
    )
