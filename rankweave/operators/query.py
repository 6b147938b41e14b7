"""Query combinators and what they mean on a candidate row.

A query is built from objects, not parsed from text, so any user text is data. Each
node gives two column expressions over a candidate row: whether it matches, and how
much it adds to the score. The two differ for ``Not`` (no score), ``Boost`` (no
effect on matching) and stop words (left out of the score only).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from rankweave.functions import stopwords
from rankweave.functions.text import tokens_of

K1 = 1.2
B = 0.75


class Scope:
    """Resolves terms to the columns of a candidate row."""

    def __init__(self, fields: list[str], weights: dict[str, float], numbers: dict[str, int]) -> None:
        self.fields, self.weights, self.numbers = fields, weights, numbers

    def check_field(self, name: str) -> None:
        if len(self.fields) < 2:
            raise ValueError("field syntax requires a multi-column index")
        if name not in self.fields:
            raise ValueError(f"unknown field {name!r}")

    def of(self, name: str | None) -> list[str]:
        if name is None:
            return self.fields
        self.check_field(name)
        return [name]

    def tf(self, term: str, f: str) -> Column:
        return F.col(f"tf_{self.numbers[term]}_{f}")

    def positions(self, term: str, f: str) -> Column:
        return F.col(f"pos_{self.numbers[term]}_{f}")

    def present(self, term: str, name: str | None = None) -> Column:
        out = None
        for f in self.of(name):
            hit = self.tf(term, f) > 0
            out = hit if out is None else out | hit
        return out

    def impact(self, term: str, name: str | None, stats: Column) -> Column:
        """BM25F weight of one term, ``stats`` being the collection row."""
        fields = self.of(name)
        weighted = None
        for f in fields:
            mean = stats["avg"][self.fields.index(f)]
            length = F.col(f"len_{f}")
            norm = (1 - B) + B * F.when(mean > 0, length / mean).otherwise(1.0)
            part = F.when(self.tf(term, f) > 0, self.weights[f] * self.tf(term, f) / norm).otherwise(0.0)
            weighted = part if weighted is None else weighted + part
        df = stats["df"][self.numbers[term]]
        idf = F.log(1 + (stats["n"] - df + 0.5) / (df + 0.5))
        return idf * weighted * (K1 + 1) / (K1 + weighted)


@dataclass(frozen=True)
class Query:
    """Base of all nodes."""

    def terms(self) -> Iterator[tuple[str, bool]]:
        """Every term with whether it can add to a score."""
        raise NotImplementedError

    def needs_positions(self) -> bool:
        return False

    def matches(self, scope: Scope, name: str | None = None) -> Column:
        raise NotImplementedError

    def score(self, scope: Scope, stats: Column, skip: frozenset, name: str | None = None) -> Column:
        raise NotImplementedError

    def matches_empty(self) -> bool:
        """Whether a document with none of the terms matches."""
        raise NotImplementedError


@dataclass(frozen=True)
class Term(Query):
    """One analysed term."""

    term: str

    def terms(self):
        yield self.term, True

    def matches(self, scope, name=None):
        return scope.present(self.term, name)

    def score(self, scope, stats, skip, name=None):
        return F.lit(0.0) if self.term in skip else scope.impact(self.term, name, stats)

    def matches_empty(self):
        return False


class _Several(Query):
    def __init__(self, *parts: Query | str) -> None:
        if not parts:
            raise ValueError(f"{type(self).__name__} needs at least one part")
        object.__setattr__(self, "parts", tuple(Term(p) if isinstance(p, str) else p for p in parts))

    def terms(self):
        for part in self.parts:
            yield from part.terms()

    def needs_positions(self):
        return any(part.needs_positions() for part in self.parts)

    def score(self, scope, stats, skip, name=None):
        total = F.lit(0.0)
        for part in self.parts:
            total = total + part.score(scope, stats, skip, name)
        return F.when(self.matches(scope, name), total).otherwise(0.0)


class And(_Several):
    """All parts match."""

    def matches(self, scope, name=None):
        out = self.parts[0].matches(scope, name)
        for part in self.parts[1:]:
            out = out & part.matches(scope, name)
        return out

    def matches_empty(self):
        return all(part.matches_empty() for part in self.parts)


class Or(_Several):
    """At least one part matches."""

    def matches(self, scope, name=None):
        out = self.parts[0].matches(scope, name)
        for part in self.parts[1:]:
            out = out | part.matches(scope, name)
        return out

    def matches_empty(self):
        return any(part.matches_empty() for part in self.parts)


@dataclass(frozen=True, init=False)
class Not(Query):
    """The part does not match; adds nothing to the score."""

    part: Query

    def __init__(self, part: Query | str) -> None:
        object.__setattr__(self, "part", Term(part) if isinstance(part, str) else part)

    def terms(self):
        for term, _ in self.part.terms():
            yield term, False

    def needs_positions(self):
        return self.part.needs_positions()

    def matches(self, scope, name=None):
        return ~self.part.matches(scope, name)

    def score(self, scope, stats, skip, name=None):
        return F.lit(0.0)

    def matches_empty(self):
        return not self.part.matches_empty()


class _Positional(Query):
    def needs_positions(self):
        return True

    def matches_empty(self):
        return False

    def _holds(self, scope: Scope, f: str) -> Column:
        raise NotImplementedError

    def matches(self, scope, name=None):
        out = None
        for f in scope.of(name):
            one = self._holds(scope, f)
            out = one if out is None else out | one
        return out

    def score(self, scope, stats, skip, name=None):
        total = F.lit(0.0)
        for term in dict.fromkeys(t for t, _ in self.terms()):
            if term not in skip:
                total = total + scope.impact(term, name, stats)
        return F.when(self.matches(scope, name), total).otherwise(0.0)


def _shifted(positions: Column, offset: int) -> Column:
    return F.transform(positions, lambda p: p - offset)


class Phrase(_Positional):
    """The terms next to each other, in this order, in one field."""

    def __init__(self, *words: str) -> None:
        if not words:
            raise ValueError("Phrase needs at least one term")
        object.__setattr__(self, "words", tuple(words))

    def terms(self):
        for word in self.words:
            yield word, True

    def _holds(self, scope, f):
        starts = scope.positions(self.words[0], f)
        for offset, word in enumerate(self.words[1:], start=1):
            starts = F.array_intersect(starts, _shifted(scope.positions(word, f), offset))
        return F.size(starts) > 0


def _within(first: Column, second: Column, k: int, ordered: bool) -> Column:
    """Whether some positions of the two lists are at most ``k`` apart.

    The lists are merged by position and folded once, keeping the last position of
    each: the closest pair is always next to each other in the merged order.
    """
    far = F.lit(-(2**30))
    # With equal positions the second term goes first, so a pair is truly ordered.
    merged = F.array_sort(
        F.concat(
            F.transform(first, lambda p: F.struct(p.alias("p"), F.lit(1).alias("first"))),
            F.transform(second, lambda p: F.struct(p.alias("p"), F.lit(0).alias("first"))),
        )
    )

    def step(acc: Column, e: Column) -> Column:
        is_first = e["first"] == 1
        hit = ~is_first & (e["p"] - acc["a"] <= k)
        if not ordered:
            hit = hit | (is_first & (e["p"] - acc["b"] <= k))
        return F.struct(
            F.when(is_first, e["p"]).otherwise(acc["a"]).alias("a"),
            F.when(is_first, acc["b"]).otherwise(e["p"]).alias("b"),
            (acc["hit"] | hit).alias("hit"),
        )

    start = F.struct(far.alias("a"), far.alias("b"), F.lit(False).alias("hit"))
    return F.aggregate(merged, start, step, lambda acc: acc["hit"])


class Near(_Positional):
    """Both terms in one field, at most ``k`` positions apart, in either order."""

    ordered = False

    def __init__(self, first: str, second: str, k: int) -> None:
        if isinstance(k, bool) or not isinstance(k, int) or k < 1:
            raise ValueError(f"k must be an integer >= 1, got {k!r}")
        object.__setattr__(self, "pair", (first, second))
        object.__setattr__(self, "k", k)

    def terms(self):
        for word in self.pair:
            yield word, True

    def _holds(self, scope, f):
        return _within(
            scope.positions(self.pair[0], f), scope.positions(self.pair[1], f), self.k, self.ordered
        )


class Then(Near):
    """The second term after the first, at most ``k`` positions on."""

    ordered = True


@dataclass(frozen=True, init=False)
class Boost(Query):
    """Multiplies the score of a part and leaves the match alone."""

    part: Query
    factor: float

    def __init__(self, part: Query | str, factor: float) -> None:
        object.__setattr__(self, "part", Term(part) if isinstance(part, str) else part)
        object.__setattr__(self, "factor", float(factor))

    def terms(self):
        yield from self.part.terms()

    def needs_positions(self):
        return self.part.needs_positions()

    def matches(self, scope, name=None):
        return self.part.matches(scope, name)

    def score(self, scope, stats, skip, name=None):
        return self.part.score(scope, stats, skip, name) * F.lit(self.factor)

    def matches_empty(self):
        return self.part.matches_empty()


@dataclass(frozen=True, init=False)
class Field(Query):
    """The part looked up in one field of an index over several."""

    name: str
    part: Query

    def __init__(self, name: str, part: Query | str) -> None:
        object.__setattr__(self, "name", name)
        object.__setattr__(self, "part", Term(part) if isinstance(part, str) else part)

    def terms(self):
        yield from self.part.terms()

    def needs_positions(self):
        return self.part.needs_positions()

    def matches(self, scope, name=None):
        scope.check_field(self.name)
        return self.part.matches(scope, self.name)

    def score(self, scope, stats, skip, name=None):
        scope.check_field(self.name)
        return self.part.score(scope, stats, skip, self.name)

    def matches_empty(self):
        return self.part.matches_empty()


def analyze_text(spark: SparkSession, text: str, analyzer: str, dictionary=None) -> list[str]:
    """Tokens of one short query text, by the analyzer of the index."""
    from rankweave.operators.analyze import token_arrays

    one = spark.createDataFrame([(0, text)], "id int, text string")
    if analyzer != "words":
        return list(one.select(tokens_of(F.col("text"), analyzer).alias("t")).first()["t"])
    return list(token_arrays(one, "id", "text", analyzer, dictionary).first()["tokens"])


def analyze_query(
    spark: SparkSession, text: str, analyzer: str = "unicode", dictionary=None
) -> Query | None:
    """Plain query text: chunks between blanks must all match.

    A chunk of several tokens is a phrase. None when the text has no token.
    """
    chunks = [analyze_text(spark, chunk, analyzer, dictionary) for chunk in text.split()]
    parts: list[Query] = [
        Term(tokens[0]) if len(tokens) == 1 else Phrase(*tokens) for tokens in chunks if tokens
    ]
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else And(*parts)


def plain_terms(
    spark: SparkSession, text: str, analyzer: str, dictionary=None, preset: str = "auto"
) -> Query | None:
    """Plain text with its stop words dropped and the other tokens all required."""
    stops = set(stopwords.words(preset))
    kept = [t for t in analyze_text(spark, text, analyzer, dictionary) if t not in stops]
    if not kept:
        return None
    return Term(kept[0]) if len(kept) == 1 else And(*kept)
