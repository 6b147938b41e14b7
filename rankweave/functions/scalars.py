"""Small scalar functions: similarity, accents, ids, key/value text, paths."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that do not decompose into a base letter and marks.
PLAIN_LETTERS = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ħ": "h", "Ħ": "H", "ı": "i"}
LETTER_PAIRS = {"æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ß": "ss", "þ": "th", "Þ": "TH"}


def accent_map() -> tuple[str, str]:
    """Accented Latin, Greek and Cyrillic letters with their base letters."""
    source, target = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x0370, 0x0530), *range(0x1E00, 0x2000)]:
        letter = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", letter) if not unicodedata.combining(c))
        if len(base) == 1 and base != letter and base.isalpha():
            source.append(letter)
            target.append(base)
    for letter, base in PLAIN_LETTERS.items():
        source.append(letter)
        target.append(base)
    return "".join(source), "".join(target)


def unaccent(text: Column) -> Column:
    """Text with accents taken off its letters."""
    source, target = accent_map()
    out = F.translate(text, source, target)
    for letter, pair in LETTER_PAIRS.items():
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return out


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-case words, two blanks before and one after each."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(
            F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(padded, i, F.lit(3))
        )

    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; 1 for equal text, 0 when one side has none."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def uuidv7(ts: Column, seed: Column) -> Column:
    """Version 7 id: milliseconds of ``ts`` first, the other bits out of ``seed``."""
    time = F.lpad(F.lower(F.hex(F.unix_millis(ts))), 12, "0")
    bits = F.sha2(seed.cast("string"), 256)
    variant = F.substring(F.lit("89ab"), F.pmod(F.xxhash64(seed.cast("string")), F.lit(4)).cast("int") + 1, F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(time, 1, 8),
        F.substring(time, 9, 4),
        F.concat(F.lit("7"), F.substring(bits, 1, 3)),
        F.concat(variant, F.substring(bits, 4, 3)),
        F.substring(bits, 7, 12),
    )


def parse_hstore(text: Column) -> Column:
    """Map out of ``k=>v, "k 2"=>"v, 2", n=>NULL`` text."""
    item = r'("(?:[^"\\]|\\.)*"|[^\s,=>"]+)\s*=>\s*("(?:[^"\\]|\\.)*"|[^\s,"]+)'
    keys = F.regexp_extract_all(text, F.lit(item), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(item), F.lit(2))

    def bare(value: Column) -> Column:
        inner = F.regexp_replace(F.substring(value, F.lit(2), F.length(value) - 2), r"\\(.)", "$1")
        return F.when(value.startswith('"'), inner).otherwise(value)

    return F.map_from_arrays(
        F.transform(keys, bare),
        F.transform(values, lambda v: F.when(F.upper(v) != "NULL", bare(v))),
    )
