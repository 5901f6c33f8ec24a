"""Text folding and word tokens as native column expressions."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of two or more word characters.
WORD = r"\b\w\w+\b"
NON_ASCII = r"[^\x00-\x7F]"


@functools.lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Accent tables built from the Unicode database.

    Returns the characters that fold to exactly one ASCII character, their
    replacements, and the characters that fold to several (ligatures, fractions).
    """
    single_from, single_to, several = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        plain = unicodedata.normalize("NFKD", char)
        if plain == char:
            continue
        plain = plain.encode("ascii", "ignore").decode("ascii")
        if len(plain) == 1:
            # translate() works on UTF-16 units, so only the basic plane is safe there
            if code <= 0xFFFF:
                single_from.append(char)
                single_to.append(plain)
            else:
                several[char] = plain
        elif len(plain) > 1:
            several[char] = plain
    return "".join(single_from), "".join(single_to), several


@functools.lru_cache(maxsize=1)
def _several_class() -> str:
    """A character class around the expanding characters, as a few wide ranges.

    A regex class tests its ranges one by one, so neighbours are joined; a
    character inside a range that does not expand is left alone later.
    """
    ranges: list[list[int]] = []
    for code in sorted(ord(c) for c in _fold_tables()[2]):
        if ranges and code - ranges[-1][1] <= 64:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for low, high in ranges) + "]"


def fold_text(df: DataFrame, text: str = "text", *, out: str | None = None) -> DataFrame:
    """Lower-case a text column, then strip accents down to ASCII.

    Plain ASCII rows only pay for ``lower``. Other rows are translated in the
    JVM; the few characters that expand to several letters are replaced one
    distinct character at a time. The steps are separate projections so that
    each is evaluated once per row.
    """
    out = out or text
    source, target, several = _fold_tables()
    # one literal instead of thousands keeps planning short
    pairs = "\n".join(f"{char}\t{plain}" for char, plain in several.items())
    expansions = F.str_to_map(F.lit(pairs), F.lit("\n"), F.lit("\t"))
    lowered = df.withColumn(out, F.lower(text)).withColumn(
        "_ascii", F.octet_length(out) == F.char_length(out)
    )
    expanded = F.aggregate(
        F.array_distinct(F.regexp_extract_all(out, F.lit(_several_class()), F.lit(0))),
        F.col(out),
        lambda acc, char: F.replace(acc, char, F.coalesce(F.element_at(expansions, char), char)),
    )
    folded = F.regexp_replace(F.translate(out, source, target), NON_ASCII, "")
    return (
        lowered.withColumn(out, F.when(F.col("_ascii"), F.col(out)).otherwise(expanded))
        .withColumn(out, F.when(F.col("_ascii"), F.col(out)).otherwise(folded))
        .drop("_ascii")
    )


def word_tokens(text: Column | str) -> Column:
    """All word tokens of an already folded text, in order, as an array."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
