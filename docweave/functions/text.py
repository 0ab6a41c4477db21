"""Paragraph text as columns: normal form, tokens, heading keys, similarity.

Everything but the normal form and ``bigram_codes`` is a Catalyst expression. Lengths and positions
count code points; those of spans count UTF-16 code units, and ``widened`` maps between them.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The ranges whose characters are tokens of their own.
CJK = "\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF"
# Weights of bigram, token and length similarity.
BIGRAM_WEIGHT, TOKEN_WEIGHT, LENGTH_WEIGHT = 0.45, 0.35, 0.20


# Characters that are two UTF-16 code units, and what stands for the second one.
ASTRAL, SECOND_UNIT = "[\\x{10000}-\\x{10FFFF}]", "\ue000"


def widened(text: Column) -> Column:
    """The text with a place for each UTF-16 code unit: a character of two units is followed by a filler.

    Lengths and places of the result are those of spans; ``narrowed`` takes the fillers of a
    part away again. A part that begins or ends within a character has a filler too many or
    too few; differences of texts never do.
    """
    return F.when(text.rlike(ASTRAL), F.regexp_replace(text, f"({ASTRAL})", f"$1{SECOND_UNIT}")).otherwise(text)


def narrowed(part: Column) -> Column:
    return F.when(part.rlike(ASTRAL), F.regexp_replace(part, f"({ASTRAL}){SECOND_UNIT}", "$1")).otherwise(part)


def units(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return F.length(widened(text))


# Unicode's space separators and white space; characters that are no white space but for the
# space, and that compatibility composition leaves alone in any surroundings.
SPACES = " \u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
INERT = "\\x00-\\x08\\x0E-\\x7F\\u00C0-\\u00FF\\u0400-\\u045F\\u3001\\u3002\\u4E00-\\u9FA5"
_BREAKS, _GAPS = re.compile(f"[\t{SPACES}]*\n[\t{SPACES}\n]*"), re.compile(f"[\t{SPACES}]+")


def normal(text: str) -> str:
    """Compatibility composition; line ends become LF, runs of spaces one space, runs of breaks one LF without spaces around it; ends are trimmed."""
    text = text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)
    return _GAPS.sub(" ", _BREAKS.sub("\n", text.replace("\r\n", "\n").replace("\r", "\n"))).strip(WHITE)


@F.arrow_udf(T.StringType())
def _normal(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else normal(t) for t in text.to_pylist()], pa.string())


def normalize(text: Column) -> Column:
    """``normal`` as a column; only texts that it may change travel to Python."""
    loose = ~text.rlike(f"^[{INERT}]*+\\z") | text.contains("  ") | text.startswith(" ") | text.endswith(" ")
    return F.coalesce(_normal(F.when(loose, text)), text)


def match_tokens(normal: Column) -> Column:
    """Distinct tokens in order of first occurrence: CJK characters, lower-case words of letters and digits, single other characters.

    CJK characters are set apart by spaces first: a class that excludes them is several times slower.
    """
    apart = F.regexp_replace(normal, f"([{CJK}])", " $1 ")
    found = F.regexp_extract_all(apart, F.lit("[\\p{L}\\p{Nd}]+|(?U)[^\\s\\p{L}\\p{Nd}]"), F.lit(0))
    return F.array_distinct(F.transform(F.array_distinct(found), F.lower))


def heading_key(normal: Column) -> Column:
    """The clause mark a paragraph begins with, or null."""
    article = F.regexp_extract(normal, "^(第[^条]{1,11}条)", 1)
    number = F.regexp_extract(normal, "^([\\p{Nd}.]{1,12})[ 、．]", 1)
    chinese = F.regexp_extract(normal, "^([一二三四五六七八九十百千万零〇]{1,12})、", 1)
    return F.when(article != "", article).when(number != "", F.regexp_replace(number, "\\.+$", "")).when(chinese != "", chinese)


def _grams(text: Column, width: int) -> Column:
    """All substrings of ``width`` characters, in order: the characters once, zipped with themselves shifted."""
    chars = F.split(text, "")
    count = F.greatest(F.length(text) - (width - 1), F.lit(0))
    shifted = F.arrays_zip(*(F.slice(chars, F.lit(k + 1), count).alias(str(k)) for k in range(width)))
    return F.transform(shifted, lambda x: F.concat(*(x[str(k)] for k in range(width))))


def bigrams(text: Column) -> Column:
    """The set of two-character substrings."""
    return F.array_distinct(_grams(text, 2))


@F.arrow_udf(T.ArrayType(T.LongType()))
def bigram_codes(text: pa.Array) -> pa.Array:
    """``bigrams``, each as one number made of its code points: sets of numbers are smaller, and met faster."""
    import numpy as np

    points = (np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for t in text.to_pylist())
    return pa.array([np.unique(p[:-1] << 21 | p[1:]) for p in points], pa.list_(pa.int64()))


def shingles(text: Column, width: int, most: int) -> Column:
    """The first ``most`` distinct substrings of ``width`` characters."""
    return F.slice(F.array_distinct(_grams(text, width)), 1, most)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 0 when either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Text similarity of two paragraphs, each given as ``norm``, ``tokens`` and ``bigrams``."""
    x, y = F.length(a["norm"]), F.length(b["norm"])
    both = F.size(F.array_intersect(a["bigrams"], b["bigrams"]))
    dice = F.when((x == 1) | (y == 1), (F.substring(a["norm"], 1, 1) == F.substring(b["norm"], 1, 1)).cast("double")).otherwise(2.0 * both / (F.size(a["bigrams"]) + F.size(b["bigrams"])))
    mixed = BIGRAM_WEIGHT * dice + TOKEN_WEIGHT * jaccard(a["tokens"], b["tokens"]) + LENGTH_WEIGHT * (F.least(x, y) / F.greatest(x, y))
    return F.when(a["norm"] == b["norm"], F.lit(1.0)).when((x == 0) | (y == 0), F.lit(0.0)).otherwise(mixed)
