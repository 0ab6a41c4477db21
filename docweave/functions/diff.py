"""Token-level text differences, and moves: sequential steps that run as Arrow functions, one call per batch."""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPANS = "array<struct<op:string,b_start:int,b_len:int,c_start:int,c_len:int,old:string,new:string>>"
SPAN_LIST = T.ArrayType(T.StructType([T.StructField(n, T.StringType() if n in ("op", "old", "new") else T.IntegerType()) for n in ("op", "b_start", "b_len", "c_start", "c_len", "old", "new")]))
_SPAN_TYPE = pa.list_(pa.struct([("op", pa.string()), ("b_start", pa.int32()), ("b_len", pa.int32()), ("c_start", pa.int32()), ("c_len", pa.int32()), ("old", pa.string()), ("new", pa.string())]))

_IDEOGRAPH = "㐀-䶿一-鿿豈-﫿"


def _tokenizer():
    import regex

    word = f"[\\p{{L}}--[{_IDEOGRAPH}]][\\p{{L}}\\p{{Mn}}\\p{{Mc}}]*"
    return regex.compile(f"[{_IDEOGRAPH}]|{word}|\\p{{Nd}}[\\p{{Nd}}.,%％]*|\\s+|.", regex.V1 | regex.DOTALL)


_compiled = None


def tokens(text: str) -> list[str]:
    """CJK characters, words with their marks, numbers with ``.,%``, runs of white space, other characters."""
    global _compiled
    if _compiled is None:
        _compiled = _tokenizer()
    return _compiled.findall(text)


def _utf16(text: str) -> int:
    return len(text) + sum(c > "￿" for c in text)


def _common_lengths(a: list[int], b: list[int]) -> list[int]:
    """Bit-parallel suffix LCS: row i packs, over j, where the LCS of a[i:] and b[j:] grows; differences of neighbours suffice for the walk."""
    n = len(b)
    places: dict[int, int] = {}
    for j, x in enumerate(reversed(b)):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << n) - 1
    state, rows = full, [full]
    for x in reversed(a):
        here = state & places.get(x, 0)
        state = ((state + here) | (state - here)) & full
        rows.append(state)
    rows.reverse()
    return rows


def text_diff(old: str, new: str) -> list[dict]:
    """Edit spans between two texts: adjoining insertions and deletions are one span; offsets are UTF-16 code units.

    Walks both token lists from the front: equal tokens match; else the token of ``new`` is
    inserted if that leaves at least as long a common subsequence, otherwise that of ``old``
    is deleted.
    """
    if old == new:
        return []
    a, b = tokens(old), tokens(new)
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    start = sum(map(_utf16, a[:head]))
    ids: dict[str, int] = {}
    x = [ids.setdefault(t, len(ids)) for t in a[head:]]
    y = [ids.setdefault(t, len(ids)) for t in b[head:]]
    rows = _common_lengths(x, y)
    n = len(y)
    def length(i: int, j: int) -> int:
        # zero bits of row i among the last n - j places
        width = n - j
        return width - (rows[i] & ((1 << width) - 1)).bit_count()

    spans, i, j = [], 0, 0
    at_b = at_c = start
    first = (start, start)
    gone: list[str] = []
    come: list[str] = []

    def flush() -> None:
        if gone or come:
            before, after = "".join(gone), "".join(come)
            spans.append({"op": "Replace" if gone and come else "Insert" if come else "Delete", "b_start": first[0], "b_len": _utf16(before), "c_start": first[1], "c_len": _utf16(after), "old": before, "new": after})
            gone.clear()
            come.clear()

    while i < len(x) or j < n:
        if i < len(x) and j < n and x[i] == y[j]:
            flush()
            at_b += _utf16(a[head + i])
            at_c += _utf16(b[head + j])
            i, j = i + 1, j + 1
            continue
        if not gone and not come:
            first = (at_b, at_c)
        if j < n and (i == len(x) or length(i, j + 1) >= length(i + 1, j)):
            come.append(b[head + j])
            at_c += _utf16(b[head + j])
            j += 1
        else:
            gone.append(a[head + i])
            at_b += _utf16(a[head + i])
            i += 1
    flush()
    return spans


@F.arrow_udf(SPAN_LIST)
def diff_spans(old: pa.Array, new: pa.Array) -> pa.Array:
    """``text_diff`` of two columns, once for equal rows of a batch; null if either is null."""
    rows = list(zip(old.to_pylist(), new.to_pylist(), strict=True))
    found = {(o, n): None if o is None or n is None else text_diff(o, n) for o, n in set(rows)}
    return pa.array([found[r] for r in rows], _SPAN_TYPE)


def stable_positions(values: list[int]) -> list[bool]:
    """Members of the longest strictly increasing subsequence that patience sorting with back pointers finds (last tail, latest predecessor)."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(values)
    for k, v in enumerate(values):
        place = bisect.bisect_left(ends, v)
        if place:
            back[k] = tails[place - 1]
        if place == len(tails):
            tails.append(k)
            ends.append(v)
        else:
            tails[place], ends[place] = k, v
    out = [False] * len(values)
    k = tails[-1] if tails else -1
    while k >= 0:
        out[k] = True
        k = back[k]
    return out


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def stable(positions: pa.Array) -> pa.Array:
    return pa.array([None if p is None else stable_positions(p) for p in positions.to_pylist()], pa.list_(pa.bool_()))


def apply_spans(old: str, spans: list[dict]) -> str:
    """The new text from the old one and its spans (UTF-16 offsets)."""
    raw, out, at = old.encode("utf-16-le", "surrogatepass"), b"", 0
    for s in spans:
        out += raw[2 * at : 2 * s["b_start"]] + s["new"].encode("utf-16-le", "surrogatepass")
        at = s["b_start"] + s["b_len"]
    return (out + raw[2 * at :]).decode("utf-16-le", "surrogatepass")
