"""Reversible ignore rules over change items: a projection that hides spans and format properties, never the raw item."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Punctuation that may be ignored, structural properties that never are, and the two text patterns.
PUNCTUATION = "，。；：！？（）【】《》“”‘’、,.;:!?()[]\"'"
STRUCTURAL = ("GridSpan", "VerticalMerge", "TableStructureChanged")
PAGE_MARK = r"(?iU)^(?:第\s*\d+\s*页|Page\s+\d+|\d+\s*/\s*\d+)$"
NUMBER_PREFIX = r"(?U)^(\s*(?:\p{Nd}+[.、)]|[（(]\p{Nd}+[）)]|[①-⑳]|[A-Za-z][.)]|[一二三四五六七八九十]+、|（[一二三四五六七八九十]+）))(?=\s|\p{L}|\p{N}|$)"


@dataclass(frozen=True)
class Rules:
    punctuation: bool = False
    page_numbers: bool = False
    numbering: bool = False
    characters: str = ""
    all_formatting: bool = False
    properties: tuple[str, ...] = ()

    @property
    def empty(self) -> bool:
        return self == Rules()


def hides_format(scope: Column, name: Column, rules: Rules) -> Column:
    if rules.all_formatting:
        return ~name.isin(*STRUCTURAL)
    chosen = F.concat_ws(".", scope, name).isin(*rules.properties) if rules.properties else F.lit(False)
    return ~name.isin(*STRUCTURAL) & chosen


def hides_span(span: Column, rules: Rules, b_text: str = "b_text", c_text: str = "c_text") -> Column:
    hidden = F.lit(False)
    if rules.page_numbers:
        trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
        hidden = hidden | (trim(b_text).rlike(PAGE_MARK) & trim(c_text).rlike(PAGE_MARK))
    if rules.numbering:
        b, c = (F.length(F.regexp_extract(t, NUMBER_PREFIX, 1)) for t in (b_text, c_text))
        hidden = hidden | ((b > 0) & (c > 0) & (span["b_start"] + span["b_len"] <= b) & (span["c_start"] + span["c_len"] <= c))
    ignored = (PUNCTUATION if rules.punctuation else "") + rules.characters
    if ignored:
        rest = lambda t: F.translate(t, ignored, "")
        hidden = hidden | ((span["old"] != span["new"]) & (rest(span["old"]) == rest(span["new"])))
    return hidden


def project(changes: DataFrame, rules: Rules) -> DataFrame:
    """Items as the rules show them. An item goes if it had spans or properties, none is left, and nothing else speaks for it."""
    if rules.empty:
        return changes
    spans = F.filter("spans", lambda s: ~hides_span(s, rules))
    properties = F.filter("format.properties", lambda p: ~hides_format(F.col("format.scope"), p["property"], rules))
    had = F.size("spans") + F.coalesce(F.size("format.properties"), F.lit(0))
    out = changes.withColumns({"had": had, "new_spans": spans, "left": properties})
    out = out.withColumn("new_format", F.when(F.size("left") > 0, F.struct(F.col("format.scope").alias("scope"), F.col("left").alias("properties"))))
    nothing = (F.size("new_spans") == 0) & F.col("new_format").isNull() & (F.col("had") > 0)
    plain = ~F.col("kind").isin("ParagraphMove", "ParagraphMoveAndModify") & (F.size("revision_ids") == 0) & (F.size("comment_ids") == 0) & (F.size("codes") == 0)
    shown = out.where(~(nothing & plain))
    return shown.withColumns({"spans": F.col("new_spans"), "format": F.col("new_format")}).select(*changes.columns)
