"""HTML preview sink: paragraphs as an article."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and their entities; the ampersand first.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def escape(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)


def article(paragraphs: Column) -> Column:
    """``<article><p>..</p>..</article>`` of the paragraphs that are not empty."""
    return F.concat(F.lit("<article>"), F.array_join(F.transform(F.filter(paragraphs, lambda p: p != ""), lambda p: F.concat(F.lit("<p>"), escape(p), F.lit("</p>"))), ""), F.lit("</article>"))
