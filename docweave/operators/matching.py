"""Paragraph matching of many document pairs at once.

Input on each side: ``pair``, ``idx`` (dense, from 0), ``norm`` and optionally ``style``,
``num_level``, ``num_text``, ``num_format``. Stages, each on what the ones before left:
same place and text; text that is unique on both sides; repeated text in order; best fuzzy
candidate. All joins carry ``pair`` in their key, so they distribute over pairs, and no
stage pairs more than a bounded number of candidates with a paragraph.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.storage import stored

# Fixed values of the matcher.
LEAST_SCORE, MARGIN, NEAR, MOST = 0.62, 0.025, 4, 32
HIGH_SCORE, REPEATED_SCORE, CONTEXT_LEAST = 0.82, 0.72, 0.5
WEIGHTS = {"text": 0.75, "position": 0.05, "style": 0.05, "structure": 0.05, "context": 0.10}
NO_STYLE, OTHER_NUMBERING = 0.35, 0.55

KEY = ["pair", "idx"]
MAPPING = ("pair", "b_idx", "c_idx", "type", "confidence", "score")


@dataclass
class Matched:
    mappings: DataFrame
    deleted: DataFrame
    inserted: DataFrame
    diagnostics: DataFrame


def features(paragraphs: DataFrame, text: str = "text") -> DataFrame:
    """Adds norm where it is missing, tokens, bigrams, heading, the neighbours' texts and the document's number of paragraphs."""
    whole = Window.partitionBy("pair").orderBy("idx")
    out = paragraphs if "norm" in paragraphs.columns else paragraphs.withColumn("norm", tx.normalize(F.coalesce(F.col(text), F.lit(""))))
    for name, kind in (("style", "string"), ("num_level", "int"), ("num_text", "string"), ("num_format", "string")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    out = out.withColumns({"prev": F.lag("norm").over(whole), "next": F.lead("norm").over(whole), "count": F.count("*").over(Window.partitionBy("pair"))})
    return _read(out)


def _read(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.withColumns({"tokens": tx.match_tokens(F.col("norm")), "bigrams": tx.bigram_codes(F.col("norm")), "heading": tx.heading_key(F.col("norm"))})


def _mapping(joined: DataFrame, kind: str, confidence: str, score: float) -> DataFrame:
    return joined.select("pair", "b_idx", "c_idx", F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"), F.lit(score).alias("score"))


def remaining(side: DataFrame, mappings: DataFrame, column: str) -> DataFrame:
    return side.join(mappings.select("pair", F.col(column).alias("idx")), KEY, "left_anti")


def equal_texts(base: DataFrame, cur: DataFrame) -> DataFrame:
    """pair, norm, same, b, c, n: the places of each text of a pair, written once for the exact stages.

    ``same`` has the places where both sides have it (same index and same normal text), ``b``
    and ``c`` the others in order, of which the first ``n`` belong together: the one of each
    side, or, if the text is repeated on the baseline side, the k-th there with the k-th of
    the other side.
    """
    none = F.lit(None).cast("int")
    places = base.select("pair", "norm", F.col("idx").alias("b"), none.alias("c")).unionByName(cur.select("pair", "norm", none.alias("b"), F.col("idx").alias("c")))
    groups = places.groupBy("pair", "norm").agg(F.sort_array(F.collect_list("b")).alias("b"), F.sort_array(F.collect_list("c")).alias("c"))
    groups = groups.withColumn("same", F.array_intersect("b", "c"))
    groups = groups.withColumns({s: F.array_except(s, "same") for s in ("b", "c")})
    both = F.least(F.size("b"), F.size("c"))
    return groups.select("pair", "norm", "same", "b", "c", F.when((F.size("b") > 1) | (F.size("c") == 1), both).otherwise(0).alias("n"))


def exact(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mappings of ``equal_texts``, and the diagnostics of repeated texts."""
    same = _mapping(groups.select("pair", F.explode("same").alias("b_idx")).withColumn("c_idx", F.col("b_idx")), "Structural", "Exact", 1.0)
    met = groups.where("n > 0").withColumns({"b_count": F.size("b"), "c_count": F.size("c"), "b_idx": F.col("b")[0], "c_idx": F.col("c")[0]})
    unique = _mapping(met.where("b_count = 1"), "ExactText", "Exact", 1.0)
    repeated = met.where("b_count > 1")
    joined = repeated.select("pair", F.inline(F.arrays_zip(F.slice("b", F.lit(1), F.col("n")).alias("b_idx"), F.slice("c", F.lit(1), F.col("n")).alias("c_idx"))))
    codes = F.array(F.struct(F.lit("Info").alias("severity"), F.lit("DuplicateCandidate").alias("code")), F.when(F.col("b_count") != F.col("c_count"), F.struct(F.lit("Warning").alias("severity"), F.lit("AmbiguousParagraphMatch").alias("code"))))
    notes = repeated.select("pair", "b_idx", "c_idx", F.explode(F.filter(codes, lambda x: x.isNotNull())).alias("n")).select("pair", "n.severity", "n.code", "b_idx", "c_idx")
    return same.unionByName(unique).unionByName(_mapping(joined, "Contextual", "Medium", REPEATED_SCORE)), notes


def left_over(side: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    """The paragraphs of a side that ``equal_texts`` gives no partner, with their features but the bigrams, written once."""
    rest = groups.select("pair", F.explode(F.slice(name, F.col("n") + 1, F.greatest(F.size(name) - F.col("n"), F.lit(0)))).alias("idx"))
    left = side.drop("tokens", "bigrams", "heading").join(rest, KEY, "left_semi")  # texts are read after the join
    return stored(_read(left).drop("bigrams"), f"left-{name}")


def token_index(cur: DataFrame) -> DataFrame:
    """pair, token, the sorted places of the token, and their number."""
    listed = cur.select("pair", "idx", F.explode("tokens").alias("token")).groupBy("pair", "token").agg(F.sort_array(F.collect_list("idx")).alias("places"))
    return listed.withColumn("df", F.size("places"))


def candidates(base: DataFrame, cur: DataFrame) -> DataFrame:
    """pair, b_idx, c_idx: at most 32 candidates per baseline paragraph.

    Candidates are those within four places, those of shared tokens from the rarest on until
    32 are reached, and those of the same heading; the nearest 32 stay. Equally rare tokens
    are taken in the order of their first occurrence. Tokens after one that alone reaches 32
    cannot add any, and of a frequent token only its 32 nearest places can be among the
    nearest 32, so a paragraph never expands a whole posting list.
    """
    b = base.select("pair", F.col("idx").alias("b_idx"), "tokens", "heading")
    near = b.select("pair", "b_idx", F.explode(F.sequence(F.col("b_idx") - NEAR, F.col("b_idx") + NEAR)).alias("idx")).join(cur.select("pair", "idx"), KEY)
    near = near.select("pair", "b_idx", F.col("idx").alias("c_idx"), F.lit(0).alias("rank"))
    posted = b.select("pair", "b_idx", F.posexplode("tokens").alias("at", "token")).join(token_index(cur).hint("merge"), ["pair", "token"])
    rarest = Window.partitionBy("pair", "b_idx").orderBy("df", "at")
    posted = posted.withColumns({"rank": F.row_number().over(rarest), "widest": F.max("df").over(rarest.rowsBetween(Window.unboundedPreceding, -1))})
    posted = posted.where(F.coalesce("widest", F.lit(0)) < MOST)
    nearest = F.slice(F.array_sort(F.transform("places", lambda p: F.struct(F.abs(p - F.col("b_idx")).alias("gap"), p.alias("p")))), 1, MOST)
    shared = posted.select("pair", "b_idx", "rank", F.explode(nearest).alias("x")).select("pair", "b_idx", F.col("x.p").alias("c_idx"), "rank")
    ranked = near.unionByName(shared).groupBy("pair", "b_idx", "c_idx").agg(F.min("rank").alias("rank"))
    earlier = Window.partitionBy("pair", "b_idx").orderBy("rank").rangeBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("before", F.count("*").over(earlier)).where(F.col("before") < MOST).select("pair", "b_idx", "c_idx")
    titled = b.where("heading is not null").join(cur.select("pair", "heading", F.col("idx").alias("c_idx")), ["pair", "heading"]).select("pair", "b_idx", "c_idx")
    nearest_first = Window.partitionBy("pair", "b_idx").orderBy(F.abs(F.col("c_idx") - F.col("b_idx")), "c_idx")
    return ranked.union(titled).distinct().withColumn("n", F.row_number().over(nearest_first)).where(F.col("n") <= MOST).drop("n")


def numbering_score(b: str, c: str) -> Column:
    """1 for the same level, text and format, 0.55 for the same level only, 0 otherwise or without numbering."""
    there = F.col(f"{b}.num_level").isNotNull() & (F.col(f"{b}.num_level") == F.col(f"{c}.num_level"))
    same = F.col(f"{b}.num_text").eqNullSafe(F.col(f"{c}.num_text")) & F.col(f"{b}.num_format").eqNullSafe(F.col(f"{c}.num_format"))
    return F.when(there, F.when(same, 1.0).otherwise(OTHER_NUMBERING)).otherwise(0.0)


def context_score(b: str, c: str) -> Column:
    """Share of equal neighbours among the places where both sides have one; 0 where there are none."""
    places = [(F.col(f"{b}.{x}"), F.col(f"{c}.{x}")) for x in ("prev", "next")]
    both = sum(((x.isNotNull() & y.isNotNull()).cast("int") for x, y in places), F.lit(0))
    same = sum((F.coalesce(x == y, F.lit(False)).cast("int") for x, y in places), F.lit(0))
    return F.when(both == 0, 0.0).otherwise(same / both)


def score(pairs: DataFrame, base: DataFrame, cur: DataFrame) -> DataFrame:
    """Adds the signals, the score (half-even to six places), the mapping type and the evidence."""
    base, cur = (df if "bigrams" in df.columns else df.withColumn("bigrams", tx.bigram_codes(F.col("norm"))) for df in (base, cur))
    columns = ("norm", "tokens", "bigrams", "heading", "style", "num_level", "num_text", "num_format", "prev", "next", "count")
    side = lambda df, name: df.select("pair", F.col("idx").alias(f"{name}_idx"), F.struct(*columns).alias(name))
    rows = pairs.join(side(base, "b"), ["pair", "b_idx"]).join(side(cur, "c"), ["pair", "c_idx"])
    longest = F.greatest("b.count", "c.count")
    of = lambda s: {k: F.col(f"{s}.{k}") for k in ("norm", "tokens", "bigrams")}
    rows = rows.withColumns(
        {
            "text_score": tx.similarity(of("b"), of("c")),
            "position_score": F.when(longest <= 1, 1.0).otherwise(1 - F.abs(F.col("b_idx") - F.col("c_idx")) / longest),
            "style_score": F.when(F.col("b.style").eqNullSafe(F.col("c.style")), F.when(F.col("b.style").isNull(), NO_STYLE).otherwise(1.0)).otherwise(0.0),
            "numbering_score": numbering_score("b", "c"),
            "heading_score": F.when(F.coalesce(F.col("b.heading") == F.col("c.heading"), F.lit(False)), 1.0).otherwise(0.0),
            "context_score": context_score("b", "c"),
        }
    )
    structure = F.greatest("numbering_score", "heading_score")
    total = WEIGHTS["text"] * F.col("text_score") + WEIGHTS["position"] * F.col("position_score") + WEIGHTS["style"] * F.col("style_score") + WEIGHTS["structure"] * structure + WEIGHTS["context"] * F.col("context_score")
    kind = F.when(structure > 0, "HeadingOrNumbering").when(F.col("context_score") >= CONTEXT_LEAST, "Contextual").otherwise("SimilarText")
    named = [("TextSimilarity", "text_score"), ("Position", "position_score"), ("Style", "style_score"), ("Numbering", "numbering_score"), ("Heading", "heading_score"), ("Context", "context_score")]
    evidence = F.filter(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(v).alias("score")) for k, v in named)), lambda e: (e["score"] > 0) | e["kind"].isin("TextSimilarity", "Position"))
    return rows.select("pair", "b_idx", "c_idx", *(v for _, v in named), F.bround(total, 6).alias("score"), kind.alias("type"), evidence.alias("evidence"))


def best_candidates(scored: DataFrame) -> DataFrame:
    """The best candidate of each baseline paragraph, with the score of the second."""
    best = Window.partitionBy("pair", "b_idx").orderBy(F.desc("score"), F.abs(F.col("b_idx") - F.col("c_idx")), "c_idx")
    ranked = scored.select("pair", "b_idx", "c_idx", "score", "type").withColumns({"place": F.row_number().over(best), "second": F.lead("score").over(best)})
    return ranked.where("place = 1").drop("place")


def chosen(top: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fuzzy mappings and diagnostics from the best candidates.

    The best candidate counts if it scores enough and leads the next by more than the
    margin; of the paragraphs that choose one candidate the best score wins.
    """
    low, close = F.col("score") < LEAST_SCORE, F.coalesce(F.col("score") - F.col("second") <= MARGIN, F.lit(False))
    notes = top.where(low | close).select(
        "pair", F.when(low, "Info").otherwise("Warning").alias("severity"), F.when(low, "LowConfidenceMapping").otherwise("AmbiguousParagraphMatch").alias("code"), "b_idx", F.when(low, F.col("c_idx")).alias("c_idx")
    )
    rival = Window.partitionBy("pair", "c_idx").orderBy(F.desc("score"), "b_idx")
    won = top.where(~low & ~close).withColumn("place", F.row_number().over(rival)).where("place = 1")
    return won.select("pair", "b_idx", "c_idx", "type", F.when(F.col("score") >= HIGH_SCORE, "High").otherwise("Medium").alias("confidence"), "score"), notes


def similar(base: DataFrame, cur: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fuzzy mappings, their diagnostics, and the scored candidates."""
    scored = score(candidates(base, cur), base, cur)
    return (*chosen(best_candidates(scored)), scored)


def match(base: DataFrame, cur: DataFrame) -> Matched:
    """All stages. Paragraphs without a partner are deleted or inserted.

    The equal texts, what they leave, and the candidates are written once: the stages after
    them would otherwise compute all earlier ones again.
    """
    groups = stored(equal_texts(base, cur), "equal")
    one, notes = exact(groups)
    b, c = left_over(base, groups, "b"), left_over(cur, groups, "c")
    top = stored(best_candidates(score(stored(candidates(b, c), "candidates"), b, c)), "best")
    two, more = chosen(top)
    return Matched(one.unionByName(two), remaining(b, two, "b_idx"), remaining(c, two, "c_idx"), notes.unionByName(more))


def moved(mappings: DataFrame) -> DataFrame:
    """Adds ``moved``: outside the longest increasing sequence of current places, unless order alone decided the mapping."""
    from docweave.functions.diff import stable

    ordered = mappings.groupBy("pair").agg(F.sort_array(F.collect_list(F.struct("b_idx", "c_idx", "type", "confidence", "score"))).alias("m"))
    flagged = ordered.withColumn("s", stable(F.transform("m", lambda x: x["c_idx"])))
    rows = flagged.select("pair", F.explode(F.arrays_zip("m", "s")).alias("x")).select("pair", "x.m.*", F.col("x.s").alias("stable"))
    by_order = (F.col("type") == "Contextual") & (F.col("confidence") == "Medium")
    return rows.withColumn("moved", ~F.col("stable") & ~by_order).drop("stable")
