"""Comparison queries over ``documents`` and the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import ignore, matching, recommend, review
from docweave.plans import versions as v
from docweave.storage import stored


def _sides(spark: SparkSession, sf_dir: str):
    return tuple(map(matching.features, v.stored_sides(spark, sf_dir)))


def paragraph_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.paragraphs(v.documents(spark, sf_dir))
    tokens, grams = tx.match_tokens(F.col("norm")), tx.bigram_codes(F.col("norm"))
    return rows.select("doc_id", "idx", "norm", F.size(tokens).alias("n_tokens"), F.array_join(F.sort_array(tokens), " ").alias("tokens"), F.size(grams).alias("n_bigrams"), tx.heading_key(F.col("norm")).alias("heading"))


LINES = r"""
lines AS (
  SELECT doc_id, CAST(idx AS INT) AS idx, text, trim(regexp_replace(regexp_replace(text, '[\x{00A0}\x{3000}]', ' ', 'g'), '[\t \r]+', ' ', 'g')) AS norm
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents)
)"""
PAIRS = f"""{LINES},
anchors AS (SELECT doc_id, min(md5(norm)) AS anchor FROM lines WHERE length(norm) > {v.ANCHOR_CHARS} GROUP BY doc_id),
pairs AS (SELECT * FROM (SELECT doc_id AS pair, lag(doc_id) OVER (PARTITION BY anchor ORDER BY doc_id) AS base_doc, doc_id AS cur_doc FROM anchors) WHERE base_doc IS NOT NULL),
b0 AS (SELECT pair, idx, text, norm FROM pairs JOIN lines ON doc_id = base_doc),
c0 AS (SELECT pair, idx, text, norm FROM pairs JOIN lines ON doc_id = cur_doc),
m1 AS (SELECT b0.pair, b0.idx AS b_idx, c0.idx AS c_idx FROM b0 JOIN c0 USING (pair, idx, norm)),
b1 AS (SELECT * FROM b0 WHERE NOT EXISTS (SELECT 1 FROM m1 WHERE m1.pair = b0.pair AND m1.b_idx = b0.idx)),
c1 AS (SELECT * FROM c0 WHERE NOT EXISTS (SELECT 1 FROM m1 WHERE m1.pair = c0.pair AND m1.c_idx = c0.idx)),
m2 AS (SELECT b.pair, b.idx AS b_idx, c.idx AS c_idx
  FROM (SELECT *, count(*) OVER (PARTITION BY pair, norm) AS n FROM b1) b JOIN (SELECT *, count(*) OVER (PARTITION BY pair, norm) AS n FROM c1) c USING (pair, norm) WHERE b.n = 1 AND c.n = 1),
b2 AS (SELECT * FROM b1 WHERE NOT EXISTS (SELECT 1 FROM m2 WHERE m2.pair = b1.pair AND m2.b_idx = b1.idx)),
c2 AS (SELECT * FROM c1 WHERE NOT EXISTS (SELECT 1 FROM m2 WHERE m2.pair = c1.pair AND m2.c_idx = c1.idx)),
m3 AS (SELECT b.pair, b.idx AS b_idx, c.idx AS c_idx, b.k, b.n AS b_count, c.n AS c_count
  FROM (SELECT *, row_number() OVER (PARTITION BY pair, norm ORDER BY idx) AS k, count(*) OVER (PARTITION BY pair, norm) AS n FROM b2) b
  JOIN (SELECT *, row_number() OVER (PARTITION BY pair, norm ORDER BY idx) AS k, count(*) OVER (PARTITION BY pair, norm) AS n FROM c2) c USING (pair, norm, k) WHERE b.n > 1),
b3 AS (SELECT * FROM b2 WHERE NOT EXISTS (SELECT 1 FROM m3 WHERE m3.pair = b2.pair AND m3.b_idx = b2.idx)),
c3 AS (SELECT * FROM c2 WHERE NOT EXISTS (SELECT 1 FROM m3 WHERE m3.pair = c2.pair AND m3.c_idx = c2.idx))"""
_FEATURES = r"""
bf AS (SELECT b0.*, lag(norm) OVER w AS prev, lead(norm) OVER w AS next, count(*) OVER (PARTITION BY pair) AS n FROM b0 WINDOW w AS (PARTITION BY pair ORDER BY idx)),
cf AS (SELECT c0.*, lag(norm) OVER w AS prev, lead(norm) OVER w AS next, count(*) OVER (PARTITION BY pair) AS n FROM c0 WINDOW w AS (PARTITION BY pair ORDER BY idx))"""
_TOKENS = r"regexp_extract_all(lower(norm), '[\p{L}\p{Nd}]+|[^\s\p{L}\p{Nd}]')"
FUZZY = PAIRS + "," + _FEATURES + rf""",
bt AS (SELECT pair, idx, token, min(pos) AS pos FROM (SELECT pair, idx, unnest({_TOKENS}) AS token, generate_subscripts({_TOKENS}, 1) AS pos FROM b3) GROUP BY pair, idx, token),
ct AS (SELECT pair, idx, token, count(*) OVER (PARTITION BY pair, token) AS df FROM (SELECT DISTINCT pair, idx, unnest({_TOKENS}) AS token FROM c3)),
br AS (SELECT pair, idx, token, row_number() OVER (PARTITION BY pair, idx ORDER BY df, pos) AS rank FROM bt JOIN (SELECT DISTINCT pair, token, df FROM ct) USING (pair, token)),
raw AS (
  SELECT pair, b_idx, c_idx, min(rank) AS rank FROM (
    SELECT b3.pair, b3.idx AS b_idx, c3.idx AS c_idx, 0 AS rank FROM b3 JOIN c3 ON b3.pair = c3.pair AND abs(b3.idx - c3.idx) <= {matching.NEAR}
    UNION ALL SELECT br.pair, br.idx, ct.idx, rank FROM br JOIN ct USING (pair, token)) GROUP BY pair, b_idx, c_idx),
cut AS (SELECT *, count(*) OVER (PARTITION BY pair, b_idx ORDER BY rank RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM raw),
cand AS (SELECT pair, b_idx, c_idx FROM (SELECT *, row_number() OVER (PARTITION BY pair, b_idx ORDER BY abs(c_idx - b_idx), c_idx) AS k FROM cut WHERE before < {matching.MOST}) WHERE k <= {matching.MOST}),
wide AS (
  SELECT cand.*, bf.norm AS bn, cf.norm AS cn, greatest(bf.n, cf.n) AS longest,
    CASE WHEN bf.prev IS NOT NULL AND cf.prev IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN bf.next IS NOT NULL AND cf.next IS NOT NULL THEN 1 ELSE 0 END AS both_sides,
    CASE WHEN bf.prev = cf.prev THEN 1 ELSE 0 END + CASE WHEN bf.next = cf.next THEN 1 ELSE 0 END AS same_sides
  FROM cand JOIN bf ON bf.pair = cand.pair AND bf.idx = b_idx JOIN cf ON cf.pair = cand.pair AND cf.idx = c_idx),
sets AS (
  SELECT *, list_distinct({_TOKENS.replace("norm", "bn")}) AS bt, list_distinct({_TOKENS.replace("norm", "cn")}) AS ct,
    list_distinct(list_transform(range(1, length(bn)), lambda i: substr(bn, i, 2))) AS bg, list_distinct(list_transform(range(1, length(cn)), lambda i: substr(cn, i, 2))) AS cg
  FROM wide),
signals AS (
  SELECT *,
    CASE WHEN bn = cn THEN 1.0::DOUBLE WHEN length(bn) = 0 OR length(cn) = 0 THEN 0.0::DOUBLE ELSE
      0.45::DOUBLE * (CASE WHEN length(bn) = 1 OR length(cn) = 1 THEN CASE WHEN substr(bn, 1, 1) = substr(cn, 1, 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
        ELSE 2.0::DOUBLE * len(list_intersect(bg, cg)) / (len(bg) + len(cg)) END)
      + 0.35::DOUBLE * (CASE WHEN len(bt) = 0 OR len(ct) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(bt, ct))::DOUBLE / (len(bt) + len(ct) - len(list_intersect(bt, ct))) END)
      + 0.20::DOUBLE * (least(length(bn), length(cn))::DOUBLE / greatest(length(bn), length(cn))) END AS text_score,
    CASE WHEN longest <= 1 THEN 1.0::DOUBLE ELSE 1 - abs(b_idx - c_idx)::DOUBLE / longest END AS position_score,
    CASE WHEN both_sides = 0 THEN 0.0::DOUBLE ELSE same_sides::DOUBLE / both_sides END AS context_score
  FROM sets),
scored AS (
  SELECT *, round_even(0.75::DOUBLE * text_score + 0.05::DOUBLE * position_score + 0.05::DOUBLE * 0.35::DOUBLE + 0.05::DOUBLE * 0.0::DOUBLE + 0.10::DOUBLE * context_score, 6) AS score,
    CASE WHEN context_score >= 0.5 THEN 'Contextual' ELSE 'SimilarText' END AS type FROM signals),
best AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS second FROM scored WINDOW w AS (PARTITION BY pair, b_idx ORDER BY score DESC, abs(b_idx - c_idx), c_idx)),
won AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair, c_idx ORDER BY score DESC, b_idx) AS win FROM best
    WHERE place = 1 AND score >= {matching.LEAST_SCORE} AND (second IS NULL OR score - second > {matching.MARGIN})) WHERE win = 1)"""


def _left(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What exact mappings leave of both sides."""
    b, c = _sides(spark, sf_dir)
    groups = stored(matching.equal_texts(b, c), "equal")
    return matching.left_over(b, groups, "b"), matching.left_over(c, groups, "c")


def exact_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.exact(stored(matching.equal_texts(*v.stored_sides(spark, sf_dir)), "equal"))[0]


EXACT_SQL = f"""WITH {PAIRS}
SELECT pair, b_idx, c_idx, 'Structural' AS type, 'Exact' AS confidence, 1.0::DOUBLE AS score FROM m1
UNION ALL SELECT pair, b_idx, c_idx, 'ExactText', 'Exact', 1.0 FROM m2
UNION ALL SELECT pair, b_idx, c_idx, 'Contextual', 'Medium', 0.72 FROM m3"""


def fuzzy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.candidates(*_left(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scored candidates, and what exact mappings leave of both sides."""
    b, c = _left(spark, sf_dir)
    return stored(matching.score(stored(matching.candidates(b, c), "candidates"), b, c), "scored"), b, c


def _millionths(name: str):
    return F.round(F.col(name) * 1e6).cast("long").alias(f"{name}_e6")


def fuzzy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = matching.chosen(matching.best_candidates(_scored(spark, sf_dir)[0]))
    return found.select("pair", "b_idx", "c_idx", "type", "confidence", _millionths("score"))


FUZZY_SQL = f"WITH {FUZZY} SELECT pair, b_idx, c_idx, type, CASE WHEN score >= {matching.HIGH_SCORE} THEN 'High' ELSE 'Medium' END AS confidence, CAST(round(score * 1e6) AS BIGINT) AS score_e6 FROM won"


def fuzzy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)[0]
    return scored.select("pair", "b_idx", "c_idx", *map(_millionths, ("text_score", "position_score", "context_score", "score")), "type")


SCORES_SQL = f"WITH {FUZZY} SELECT pair, b_idx, c_idx, CAST(round(text_score * 1e6) AS BIGINT) AS text_score_e6, CAST(round(position_score * 1e6) AS BIGINT) AS position_score_e6, CAST(round(context_score * 1e6) AS BIGINT) AS context_score_e6, CAST(round(score * 1e6) AS BIGINT) AS score_e6, type FROM scored"


def match_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match(*_sides(spark, sf_dir)).diagnostics.groupBy("pair", "severity", "code").agg(F.count("*").alias("n"))


DIAGNOSTICS_SQL = f"""WITH {FUZZY}, notes AS (
  SELECT pair, 'Info' AS severity, 'DuplicateCandidate' AS code FROM m3 WHERE k = 1
  UNION ALL SELECT pair, 'Warning', 'AmbiguousParagraphMatch' FROM m3 WHERE k = 1 AND b_count <> c_count
  UNION ALL SELECT pair, 'Info', 'LowConfidenceMapping' FROM best WHERE place = 1 AND score < {matching.LEAST_SCORE}
  UNION ALL SELECT pair, 'Warning', 'AmbiguousParagraphMatch' FROM best WHERE place = 1 AND score >= {matching.LEAST_SCORE} AND second IS NOT NULL AND score - second <= {matching.MARGIN})
SELECT pair, severity, code, count(*) AS n FROM notes GROUP BY ALL"""


def unmatched_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = matching.match(*_sides(spark, sf_dir))
    side = lambda df, s: df.select("pair", F.lit(s).alias("side"), "idx", F.length("norm").alias("chars"))
    return side(matched.deleted, "delete").unionByName(side(matched.inserted, "insert"))


UNMATCHED_SQL = f"""WITH {FUZZY}
SELECT pair, 'delete' AS side, idx, length(norm) AS chars FROM b3 WHERE NOT EXISTS (SELECT 1 FROM won WHERE won.pair = b3.pair AND won.b_idx = b3.idx)
UNION ALL SELECT pair, 'insert', idx, length(norm) FROM c3 WHERE NOT EXISTS (SELECT 1 FROM won WHERE won.pair = c3.pair AND won.c_idx = c3.idx)"""


def moved_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.moved(matching.match(*_sides(spark, sf_dir)).mappings)
    return found.select("pair", "b_idx", "c_idx", "type", "moved")


def text_diff_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = v.comparison(spark, sf_dir).changes.where("size(spans) > 0")
    return found.select("pair", "change_id", "kind", F.posexplode("spans").alias("k", "s")).select("pair", "change_id", "kind", "k", "s.*")


def span_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans applied to the old text, beside the new text: equal in every row. All offsets are in characters here."""
    found = v.comparison(spark, sf_dir).changes.where("size(spans) > 0")
    piece = lambda acc, s: F.struct((s["b_start"] + s["b_len"]).alias("at"), F.concat(acc["out"], F.substring(F.col("b_text"), acc["at"] + 1, s["b_start"] - acc["at"]), s["new"]).alias("out"))
    rebuilt = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), piece, lambda acc: F.concat(acc["out"], F.substring(F.col("b_text"), acc["at"] + 1, F.length("b_text"))))
    return found.groupBy((rebuilt == F.col("c_text")).alias("same")).agg(F.count_distinct("pair").alias("pairs"), F.count("*").alias("items")).where("not same").select("pairs", "items")


RECONSTRUCTION_SQL = "SELECT CAST(0 AS BIGINT) AS pairs, CAST(0 AS BIGINT) AS items WHERE false"


def change_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.comparison(spark, sf_dir).changes.select("pair", "change_id", "kind", "b_node", "c_node", F.size("spans").alias("n_spans"), "confidence")


def change_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.comparison(spark, sf_dir).groups.select("pair", "group_id", "kind", "old", "new", F.size("members").alias("n"))


def change_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.comparison(spark, sf_dir).statistics


def scroll_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, c = _sides(spark, sf_dir)
    return review.scroll_links(matching.match(b, c).mappings, b)


SCROLL_SQL = f"""WITH {FUZZY}, own AS (SELECT pair, b_idx, min(c_idx) AS target FROM won WHERE score >= {matching.HIGH_SCORE} GROUP BY pair, b_idx HAVING count(DISTINCT c_idx) = 1),
near AS (SELECT b0.pair, b0.idx, own.b_idx AS linked, target, row_number() OVER (PARTITION BY b0.pair, b0.idx ORDER BY abs(own.b_idx - b0.idx), own.b_idx) AS k FROM b0 JOIN own ON own.pair = b0.pair AND abs(own.b_idx - b0.idx) <= 2)
SELECT pair, idx, linked, target FROM near WHERE k = 1"""


def ignore_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy partners as items with one whole-text span, shown under a rule that ignores punctuation."""
    rules = ignore.Rules(punctuation=True, characters="|!%$&*#")
    scored, b, c = _scored(spark, sf_dir)
    found, _ = matching.chosen(matching.best_candidates(scored))
    rows = found.join(b.select("pair", F.col("idx").alias("b_idx"), F.col("norm").alias("b_text")), ["pair", "b_idx"]).join(c.select("pair", F.col("idx").alias("c_idx"), F.col("norm").alias("c_text")), ["pair", "c_idx"])
    span = F.struct(F.lit("Replace").alias("op"), F.lit(0).alias("b_start"), F.length("b_text").alias("b_len"), F.lit(0).alias("c_start"), F.length("c_text").alias("c_len"), F.col("b_text").alias("old"), F.col("c_text").alias("new"))
    none = F.array().cast("array<string>")
    items = rows.select("pair", "b_idx", F.lit("TextReplace").alias("kind"), "b_text", "c_text", F.array(span).alias("spans"), F.lit(None).cast("struct<scope:string,properties:array<struct<property:string,baseline:string,current:string>>>").alias("format"), none.alias("revision_ids"), none.alias("comment_ids"), none.alias("codes"))
    return ignore.project(items, rules).select("pair", "b_idx", F.size("spans").alias("n_spans"))


_IGNORED = (ignore.PUNCTUATION + "|!%$&*#").replace("'", "''")
IGNORE_SQL = f"WITH {FUZZY} SELECT pair, b_idx, CAST(1 AS INT) AS n_spans FROM won WHERE bn = cn OR translate(bn, '{_IGNORED}', '') <> translate(cn, '{_IGNORED}', '')"


def review_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserted and deleted paragraphs whose document is labelled good, found by a search for a word."""
    matched = matching.match(*_sides(spark, sf_dir))
    side = lambda df, s: df.select("pair", F.concat_ws(":", F.lit(s), "node").alias("change_id"), F.lit(f"Paragraph{s.title()}").alias("kind"), "text")
    items = side(matched.deleted, "delete").unionByName(side(matched.inserted, "insert"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("pair"), F.when(F.col("quality") == 1, "Confirmed").otherwise("Ignored").alias("state"))
    states = items.join(labels, "pair").select("pair", "change_id", "state")
    return review.review_list(items, states, search="THE", fields=("text",)).select("pair", "change_id", "kind", "state")


REVIEW_SQL = f"""WITH {FUZZY}, items AS (
SELECT pair, 'delete:body/p[' || idx || ']' AS change_id, 'ParagraphDelete' AS kind, text FROM b3 WHERE NOT EXISTS (SELECT 1 FROM won WHERE won.pair = b3.pair AND won.b_idx = b3.idx)
UNION ALL SELECT pair, 'insert:body/p[' || idx || ']', 'ParagraphInsert', text FROM c3 WHERE NOT EXISTS (SELECT 1 FROM won WHERE won.pair = c3.pair AND won.c_idx = c3.idx))
SELECT pair, change_id, kind, CASE WHEN quality = 1 THEN 'Confirmed' WHEN quality = 0 THEN 'Ignored' ELSE 'Unresolved' END AS state
FROM items LEFT JOIN labels ON labels.doc_id = pair WHERE coalesce(quality, 1) <> 0 AND contains(lower(text), 'the')"""


def template_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the stated query set of templates, those whose id is divisible by 50.

    A document's table is its lines as rows, and the words of the first of them as cells.
    """
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".docx"))
    lines = F.split("text", "\n")
    cells = F.array_join(F.transform(F.slice(lines, 1, recommend.TABLE_ROWS), lambda p: F.size(F.split(p, " ")).cast("string")), ",")
    docs = v.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), name.alias("file_name"), F.lit(None).cast("string").alias("title"), lines.alias("paragraphs"), F.array(F.concat(F.size(lines).cast("string"), F.lit(":"), cells)).alias("tables"))
    templates = docs.where("id % 50 = 0").withColumn("is_current", F.col("id") % 100 == 0)
    found = recommend.recommend(recommend.scored(docs, templates, least=recommend.CANDIDATE))
    return found.where("size(best) > 0").select("doc_id", "kind", F.col("best")[0]["template_id"].alias("template_id"), F.round(F.col("best")[0]["score"], 4).alias("score"), F.size("best").alias("n"))


_SET = "(CASE WHEN len(d.{0}) = 0 OR len(t.{0}) = 0 THEN 0.0 ELSE len(list_intersect(d.{0}, t.{0})) / (len(d.{0}) + len(t.{0}) - len(list_intersect(d.{0}, t.{0}))) END)"
_TEXT = "(CASE WHEN length(d.{0}) < 3 OR length(t.{0}) < 3 THEN CAST(d.{0} = t.{0} AND d.{0} <> '' AS DOUBLE) ELSE " + _SET.format("{0}_set") + " END)"
_GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1)), lambda i: substr({0}, i, 3)))"
_CLAUSE = r"(regexp_matches(ltrim(p), '^第[^条]{1,12}条') OR (length(ltrim(p)) > 2 AND regexp_matches(ltrim(p), '^\p{Nd}') AND (contains(p, '.') OR contains(p, '、'))))"
_LETTERS = r"lower(regexp_replace({0}, '[^\p{{L}}\p{{Nd}}]', '', 'g'))"
#: Distinct substrings in order of first occurrence: ``list_distinct`` keeps no order, so texts with more than the bound are cut by first places.
RECOMMEND_SQL = rf"""WITH lines AS (SELECT doc_id AS id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
docs AS (SELECT id, list_filter(l, lambda p: p <> '')[1 : {recommend.PARAGRAPHS}] AS p, [len(l) || ':' || array_to_string(list_transform(l[1 : {recommend.TABLE_ROWS}], lambda p: len(string_split(p, ' '))), ',')] AS tables FROM lines),
named AS (SELECT id, p, tables, len(p) AS n, 'doc' || id AS stem, coalesce(list_filter(p, lambda p: length(p) <= 80 AND NOT {_CLAUSE})[1], 'doc' || id) AS title0, substr({_LETTERS.format("array_to_string(p, ' ')")}, 1, {recommend.BODY}) AS body_text,
  list_distinct(list_filter(list_transform(list_filter(p, lambda p: {_CLAUSE}), lambda p: substr(regexp_replace({_LETTERS.format("p")}, '\p{{Nd}}+', '0', 'g'), 1, 26)), lambda h: length(h) >= 2)[1 : {recommend.HEADINGS}]) AS headings FROM docs),
titled AS (SELECT *, {_LETTERS.format("title0")} AS title FROM named),
grams AS (SELECT id, min(i) AS place, g FROM (SELECT id, unnest(range(1, length(body_text) - 1)) AS i, substr(body_text, i, 3) AS g FROM titled WHERE length(body_text) >= 3) GROUP BY id, g),
bodies AS (SELECT id, list(g) AS body FROM (SELECT * FROM grams QUALIFY row_number() OVER (PARTITION BY id ORDER BY place) <= {recommend.SHINGLES}) GROUP BY id),
f AS (SELECT titled.id, tables, n, stem, title, headings, coalesce(body, []) AS body, {_GRAMS.format("stem")} AS stem_set, {_GRAMS.format("title")}[1 : {recommend.TITLE_SHINGLES}] AS title_set FROM titled LEFT JOIN bodies USING (id)),
pairs AS (SELECT d.id AS doc_id, t.id AS template_id, t.id % 100 = 0 AS is_current, least(1.0, 0.04 * {_TEXT.format("stem")} + 0.07 * {_TEXT.format("title")} + 0.24 * {_SET.format("headings")} + 0.52 * {_SET.format("body")} + 0.08 * {_SET.format("tables")}
  + 0.05 * CASE WHEN d.n = 0 OR t.n = 0 THEN 0.0 ELSE least(d.n, t.n) / greatest(d.n, t.n) END + CASE WHEN t.id % 100 = 0 THEN 0.03 ELSE 0.0 END) AS score FROM f d JOIN f t ON t.id % 50 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, is_current DESC, template_id) AS rank FROM pairs WHERE score >= {recommend.CANDIDATE}),
best AS (SELECT doc_id, max(score) AS first, max(score) FILTER (rank = 2) AS second, least(count(*), 3) AS n, any_value(template_id) FILTER (rank = 1) AS template_id FROM top GROUP BY 1)
SELECT doc_id, CASE WHEN first < {recommend.UNIQUE} AND n = 1 THEN 'None' WHEN first >= {recommend.UNIQUE} AND (n = 1 OR first - second >= {recommend.LEAD}) THEN 'Unique' ELSE 'Multiple' END AS kind, template_id, round(first, 4) AS score, CAST(n AS INT) AS n FROM best"""


def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    state = F.when(F.col("o_orderstatus") == "F", "Confirmed").when(F.col("o_orderstatus") == "P", "Ignored").otherwise("Unresolved")
    return review.counts(orders.select("o_custkey", state.alias("state")), "o_custkey")


REVIEW_COUNTS_SQL = "SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS unresolved, count(*) FILTER (o_orderstatus = 'F') AS confirmed, count(*) FILTER (o_orderstatus = 'P') AS ignored FROM orders GROUP BY o_custkey"


def latest_review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("pair"), F.col("event_type").alias("change_id"), F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")).alias("state"), F.col("event_id").alias("seq"))
    return review.latest_states(events)


LATEST_SQL = "SELECT user_id AS pair, event_type AS change_id, arg_max('s' || CAST(event_id % 3 AS VARCHAR), event_id) AS state FROM events GROUP BY user_id, event_type"

QUERIES = {
    "paragraph_features": (paragraph_features, rf"""WITH {LINES} SELECT doc_id, idx, norm, len(t) AS n_tokens, array_to_string(list_sort(t), ' ') AS tokens,
  len(list_distinct(list_transform(range(1, length(norm)), lambda i: substr(norm, i, 2)))) AS n_bigrams,
  CASE WHEN regexp_matches(norm, '^[\p{{Nd}}.]{{1,12}}[ 、．]') THEN rtrim(regexp_extract(norm, '^([\p{{Nd}}.]{{1,12}})[ 、．]', 1), '.') END AS heading FROM (SELECT *, list_distinct({_TOKENS}) AS t FROM lines)"""),
    "exact_matches": (exact_matches, EXACT_SQL),
    "fuzzy_candidates": (fuzzy_candidates, f"WITH {FUZZY} SELECT pair, b_idx, c_idx FROM cand"),
    "fuzzy_scores": (fuzzy_scores, SCORES_SQL),
    "fuzzy_matches": (fuzzy_matches, FUZZY_SQL),
    "match_diagnostics": (match_diagnostics, DIAGNOSTICS_SQL),
    "unmatched_paragraphs": (unmatched_paragraphs, UNMATCHED_SQL),
    "moved_paragraphs": (moved_paragraphs, None),
    "text_diff_spans": (text_diff_spans, None),
    "span_reconstruction": (span_reconstruction, RECONSTRUCTION_SQL),
    "change_items": (change_items, None),
    "change_groups": (change_groups, None),
    "change_statistics": (change_statistics, None),
    "scroll_links": (scroll_links, SCROLL_SQL),
    "ignore_projection": (ignore_projection, IGNORE_SQL),
    "review_filter": (review_filter, REVIEW_SQL),
    "review_counts": (review_counts, REVIEW_COUNTS_SQL),
    "latest_review_states": (latest_review_states, LATEST_SQL),
    "template_recommendation": (template_recommendation, RECOMMEND_SQL),
}
