"""The queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import decontaminate, hard_negatives, line_dedup, media_box, near_dedup, piece_dropout, prefix_trie, quality_classifier, quality_rules, shard, substring_dedup, token_store, warc
from docweave.llm.common import scratch_path, table


def op1_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.classify(docs, model)
    return scored.select("doc_id", quality_classifier.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    return warc.capture_digests(warc.read_records(spark, folder))


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
heads AS (SELECT h, min(page_id) AS head FROM p WHERE strlen(h) >= 100 GROUP BY h)
SELECT p.page_id, strlen(p.h) AS payload_bytes, sha256(p.h) AS payload_digest,
  CASE WHEN head < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN head < p.page_id THEN head END AS refers_to
FROM p LEFT JOIN heads USING (h)
"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed_substrings(table(spark, sf_dir, "documents")).drop("kept", "spans")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END)) AS s FROM words
), classes AS (
  SELECT min(doc_id) AS class, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), shingles AS (
  SELECT class, n, unnest(s) AS g FROM classes
), links AS (
  SELECT a.class AS a, b.class AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.class <> b.class AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT class, class AS r FROM classes UNION SELECT reach.class, links.b FROM reach JOIN links ON links.a = reach.r
), least_of AS (
  SELECT class, min(r) AS component FROM reach GROUP BY class
)
SELECT doc_id, len(sets.s) AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept
FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN least_of ON least_of.class = classes.class
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_deleted", "n_runs", F.octet_length("text").cast("long").alias("kept_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: From the definition: two places with equal lines lie on a diagonal; what follows each other on it is a common run.
OP5_SQL = f"""
WITH docs AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL
), lines AS (
  SELECT doc_id, line, content, row_number() OVER (ORDER BY doc_id, line) + dense_rank() OVER (ORDER BY doc_id) AS place
  FROM (SELECT doc_id, unnest(generate_series(0, len(parts) - 1)) AS line, unnest(parts) AS content FROM docs)
), pairs AS (
  SELECT x.place AS earlier, y.place AS later, length(x.content) AS chars FROM lines x JOIN lines y ON x.content = y.content AND x.place < y.place
), islands AS (
  SELECT *, later - row_number() OVER (PARTITION BY later - earlier ORDER BY later) AS island FROM pairs
), common AS (
  SELECT later, sum(chars) OVER (PARTITION BY later - earlier, island) AS chars FROM islands
), gone AS (
  SELECT DISTINCT later AS place FROM common WHERE chars >= {line_dedup.MIN_CHARS}
), marked AS (
  SELECT l.*, g.place IS NOT NULL AS gone FROM lines l LEFT JOIN gone g USING (place)
), runs AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY line), false) AS begins FROM marked
), texts AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_deleted, count(*) FILTER (begins) AS n_runs,
    coalesce(string_agg(content, chr(10) ORDER BY line) FILTER (NOT gone), '') AS text
  FROM runs GROUP BY doc_id
)
SELECT doc_id, n_lines, n_deleted, n_runs, strlen(text) AS kept_bytes, sha256(text) AS kept_sha256 FROM texts
UNION ALL SELECT doc_id, 0, 0, 0, NULL, NULL FROM documents WHERE text IS NULL
"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontaminate.item_digest().alias("items_sha256"), "contaminated")


OP6_SQL = rf"""
WITH items AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT item_id, unnest(CASE WHEN len(w) < 13 THEN [w] ELSE list_transform(range(1, len(w) - 11), lambda i: w[i : i + 12]) END) AS win FROM items WHERE len(w) > 0
), grams AS (
  SELECT DISTINCT item_id, len(win) AS n, array_to_string(win, ' ') AS gram FROM windows
), docs AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), starts AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs CROSS JOIN (SELECT DISTINCT n FROM grams)
), hits AS (
  SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM starts) JOIN grams USING (n, gram)
), words AS (
  SELECT doc_id, count(DISTINCT at_word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS at_word FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read_store(spark, folder)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = piece_dropout.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "variant", "n_pieces", "ids_crc32", F.col("decoded_crc32").alias("text_crc32"), "lossless")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.balanced_shards(table(spark, sf_dir, "documents"))


def op11_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "media")
    media_box.write_media(table(spark, sf_dir, "documents"), folder)
    return media_box.read_media(spark, folder)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH points AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, p.vec_id AS other_id, a.label = p.label AS alike, CAST(list_inner_product(a.v, p.v) AS BIGINT) AS score
  FROM points a JOIN points p ON a.vec_id <> p.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 10
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


#: A node's path is the chain of digests of its turns; every node adds to all nodes above it.
OP13_SQL = """
WITH RECURSIVE turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ascii(c), 256, 256, 256, 256, 256, 256, 256, 256])),
      lambda a, x: CASE WHEN x < 256 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, 4294967295), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), whole AS (
  SELECT c.conv_id, t.role, t.text, t.i AS spot FROM convs c JOIN turns t ON t.conv_id = c.base AND t.i <= c.h
  UNION ALL SELECT c.conv_id, t.role, t.text, c.h + t.i FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i > c.h
), placed AS (
  SELECT conv_id, sha256(strlen(role) || ':' || role || text) AS said, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY spot) AS depth FROM whole
), sized AS (
  SELECT conv_id, count(said) AS n FROM convs LEFT JOIN placed USING (conv_id) GROUP BY conv_id
), paths AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS depth, '' AS path, '' AS above, CAST(0 AS BIGINT) AS chars FROM convs
  UNION ALL SELECT p.conv_id, q.depth, sha256(p.path || q.said), p.path, q.chars FROM paths p JOIN placed q ON q.conv_id = p.conv_id AND q.depth = p.depth + 1
), nodes AS (
  SELECT depth, path, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM paths JOIN sized USING (conv_id) GROUP BY depth, path
), kids AS (
  SELECT depth - 1 AS depth, above AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), full_nodes AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (depth, path)
), sums AS (
  SELECT up.depth, up.path, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM full_nodes n JOIN paths low ON low.conv_id = n.conv_id AND low.depth = n.depth
  JOIN paths up ON up.conv_id = n.conv_id AND up.depth <= n.depth GROUP BY up.depth, up.path
)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums s ON s.depth = f.depth AND s.path = f.path LEFT JOIN full_nodes p ON f.depth > 0 AND p.depth = f.depth - 1 AND p.path = f.above
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_classifier": op1_classifier,
        "op2_warc": op2_warc,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_minhash": op4_minhash,
        "op5_line_dedup": op5_line_dedup,
        "op6_decontamination": op6_decontamination,
        "op7_token_store": op7_token_store,
        "op8_quality_rules": op8_quality_rules,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_sharding": op10_sharding,
        "op11_media": op11_media,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op4_minhash": OP4_SQL, "op5_line_dedup": OP5_SQL, "op6_decontamination": OP6_SQL, "op12_hard_negatives": OP12_SQL, "op13_prefix_trie": OP13_SQL}
