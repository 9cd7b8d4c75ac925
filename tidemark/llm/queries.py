"""The queries of the training-data operators and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, decontaminate, divergence, html_extract, language_id, line_dedup, lm_score, near_dedup, packing, pii, prefix_trie, quality, warc
from tidemark.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in an exact occurrence of a ten-word window of the benchmark."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce(F.transform("items", lambda i: i.cast("string")), F.array().cast("array<string>"))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s : s + 9], ' ') AS g
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS g
       FROM (SELECT r, w, n.n, unnest(generate_series(1, len(w) - n.n + 1)) AS s FROM d, n WHERE len(w) >= n.n)),
m AS (SELECT r, s, n, item_id FROM dw JOIN bw USING (n, g)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM m) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by trees fitted on the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        quality.held_out().alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that stand elsewhere before; a null text stays null."""
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "text", "n_chunks", "n_removed", "removed_lines", "removed_chars")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: what the rules find, and all spans."""
    found = pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(pii.of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicates of every document; the smallest id of each is kept."""
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    kept = F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True))
    return found.select(F.col("_id").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
k AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN k ON k.a = d.doc_id
"""


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0))


OP6_SQL = r"""
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(generate_series(1, len(q.e)), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages as read back from the WARC files that they were written to."""
    found = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return found.select(
        F.col("name").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        F.col("refers_to_name").cast("long").alias("refers_to"),
    )


OP8_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(generate_series(0, 31), lambda k:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (1 + 10 * (k // 8))::INT, 10))::BIGINT >> (35 - 5 * (k % 8))::INT) & 31)::INT + 1, 1)), '') AS payload_digest FROM h),
f AS (SELECT payload_digest, payload_bytes, min(page_id) AS first FROM b GROUP BY 1, 2)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b JOIN f USING (payload_digest, payload_bytes)
"""


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean log score of every document under the trigram counts of all other documents."""
    found = lm_score.score(table(spark, sf_dir, "documents"))
    mean = F.round(F.coalesce(F.try_divide("log_score", "n_words"), F.lit(0.0)), 6)
    return found.select(F.col("_id").alias("doc_id"), "n_words", "n_unseen", mean.alias("mean_log_score"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, cut at powers of two of at most 2048 tokens."""
    import public_tokenizers

    packed = packing.pack(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False
    )
    return packed.withColumnRenamed("_id", "doc_id")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of every source to the others of its language, and its most over-represented terms."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations, rebuilt so that up to eight first turns are those of another one."""
    turns, ids = prefix_trie.rebuilt(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(turns, ids)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by profiles of the documents outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = docs.where(F.col("doc_id").isNotNull() & ~language_id.held_out())
    found = language_id.detect(docs, language_id.profiles(learned))
    return found.select(F.col("_id").alias("doc_id"), language_id.held_out("_id").alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_quality": op2_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_pii": op4_pii,
    "op5_near_dedup": op5_near_dedup,
    "op6_nearest": op6_nearest,
    "op7_html": op7_html,
    "op8_warc": op8_warc,
    "op9_lm_score": op9_lm_score,
    "op10_packing": op10_packing,
    "op11_source_divergence": op11_source_divergence,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_language_id": op13_language_id,
}

ORACLE_SQL = {
    "op1_decontamination": OP1_SQL,
    "op3_line_dedup": line_dedup.ORACLE,
    "op5_near_dedup": OP5_SQL,
    "op6_nearest": OP6_SQL,
    "op8_warc": OP8_SQL,
    "op9_lm_score": lm_score.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
}
