"""One query for each corpus operator, over whole tables, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod5, cut, table


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import matches, prepared

    docs = table(spark, sf_dir, "documents")
    return matches(docs, prepared(docs, table(spark, sf_dir, "benchmark")))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import join

    return join(table(spark, sf_dir, "documents"), n=4, percent=85).select("doc_id", "n_shingles", "component_id")


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [hash(ws)]
                             ELSE list_distinct([hash(ws[i:i + 3]) for i in generate_series(1, len(ws) - 3)]) END AS grams FROM w),
t AS (SELECT r, len(grams) AS n, unnest(grams) AS t FROM g),
l AS (SELECT a.r AS x, b.r AS y FROM t a JOIN t b ON a.t = b.t AND a.r < b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
p AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c AS (SELECT r, r AS reach FROM g UNION SELECT c.r, p.y FROM c JOIN p ON p.x = c.reach)
SELECT g.doc_id, CAST(len(g.grams) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id FROM c JOIN g ON g.r = c.r JOIN g o ON o.r = c.reach GROUP BY g.r, g.doc_id, g.grams
"""


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
                  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS HUGEINT) AS w FROM s0),
s2 AS (SELECT *, CAST(source_size AS HUGEINT) * 3 AS cap, CAST(source_size AS HUGEINT) * 18 // w AS ratio FROM s1),
s3 AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
       sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_rest FROM s2),
s4 AS (SELECT *, cap * w_rest <= rest * w AS capped FROM s3),
o AS (SELECT rest, w_rest FROM s4 WHERE NOT capped ORDER BY w_rest DESC LIMIT 1),
s5 AS (SELECT s4.source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(o.rest AS DOUBLE) * CAST(w AS DOUBLE) / CAST(o.w_rest AS DOUBLE) END AS target
       FROM s4 LEFT JOIN o ON true),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs FROM s5),
r0 AS (SELECT d.*, source_size, target, epochs, CAST(floor(target + 0.5) AS BIGINT) - epochs * source_size AS part,
              coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS upto,
              count(*) OVER (PARTITION BY d.source, key, size) AS copies
       FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + CASE WHEN upto <= part THEN size WHEN upto - size * copies >= part THEN 0
                                 ELSE (part - (upto - size * copies)) // copies END AS BIGINT) AS taken
FROM r0
"""

def op1_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages against a replica in which one page in 16 has its first byte changed and one in 16 is lost, by id hash."""
    from .fixity import archive, audit_hashed

    fate = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 1)
    flipped = F.when(F.substring("html", 1, 1) == "#", F.concat(F.lit("@"), F.expr("substring(html, 2)"))).otherwise(F.concat(F.lit("#"), F.expr("substring(html, 2)")))
    replica = F.when((fate == "0") & (F.length("html") > 0), flipped).when(fate == "1", F.lit(None)).otherwise(F.col("html"))
    return audit_hashed(*archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), replica))


OP1_SQL = r"""
WITH r AS (SELECT 'part-' || coalesce(CAST(CAST(floor(page_id / 1000.0) AS BIGINT) AS VARCHAR), 'none') AS file, page_id, html, 
                  'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || chr(13) || chr(10)
                  || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM pages),
o AS (SELECT file, page_id, html, CAST(strlen(rec) AS BIGINT) AS length,
             CAST(coalesce(sum(strlen(rec)) OVER (PARTITION BY file ORDER BY page_id, strlen(rec), sha256(rec) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM r)
SELECT file, "offset", length, page_id AS record_id, CASE left(md5(CAST(page_id AS VARCHAR)), 1) WHEN '0' THEN 'changed' ELSE 'missing' END AS status
FROM o WHERE (left(md5(CAST(page_id AS VARCHAR)), 1) = '0' AND length(html) > 0) OR (left(md5(CAST(page_id AS VARCHAR)), 1) = '1' AND html IS NOT NULL)
"""

def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import Model, count, identify

    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod5() == 0
    model = Model.fit(cut(count(docs, ~held_out), "trigrams"))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score", F.transform("language.languages", lambda x: x["lang"]).alias("languages"))


def op6_vector_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_join import join

    return join(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT r, label, v FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len([x for x in v if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in v if x <> 0]) > 0),
p AS (SELECT a.r AS x, b.r AS y FROM s a JOIN s b ON a.label = b.label AND len(a.v) = len(b.v) AND a.r <> b.r WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
c AS (SELECT r, r AS reach FROM e UNION SELECT c.r, p.y FROM c JOIN p ON p.x = c.reach),
m AS (SELECT c.r, min(o.vec_id) AS component_id FROM c JOIN e o ON o.r = c.reach GROUP BY c.r)
SELECT e.vec_id, (SELECT count(*) FROM p WHERE p.x = e.r) AS n_links, m.component_id, coalesce(e.vec_id = m.component_id, false) AS kept FROM e JOIN m ON m.r = e.r
"""

def op8_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import features, fit, score

    held_out = crc_mod5() == 0
    labels = table(spark, sf_dir, "labels").filter("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    rows = features(table(spark, sf_dir, "documents")).join(labels, "doc_id", "left")
    rows = cut(rows.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(~held_out & F.col("good"), F.lit(False)).alias("positive"), "x"), "quality")
    return score(rows, fit(rows)).withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fuzzy_lines import dedup

    lines = dedup(table(spark, sf_dir, "documents"))
    kept = F.col("kept") & F.col("place").isNotNull()
    counts = [F.count("place").alias("n_lines"), F.count_if(kept).alias("n_kept"), F.sum(F.when(kept, F.col("chars")).otherwise(0)).alias("n_chars_kept")]
    return lines.groupBy("doc_id").agg(*counts, F.sort_array(F.collect_list(F.when(~F.col("kept"), F.col("place")))).alias("removed"))


def op10_pack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import digest, pack

    return digest(pack(table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_fixity_audit": op1_fixity_audit, "op2_decontaminate": op2_decontaminate, "op3_ngram_jaccard": op3_ngram_jaccard, "op4_mix_sources": op4_mix_sources, "op5_language_mixture": op5_language_mixture, "op6_vector_pigeonhole": op6_vector_pigeonhole, "op7_html_main_text": op7_html_main_text, "op8_quality_pu": op8_quality_pu, "op9_fuzzy_lines": op9_fuzzy_lines, "op10_pack_rows": op10_pack_rows, "pipeline": pipeline}
SQL: dict[str, str] = {"op1_fixity_audit": OP1_SQL, "op3_ngram_jaccard": OP3_SQL, "op4_mix_sources": OP4_SQL, "op6_vector_pigeonhole": OP6_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
