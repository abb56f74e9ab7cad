"""The registered queries of the training-data operators, with their DuckDB SQL where SQL can express them.

Each query reads its whole table, applies its operator with production parameters and derives the digest columns.
"""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, jaccard_join, language_id, line_dedup, mixing, nearest, packing, pii, quality, substring_dedup, vector_codes, warc, yinyang


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.predict(docs, language_id.train(docs))
    return found.select(F.col("id").alias("doc_id"), language_id.held_out(F.col("id")).alias("held_out"), "lang_pred", "score")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT keyed.doc_id, pos, line, common.k IS NOT NULL AND keyed.doc_id <> keeper AS gone FROM keyed LEFT JOIN common ON keyed.k = common.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP3_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM iw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM wins),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, item_id, i, n FROM places JOIN wins USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), 'mix-1')) AS o
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1]::DOUBLE AS w
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, 2.0::DOUBLE * source_size AS lim,
    coalesce(sum(2.0::DOUBLE * source_size) OVER below, 0) AS used, coalesce(sum(w) OVER below, 0) AS wused, sum(w) OVER () AS wall, 1.5::DOUBLE * sum(source_size) OVER () AS t
  FROM s WINDOW below AS (ORDER BY 2.0::DOUBLE * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT min_by(t - used, lim / w) AS left_, min_by(wall - wused, lim / w) AS mass FROM ordered WHERE (t - used) * w / (wall - wused) < lim
), targets AS (
  SELECT source, source_size, CASE WHEN left_ IS NULL OR left_ * w / mass >= lim THEN lim ELSE left_ * w / mass END AS target FROM ordered, level
), q AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) // source_size END AS whole,
    CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) % source_size END AS rest FROM targets
), placed AS (
  SELECT doc_id, size, source_size, target, whole, rest,
    coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized JOIN q ON sized.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM placed
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = quality.sample_ids(_table(spark, sf_dir, "labels").where(F.col("quality") == 1))
    found = quality.resample(_table(spark, sf_dir, "documents").select("doc_id", "text"), target, share=0.85)
    return found.select(F.col("id").alias("doc_id"), "n_grams", "log_weight", "score", "selected")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
-- Equal sets share a digest of their sorted shingles, so pairs are made between distinct sets only.
d AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS d FROM s GROUP BY doc_id),
rep AS (SELECT d, min(doc_id) AS rep FROM d GROUP BY d),
rs AS (SELECT s.doc_id, g FROM s JOIN rep ON s.doc_id = rep.rep),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM rs x JOIN rs y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, seen) AS (
  SELECT rep, rep FROM rep UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.seen = both_ways.a
), comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.component, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN d ON d.doc_id = w.doc_id LEFT JOIN rep ON rep.d = d.d LEFT JOIN comp ON comp.node = rep.rep
"""


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (
  SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)
), again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM wins) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS p FROM again),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
marked AS (SELECT words.*, gone.p IS NOT NULL AS lost FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p),
agg AS (
  SELECT doc_id, count(*) FILTER (WHERE lost) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT lost) AS kept FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN agg ON agg.doc_id = d.doc_id
"""


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"), *(f"n_{k}" for k in pii.KINDS), F.sha2(pii.spelled(F.col("base")), 256).alias("base_sha256"), pii.spelled(F.col("spans")).alias("spans")
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"))


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest AND payload_bytes >= 100
"""


def op11_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = yinyang.cluster(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    if found is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    sums = found.rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # a row a centroid
    digest = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(found.centroids.tolist())]
    named = spark.createDataFrame(digest, "cluster int, centroid_sha256 string").join(sums, "cluster").crossJoin(F.broadcast(sums.agg(F.sum("cluster_inertia").alias("inertia"))))
    return found.rows.join(F.broadcast(named), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op11_sql(k: int = 8, rounds: int = 10) -> str:
    """Lloyd's rounds unrolled, without bounds."""
    parts = [f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, sha256('3:' || vec_id) AS h, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), p AS MATERIALIZED (SELECT vec_id, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM v),
c0 AS MATERIALIZED (SELECT k, i, x FROM (SELECT vec_id, row_number() OVER (ORDER BY h) - 1 AS k FROM v QUALIFY k < {k}) JOIN p USING (vec_id))"""]
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, (array_agg(k ORDER BY d, k))[1] AS k, min(d) AS d
  FROM (SELECT vec_id, k, CAST(sum((p.x - c.x) * (p.x - c.x)) AS BIGINT) AS d FROM p JOIN c{r} c USING (i) GROUP BY vec_id, k) GROUP BY vec_id
)""")
        if r < rounds:
            parts.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT k, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (SELECT k, i, sum(x) AS s, count(*) AS n FROM a{r} JOIN p USING (vec_id) GROUP BY k, i)
  UNION ALL SELECT k, i, x FROM c{r} WHERE k NOT IN (SELECT k FROM a{r})
)""")
    return ",".join(parts) + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k) USING (k)
"""


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.encode(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    if found is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    # Nulls have a key of their own; labels are summed up before they meet their rows.
    key = (F.col("label").isNull().alias("none"), F.coalesce("label", F.lit(0)).alias("key"))
    sums = found.rows.groupBy(*key).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, found.codebooks.ravel().tolist())).encode()).hexdigest()
    rows = found.rows.select("vec_id", "code", "error", *key).join(sums, ["none", "key"])
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _op13_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd's rounds of every part unrolled, without bounds."""
    out = [f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), p AS MATERIALIZED (
  SELECT vec_id, x, i // w AS part, i % w AS pos FROM (SELECT vec_id, unnest(x) AS x, generate_subscripts(x, 1) - 1 AS i, len(x) // {parts} AS w FROM v)
), e0 AS MATERIALIZED (
  SELECT k, part, pos, x FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v QUALIFY k < {entries}) JOIN p USING (vec_id)
)"""]
    for r in range(rounds + 1):
        out.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, part, (array_agg(k ORDER BY d, k))[1] AS k, min(d) AS d
  FROM (SELECT vec_id, part, k, CAST(sum((p.x - e.x) * (p.x - e.x)) AS BIGINT) AS d FROM p JOIN e{r} e USING (part, pos) GROUP BY vec_id, part, k) GROUP BY vec_id, part
)""")
        if r < rounds:
            out.append(f"""
e{r + 1} AS MATERIALIZED (
  SELECT k, part, pos, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (SELECT k, part, pos, sum(x) AS s, count(*) AS n FROM a{r} JOIN p USING (vec_id, part) GROUP BY k, part, pos)
  UNION ALL SELECT k, part, pos, x FROM e{r} WHERE (part, k) NOT IN (SELECT (part, k) FROM a{r})
)""")
    return ",".join(out) + f""",
found AS (SELECT vec_id, string_agg(printf('%02x', CAST(k AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, k, pos)) FROM e{rounds}) AS codebooks_sha256
FROM found JOIN v USING (vec_id)
"""


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_mixing": op4_mixing,
    "op5_quality": op5_quality,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_nearest": op7_nearest,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_pii": op9_pii,
    "op10_warc": op10_warc,
    "op11_yinyang": op11_yinyang,
    "op12_packing": op12_packing,
    "op13_vector_codes": op13_vector_codes,
}
ORACLE = {
    "op2_line_dedup": OP2_SQL,
    "op3_decontaminate": OP3_SQL,
    "op4_mixing": OP4_SQL,
    "op6_jaccard_join": OP6_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op10_warc": OP10_SQL,
    "op11_yinyang": _op11_sql(),
    "op13_vector_codes": _op13_sql(),
}
