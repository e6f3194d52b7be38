"""The contract's queries: thin digests of the operators over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopflux.llm import centroids, conversations, decontamination, fingerprints, language_model, licenses, line_dedup, mixing, neardup, packing, sharding, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_hash", "h1", "h2")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("cut_spans", lambda s: F.concat_ws("-", s["s"].cast("string"), s["e"].cast("string"))), ",")
    return done.select("doc_id", F.col("cut_words").cast("long").alias("cut_words"), spans.alias("cut_spans"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_crc32"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = lambda n: dict.fromkeys(range(n), 1.0)
    done = sharding.shard(_table(spark, sf_dir, "documents"), even(8), more=even(9))
    return done.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = warc.derivatives(_table(spark, sf_dir, "pages"))
    return done.select(*(c for c in done.columns if c != "record"), F.octet_length("record").cast("long").alias("record_bytes"), F.crc32("record").alias("record_crc32"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations")
    return conversations.repair_digests(conversations.damage(given), given)


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.cluster_vectors(_table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_minhash_near_dedup, op2_packing, op3_license_scan, op4_line_dedup, op5_toxicity, op6_document_fingerprints, op7_sharding, op8_warc_derivatives, op9_benchmark_decontamination, op10_lm_scoring, op11_conversation_repair, op12_source_mixing, op13_centroid_clustering)
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE_WORDS = rf"list_filter(string_split_regex({_LOW}, '[\x20\x09-\x0D]+'), lambda x : x <> '')"
_ALNUM_WORDS = rf"list_filter(string_split_regex({_LOW}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x : x <> '')"

_UNITS = "CASE WHEN {1} > 0 THEN floor(greatest(least({0} / {1} * 1073741824.0::DOUBLE, 3221225472.0::DOUBLE), 0.0::DOUBLE))::BIGINT ELSE 0 END"
_COPIES = "((((i + 1 - start) >> 30) * each) + ((((i + 1 - start) & 1073741823) * each + shift) >> 30)) - ((((i - start) >> 30) * each) + ((((i - start) & 1073741823) * each + shift) >> 30))"


def _classes(last: int) -> str:
    """States of the sources s0, s1, ... before each class of sizes, each from what the class before it takes."""
    units = _UNITS.format("lft", "size")
    each = f"CASE WHEN 3 * (size - coalesce(words, 0)) >= lft THEN 0 ELSE {units} END"
    state = (
        "e{0} AS MATERIALIZED (SELECT q.source, start, lft, size, shift, coalesce(n, 0) AS n, coalesce(words, 0)::BIGINT AS words, {1} AS each FROM q{0} q LEFT JOIN k ON k.source IS NOT DISTINCT FROM q.source AND k.class = {0})"
    )
    after = (
        ", q{1} AS MATERIALIZED (SELECT e.source, start + n AS start, lft - coalesce(taken, 0) AS lft, size - words AS size, ((n & 1073741823) * each + shift) & 1073741823 AS shift FROM e{0} e "
        "LEFT JOIN (SELECT n.source, sum(({2}) * n.size)::BIGINT AS taken FROM n JOIN e{0} e ON e.source IS NOT DISTINCT FROM n.source WHERE class = {0} GROUP BY n.source) t ON t.source IS NOT DISTINCT FROM e.source)"
    )
    return ", ".join(state.format(i, units if i else each) + (after.format(i, i + 1, _COPIES) if i < last else "") for i in range(last + 1))


def _rounds(k: int, rounds: int) -> str:
    """Assignments a0, a1, ... (vec_id, v, d, c) and centroids c1, c2, ... (c, w) from v and c0."""
    assign = "a{0} AS MATERIALIZED (SELECT vec_id, v, b.d, b.c FROM (SELECT vec_id, any_value(v) AS v, min({{'d': list_sum(list_transform(list_zip(v, w), lambda z : (z[1] - z[2]) * (z[1] - z[2]))), 'c': c}}) AS b FROM v, c{0} GROUP BY vec_id))"
    update = (
        "c{1} AS MATERIALIZED (SELECT o.c, coalesce(m.w, o.w) AS w FROM c{0} o LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS w FROM "
        "(SELECT c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{0}, range(1, 65) r(i) GROUP BY c, i) GROUP BY c) m USING (c))"
    )
    return ", ".join(x for i in range(rounds) for x in (assign.format(i), update.format(i, i + 1))) + ", " + assign.format(rounds)


#: Queries that DuckDB can answer too.  The others rest on hashes, tokenizers or models that it lacks.
ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_SPACE_WORDS} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(greatest(len(w) - 4, 1)), lambda i : array_to_string(w[i + 1:i + 5], ' '))) END AS s FROM w),
x AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * n >= 85 * (len(sa.s) + len(sb.s) - n)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(v, m) USING KEY (v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, min(c.m) FROM c JOIN e ON e.a = c.v LEFT JOIN recurring.c k ON k.v = e.b WHERE c.m < k.m GROUP BY e.b)
SELECT doc_id, len(s)::BIGINT AS n_shingles, m AS component_id, doc_id = m AS kept FROM s JOIN c ON v = doc_id""",
    "op7_sharding": """
WITH RECURSIVE z(n, c, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT n, xor(c >> 1, 3988292384 * (c & 1)), k + 1 FROM z WHERE k < 8),
t AS MATERIALIZED (SELECT list(c ORDER BY n) AS t FROM z WHERE k = 8),
d AS MATERIALIZED (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h : ('0x' || h)::BIGINT)), lambda c, b : xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM documents, t),
h AS (SELECT DISTINCT doc_id, s, ('0x' || substr(md5(doc_id::VARCHAR || ':' || s), 1, 12))::BIGINT AS draw FROM documents, range(9) r(s)),
g AS (SELECT doc_id, arg_max(s, draw) FILTER (s < 8) AS shard, arg_max(s, draw) AS grown FROM h GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, grown::INTEGER AS grown_shard FROM d JOIN g USING (doc_id)""",
    "op9_benchmark_decontamination": f"""
WITH w AS MATERIALIZED (SELECT doc_id, {_ALNUM_WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT item_id::VARCHAR AS item_id, {_ALNUM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
g AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 13) AS n, w[i + 1:i + 13] AS g FROM b, unnest(range(greatest(len(w) - 12, 1))) r(i) WHERE len(w) > 0),
f AS MATERIALIZED (SELECT doc_id, i, g.n, g.item_id FROM (SELECT doc_id, n, i, w[i + 1:i + n] AS g FROM w, (SELECT DISTINCT n FROM g) k, unnest(range(greatest(len(w) - n + 1, 0))) r(i)) x JOIN g ON g.n = x.n AND g.g = x.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM f, unnest(range(i, i + n)) r(p) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM f GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(array_to_string(coalesce(items, []), ',')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op12_source_mixing": rf"""
WITH d AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS draw FROM documents),
s AS MATERIALIZED (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
p AS (SELECT *, (SELECT sum(source_size)::BIGINT FROM s) - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lft, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS shr, row_number() OVER o AS n FROM s WINDOW o AS (ORDER BY source_size::DOUBLE / w, source)),
l AS (SELECT lft, shr FROM p WHERE 3 * source_size * shr >= w * lft ORDER BY n LIMIT 1),
t AS MATERIALIZED (SELECT source, source_size, CASE WHEN 3 * source_size * shr < w * lft THEN 3.0::DOUBLE * source_size ELSE (w * lft)::DOUBLE / shr::DOUBLE END AS target FROM s, l),
n AS MATERIALIZED (SELECT d.*, source_size, target, CASE WHEN size > target THEN 0 WHEN size * 4 > target THEN 1 WHEN size * 16 > target THEN 2 WHEN size * 64 > target THEN 3 ELSE 4 END AS class, row_number() OVER (PARTITION BY d.source ORDER BY size DESC, draw) - 1 AS i FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
k AS MATERIALIZED (SELECT source, class, count(*) AS n, sum(size)::BIGINT AS words FROM n GROUP BY source, class),
q0 AS (SELECT source, 0::BIGINT AS start, target AS lft, source_size AS size, ('0x' || substr(md5('12:' || coalesce(source, '')), 1, 7))::BIGINT * 4 AS shift FROM t), {_classes(4)},
e AS ({" UNION ALL ".join(f"SELECT source, {i} AS class, start, each, shift FROM e{i}" for i in range(5))}),
x AS (SELECT doc_id, size, source_size, target, {_COPIES} AS copies FROM n JOIN e ON e.source IS NOT DISTINCT FROM n.source AND e.class = n.class)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM x""",
    "op13_centroid_clustering": f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x : floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x : x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v AS w FROM v ORDER BY sha256('3:' || vec_id) LIMIT 8), {_rounds(8, 10)},
i AS (SELECT c, sum(d)::BIGINT AS cluster_inertia FROM a10 GROUP BY c)
SELECT vec_id, a10.c::INTEGER AS cluster, d::BIGINT AS distance, cluster_inertia, (SELECT sum(d)::BIGINT FROM a10) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256 FROM a10 JOIN c10 USING (c) JOIN i USING (c)""",
}
