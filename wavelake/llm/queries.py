"""The registered queries of this subpackage: thin digests over the operators' own outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship_package

#: Piece model of the tokenizer queries; a parameter of the operator.
MODEL_NAME = "piece_bpe_32k.model"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL_NAME)


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table; with ``spread``, one of fewer file splits than cores (a small or a single file) is dealt to all cores."""
    ship_package(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents", spread=True).select("doc_id", "text"))


#: Bytes a shard may hold.
SHARD_BYTES = 1 << 20


def op2_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assign_shards(docs, SHARD_BYTES).drop("text")


def op7_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix_sources(docs).orderBy(F.col("position").asc_nulls_last(), "doc_id")
    places = [F.round(c, 3).alias(c) for c in ("position", "position_again")]
    return mixed.select("doc_id", "size", "source_size", "target", "taken", *places)


def op3_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors)


def op6_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import Scratch
    from .warc import read_archives, write_archives

    path = Scratch(spark, "warc").path("archive")
    write_archives(table(spark, sf_dir, "pages"), path)
    out = read_archives(spark, path)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text

    out = extract_text(table(spark, sf_dir, "pages", spread=True).select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_shared")


#: Bytes of a repeated string.
REPEAT_BYTES = 400
#: Words of a passage that may not repeat; passages of short words are under REPEAT_BYTES.
PASSAGE_WORDS = 51


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents", spread=True).select("doc_id", "text"), REPEAT_BYTES, words=PASSAGE_WORDS, apart=True)
    # the contract's columns go by bytes alone; text is what is left when repeated passages, of any length in bytes, go as well
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.col("kept_text").alias("text"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import encode_documents

    docs = table(spark, sf_dir, "documents", spread=True).select("doc_id", "text")
    out = encode_documents(docs, model_path()).drop("text")
    return out.select("doc_id", "n_tokens", F.sha2("ids_u32", 256).alias("ids_sha256"),
                      F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


#: A document is predicted good from this score on.
QUALITY_THRESHOLD = 0.3


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame):
    """Model from the labels of documents that are not held out."""
    from .quality import held_out, train

    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    return train(docs, labels)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import held_out, score_documents

    docs = table(spark, sf_dir, "documents", spread=True).select("doc_id", "text")
    scored = score_documents(docs, quality_model(spark, sf_dir, docs)).drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    docs = table(spark, sf_dir, "documents", spread=True).select("doc_id", "text")
    return scan_licenses(docs).drop("text")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op2_extendible_sharding": OP2_SQL, "op3_cover_tree_topk": OP3_SQL, "op4_warc_archive": OP4_SQL, "op7_curriculum_mix": OP7_SQL,
            "op11_license_scan": license_sql(), "op13_hard_negatives": OP13_SQL}


OP2_SQL = f"""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes,
  ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
l AS (SELECT d.*, CAST(r.range AS INTEGER) AS depth, h >> (60 - r.range) AS p FROM d, range(0, 61) r),
b AS (SELECT depth, p, sum(n_bytes) AS b FROM l GROUP BY depth, p),
f AS (SELECT l.doc_id, l.h, l.n_bytes, min(l.depth) AS depth FROM l JOIN b ON l.depth = b.depth AND l.p = b.p
  WHERE b.b <= {SHARD_BYTES} GROUP BY l.doc_id, l.h, l.n_bytes),
g AS (SELECT d.doc_id, CAST(d.n_bytes AS BIGINT) AS n_bytes, coalesce(f.depth, 60) AS depth, substr(lpad(bin(d.h), 60, '0'), 1, coalesce(f.depth, 60)) AS shard
  FROM d LEFT JOIN f ON f.doc_id = d.doc_id AND f.h = d.h)
SELECT doc_id, n_bytes, shard, CAST(depth AS INTEGER) AS depth, CAST(sum(n_bytes) OVER (PARTITION BY shard) AS BIGINT) AS shard_bytes,
  sum(n_bytes) OVER (PARTITION BY shard) > {SHARD_BYTES} AS oversized FROM g
"""

OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS hex, max(page_id) OVER (PARTITION BY b) AS top FROM p),
f AS (SELECT *, list_aggregate(list_transform(range(0, 40), lambda i: lpad(bin(('0x' || substr(hex, CAST(i + 1 AS INTEGER), 1))::INTEGER), 4, '0')), 'string_agg', '') AS bits FROM h)
SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, CAST(5 * i + j + 1 AS INTEGER), 1) AS INTEGER) << CAST(4 - j AS INTEGER))) AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM f
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i FROM s),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS most FROM r),
o AS (SELECT *, most / weight AS full_at, 1.5::DOUBLE * sum(source_size) OVER () AS want,
  coalesce(sum(most) OVER (ORDER BY most / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_from FROM w),
t AS (SELECT *, max(CASE WHEN (want - before) / weight_from <= full_at THEN (want - before) / weight_from END) OVER () AS level FROM o),
g AS (SELECT source, source_size, least(most, coalesce(weight * level, most)) AS target, CASE i % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS k FROM t),
k AS (SELECT *, sum(target * (1 - k)) OVER () AS clock_a, sum(target * k) OVER () AS clock_b FROM g),
c AS (SELECT d.doc_id, d.size, k.*, floor(k.target + 0.5) AS words, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS pos
  FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source),
a AS (SELECT *, greatest(0, least(size, words - pos)) AS once, greatest(0, least(size, words - source_size - pos)) AS again,
  least(1.0::DOUBLE, pos / target) AS x, least(1.0::DOUBLE, (pos + source_size) / target) AS y FROM c),
u AS (SELECT *, CASE WHEN k = 0 THEN x ELSE (k - 1 + sqrt((1 - k) * (1 - k) + 4 * k * x)) / (2 * k) END AS u,
  CASE WHEN k = 0 THEN y ELSE (k - 1 + sqrt((1 - k) * (1 - k) + 4 * k * y)) / (2 * k) END AS v FROM a)
SELECT doc_id, size, source_size, target, CAST(once + again AS BIGINT) AS taken, CASE WHEN once > 0 THEN round(clock_a * u + clock_b * u * u, 3) END AS position,
  CASE WHEN again > 0 THEN round(clock_a * v + clock_b * v * v, 3) END AS position_again FROM u
"""

OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id,
  p.positive_score, s.score AS negative_score FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 10
"""


def license_sql() -> str:
    """The licence scan as joins of words and postings, from the same templates."""
    import string

    from .licenses import BASE, RARE, SHARE, SLACK, TEMPLATES, WIDTH

    listed = lambda parts: "[" + ", ".join(f"'{p}'" for p in parts) + "]"
    notices = ", ".join(f"({i}, '{label}', {listed(text.split())}, {listed(phrases)})" for i, (label, text, phrases) in enumerate(TEMPLATES))
    base = ", ".join(f"('{label}', {listed(phrase.split())})" for phrase, label in BASE.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
u AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM d),
t(id, label, own, phrases) AS (VALUES {notices}),
b(label, own) AS (VALUES {base}),
places AS (SELECT d.r, b.label, u.i FROM b JOIN u ON u.w = b.own[1] JOIN d ON d.r = u.r AND d.words[u.i + 1: u.i + len(b.own)] = b.own),
p AS (SELECT id, unnest(own) AS w, generate_subscripts(own, 1) - 1 AS p FROM t),
n AS (SELECT w, count(DISTINCT r) AS n FROM u WHERE w IN (SELECT w FROM p) GROUP BY w),
k AS (SELECT id, least({RARE}, count(DISTINCT w)) AS k FROM p GROUP BY id),
ranked AS (SELECT c.*, row_number() OVER (PARTITION BY r, id ORDER BY n, w) AS place FROM (SELECT DISTINCT u.r, p.id, u.w FROM u JOIN p ON u.w = p.w) c JOIN n USING (w)),
rare AS (SELECT r, id, w, k FROM ranked JOIN k USING (id) WHERE place <= k QUALIFY count(*) OVER (PARTITION BY r, id) = k),
votes AS (SELECT rare.r, rare.id, rare.w, rare.k, u.i - p.p AS o FROM rare JOIN u ON u.r = rare.r AND u.w = rare.w JOIN p ON p.id = rare.id AND p.w = rare.w),
cells AS (SELECT r, id, w, k, 2 * CAST(floor(o / {WIDTH}.0) AS BIGINT) AS c FROM votes UNION ALL SELECT r, id, w, k, 2 * CAST(floor((o + {SLACK}) / {WIDTH}.0) AS BIGINT) + 1 FROM votes),
placed AS (SELECT r, id, k, c, count(DISTINCT w) AS n FROM cells GROUP BY r, id, k, c HAVING count(DISTINCT w) >= ceil(k * {SHARE} / 100.0)),
spans AS (SELECT placed.*, label, phrases, greatest(CAST(floor(c / 2.0) AS BIGINT) * {WIDTH} - CASE WHEN abs(c) % 2 = 1 THEN {SLACK} ELSE 0 END - {SLACK}, 0) AS first,
  len(own) + {WIDTH + 2 * SLACK} AS size FROM placed JOIN t USING (id)),
judged AS (SELECT spans.r, label, n / k AS share, len(list_filter(phrases, lambda x: NOT contains(' ' || array_to_string(d.words[first + 1: first + size], ' ') || ' ', ' ' || x || ' '))) = 0 AS ok
  FROM spans JOIN d USING (r)),
x AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY r),
y AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM places UNION SELECT r, label FROM judged WHERE ok) GROUP BY r),
z AS (SELECT r, max(CASE WHEN ok THEN share ELSE share / 2 END) AS share FROM judged GROUP BY r)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(x.n_base, 0) AS n_base, CAST(x.first_word AS BIGINT) AS first_word, CAST(x.last_word AS BIGINT) AS last_word,
  coalesce(x.labels, '') AS base_labels, coalesce(y.labels, '') AS labels, CASE WHEN x.r IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(z.share, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN x ON x.r = d.r LEFT JOIN y ON y.r = d.r LEFT JOIN z ON z.r = d.r
"""
