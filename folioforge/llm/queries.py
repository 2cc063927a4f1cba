"""The registered queries of this subpackage (opN_<name>, pipeline) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontam, divergence, fertility, fingerprint, langid, mil, minhash, packing, pii, secrets, tokenstore, toxicity
from .common import crc_of, labelled_sample, new_folder
from .spans import joined

#: A-Z and a-z, as DuckDB's translate takes them.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT item_id, least(len(w), 10) AS size, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda k: array_to_string(w[k:k + least(len(w), 10) - 1], ' '))) AS t
  FROM i WHERE len(w) > 0
), dw AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS s, unnest(list_transform(range(1, len(w) - size + 2), lambda k: array_to_string(w[k:k + size - 1], ' '))) AS t
  FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size
), h AS (SELECT DISTINCT doc_id, item_id, s, dw.size FROM dw JOIN iw USING (size, t)),
p AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS x FROM h) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
  sha256(coalesce(n.items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def _counted(df: DataFrame, base: str, spans: str, kinds: tuple[str, ...]) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return df.select("doc_id", *map(count, kinds), F.sha2(joined(F.col(base)), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans"))


def op2_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(pii.personal_data(table(spark, sf_dir, "documents")), "base", "spans", pii.BASE_KINDS)


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in two increments: sources whose name has an even hash come first; when the others have come too, the whole table
    is scanned against the stored ledger of the first, which leaves the pairs of blob and rule version that it lacks."""
    docs = table(spark, sf_dir, "documents")
    _, ledger = secrets.scan(docs.filter(F.coalesce(F.crc32(F.col("source").cast("binary")), F.lit(0)) % 2 == 0), ["doc_id"])
    found, _ = secrets.scan(docs, ["doc_id"], ledger)
    kinds = tuple(r.name for r in secrets.BASE)
    base = F.filter("findings", lambda x: x["kind"].isin(*kinds))
    return _counted(found.withColumn("base", base), "base", "findings", kinds)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


OP4_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = s.doc_id
"""


def op5_nearest_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(*langid.training_sample(docs, crc_of("doc_id") % 4 != 2))
    found = langid.identify(docs, model)
    return found.select("doc_id", (crc_of("doc_id") % 4 == 2).alias("held_out"), "lang_pred", "score", "distance", "rejected")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = new_folder(spark, "token-store")
    tokenstore.write(table(spark, sf_dir, "documents"), store, public_tokenizers.path("word_bpe_49k.json"), keeps_spaces=False, end_id=2)
    return tokenstore.read_digests(spark, store)


def op7_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fertility.judged(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json"), group_col="lang")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "bytes_chars_per_token", "byte_share", "entropy")


def op8_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    training = crc_of("doc_id") % 5 != 0
    texts, known = labelled_sample(docs, labels, "toxic", training, toxicity.PER_CLASS, toxicity.MAX_CHARS)
    share = labels.filter(training).agg(F.avg("toxic")).first()[0]
    found = toxicity.score(docs, toxicity.fit(texts, known, 0.5 if share is None else float(np.clip(share, 0.001, 0.999))))
    return found.select("doc_id", (crc_of("doc_id") % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: Documents as instruction data: every second line is a reply, and a sequence holds eight documents and 1280 tokens of replies at most.
INSTRUCTION = packing.Limits(tokens=2048, segments=8, loss=1280)


def op9_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keeps_spaces=True, end_id=1, limits=INSTRUCTION, loss=packing.reply_share, with_ids=False)


def quality_model(spark: SparkSession, sf_dir: str) -> dict:
    """The quality classifier, learned from labelled documents whose id's crc32 is not divisible by 5."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return mil.fit(*labelled_sample(docs, labels, "quality", crc_of("doc_id") % 5 != 0, mil.PER_CLASS, mil.MAX_CHARS))


def op10_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mil.score(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return found.select("doc_id", (crc_of("doc_id") % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY ALL),
g AS (
  SELECT x.lang, x.source, coalesce(any_value(v.v), 0) AS v, coalesce(sum(y.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN v ON v.lang = x.lang
  LEFT JOIN (SELECT c.lang, c.source, c.n FROM c JOIN k USING (lang, term)) y ON y.lang = x.lang AND y.source = x.source GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (g.n + 5 * g.v) AS p
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), q AS (SELECT k.lang, k.term, 1 + (CAST(1000000000 AS HUGEINT) * (k.n + 5)) // (v.n + 5 * v.v) AS q FROM k JOIN v USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q
)
SELECT * FROM (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found
) WHERE part = 'pair' OR rank <= 50
"""


def op12_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared(table(spark, sf_dir, "documents"))


def op13_annulus_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3)


def _op13_sql() -> str:
    """Three rounds over all vectors and centroids, then the last assignment."""
    parts = [
        """v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v AS m FROM v ORDER BY c LIMIT 16)"""
    ]
    distance = "list_sum(list_transform(list_zip(v.v, k.m), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS HUGEINT)))"
    for n in range(4):
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.r, k.c, {distance} AS d FROM v, c{n} k) GROUP BY r)")
        if n < 3:
            each = f"SELECT a.c, u.j, sum(v.v[u.j]) AS s, count(*) AS n FROM a{n} a JOIN v USING (r), (SELECT unnest(range(1, 65)) AS j) u GROUP BY a.c, u.j"
            parts.append(f"m{n} AS (SELECT c, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY j) AS m FROM ({each}) GROUP BY c)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT k.c, coalesce(m.m, k.m) AS m FROM c{n} k LEFT JOIN m{n} m ON m.c = k.c)")
    return f"""WITH {", ".join(parts)}
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.m, ',')) AS centroid_sha256
FROM a3 a JOIN v USING (r) JOIN c3 k ON k.c = a.c"""


OP13_SQL = _op13_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_winnowing_decontamination": op1_winnowing_decontamination,
        "op2_weak_supervision_pii": op2_weak_supervision_pii,
        "op3_secret_ledger": op3_secret_ledger,
        "op4_minhash_near_dedup": op4_minhash_near_dedup,
        "op5_nearest_centroid_language": op5_nearest_centroid_language,
        "op6_token_store": op6_token_store,
        "op7_tokeniser_fertility": op7_tokeniser_fertility,
        "op8_subword_toxicity": op8_subword_toxicity,
        "op9_vector_packing": op9_vector_packing,
        "op10_attention_quality": op10_attention_quality,
        "op11_source_divergence": op11_source_divergence,
        "op12_chunk_fingerprints": op12_chunk_fingerprints,
        "op13_annulus_centroids": op13_annulus_centroids,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_winnowing_decontamination": OP1_SQL,
        "op4_minhash_near_dedup": OP4_SQL,
        "op11_source_divergence": OP11_SQL,
        "op13_annulus_centroids": OP13_SQL,
    }
