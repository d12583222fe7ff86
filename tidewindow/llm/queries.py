"""The registered queries of the operators, and their DuckDB statements where SQL can express them."""

from pyspark.sql import functions as F

from tidewindow.llm import (
    collocations, conversation_repair, exact_dedup, fingerprints, language_id, licenses, mixing, packing, simhash, suffix_dedup,
    topk, toxicity, warc,
)


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark, sf_dir):
    return mixing.mix_sizes(_documents(spark, sf_dir))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.dedup_decisions(_documents(spark, sf_dir))


def op3_language_id(spark, sf_dir):
    return language_id.identify(_documents(spark, sf_dir))


def op4_packing(spark, sf_dir):
    return packing.pack(_documents(spark, sf_dir))


def op5_simhash(spark, sf_dir):
    rows = simhash.near_components(_documents(spark, sf_dir))
    return rows.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op6_licenses(spark, sf_dir):
    return licenses.scan_licenses(_documents(spark, sf_dir))


def op7_suffix_dedup(spark, sf_dir):
    rows = suffix_dedup.cut_repeats(_documents(spark, sf_dir))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_topk(spark, sf_dir):
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op9_warc(spark, sf_dir):
    manifest = warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read_archives(manifest).drop("url", "payload")


def op10_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_conversation_repair(spark, sf_dir):
    return conversation_repair.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(_documents(spark, sf_dir))


def op13_collocations(spark, sf_dir):
    return collocations.collocations(_documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_exact_dedup, op3_language_id, op4_packing, op5_simhash, op6_licenses, op7_suffix_dedup, op8_topk, op9_warc,
        op10_toxicity, op11_conversation_repair, op12_fingerprints, op13_collocations,
    )
}

EXACT_DEDUP_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
g AS (SELECT payload_digest, payload_bytes, max(page_id) AS keep_id FROM d WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id < keep_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < keep_id THEN keep_id END AS refers_to
FROM d LEFT JOIN g USING (payload_digest, payload_bytes)
"""

TOPK_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

COLLOCATIONS_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, ws, i, unnest(range(1, least(5, len(ws) - i + 1) + 1)) AS m FROM s),
counts AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE m = 1 GROUP BY lang),
f AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS ws FROM counts WHERE f >= 100),
c AS (SELECT lang, m, phrase, f AS a, ws FROM f WHERE m > 1),
cuts AS (SELECT c.*, k, array_to_string(ws[1:k], ' ') AS p1, array_to_string(ws[k + 1:], ' ') AS p2
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c),
scores AS (SELECT cuts.lang, cuts.phrase, cuts.m, a, x.f AS l, y.f AS r, n, k,
    CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = p1 JOIN f y ON y.lang = cuts.lang AND y.phrase = p2
  JOIN totals t ON t.lang = cuts.lang),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (SELECT DISTINCT lang, f, array_to_string(ws[i:i + z - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, m - z + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS z FROM f WHERE m > 2))),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_phrases i
  WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.f >= 100 * b.a))
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *,
  row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""

ORACLES = {"op8_topk": TOPK_SQL, "op2_exact_dedup": EXACT_DEDUP_SQL, "op9_warc": WARC_SQL, "op13_collocations": COLLOCATIONS_SQL}
