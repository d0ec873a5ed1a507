"""Registered queries of the operators, each over its whole table, and SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..session import scratch_path
from . import align, embeddings, lm, mixing, packing, pieces, pii, quality, repeats, simhash, tokens, toxicity, treap
from .common import read_table

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


@query("op3_toxicity")
def _(spark, d):
    out = toxicity.toxicity(read_table(spark, d, "documents"), read_table(spark, d, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "n_hits")


WORD = r"[^\x20\x09-\x0D]+"
OP10 = rf"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents),
 words AS (SELECT k, regexp_extract_all(text, '{WORD}') AS w FROM docs),
 lines AS (SELECT k, SUM(n - 1) AS n_dup_lines FROM (
   SELECT k, line, COUNT(*) AS n FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM docs)
   WHERE regexp_matches(line, '{WORD}') GROUP BY 1, 2) GROUP BY 1),
 windows AS (SELECT k, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)),
 twice AS (SELECT k, i FROM (SELECT k, i, COUNT(*) OVER (PARTITION BY k, g) AS n FROM windows) WHERE n >= 2),
 covered AS (SELECT k, COUNT(DISTINCT i + j) AS n_repeat_words FROM twice, range(0, 8) t(j) GROUP BY 1),
 measured AS (SELECT docs.k, doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
   FROM docs JOIN words USING (k) LEFT JOIN lines USING (k) LEFT JOIN covered USING (k)),
 judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured),
 ruled AS (SELECT *, base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_words
   OR word_chars / greatest(n_words, 1) < 2 OR word_chars / greatest(n_words, 1) > 15 AS failed FROM judged),
 hosts AS (SELECT source, COUNT(*) AS n, SUM(CAST(failed AS INT)) AS fails FROM ruled GROUP BY 1),
 moments AS (SELECT SUM(fails) / SUM(n) AS p, SUM(n * pow(fails / n, 2)) / SUM(n) - pow(SUM(fails) / SUM(n), 2) AS v, COUNT(*) / SUM(n) AS i FROM hosts),
 strength AS (SELECT p, CASE WHEN p * (1 - p) > 0 THEN greatest(p * (1 - p) / greatest(v - p * (1 - p) * i, p * (1 - p) * 1e-6) - 1, 1e-3) ELSE 1 END AS s FROM moments)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
 CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
 NOT base_failed AND (fails + p * s) / (n + s) <= 0.5 AS kept
FROM ruled JOIN hosts ON ruled.source IS NOT DISTINCT FROM hosts.source, strength"""


@query("op10_host_quality", OP10)
def _(spark, d):
    out = quality.apply_host_rules(read_table(spark, d, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op1_simhash")
def _(spark, d):
    groups = simhash.near_groups(read_table(spark, d, "documents"))
    return groups.select("doc_id", simhash.as_hex().alias("fingerprint"), "component_id")


@query("op2_pii")
def _(spark, d):
    found = pii.find(read_table(spark, d, "documents"))
    return found.select(
        "doc_id", *[pii.count_kind(k).alias(f"n_{k}") for k in pii.KINDS], F.sha2(pii.as_text("base"), 256).alias("base_sha256"),
        pii.as_text("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_found"))


MIX_WEIGHTS = {"src0": 8, "src1": 4, "src2": 4, "src3": 2}
OP9 = f"""
WITH RECURSIVE sizes AS (SELECT source, COUNT(*) AS n, CASE source {' '.join(f"WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS.items())} ELSE 1 END AS weight FROM documents GROUP BY 1),
 packed AS (SELECT list(source ORDER BY source NULLS FIRST) AS s, list(weight ORDER BY source NULLS FIRST) AS w, CAST(SUM(weight) AS BIGINT) AS q FROM sizes),
 run AS (
  SELECT CAST(-1 AS BIGINT) AS t, [CAST(0 AS BIGINT) for x in w] AS done, CAST(0 AS BIGINT) AS pick FROM packed
  UNION ALL
  SELECT t, [done[i] + CASE WHEN i = pick THEN 1 ELSE 0 END for i in range(1, len(done) + 1)], pick FROM (
   SELECT t + 1 AS t, done, list_aggregate([CASE WHEN done[i] * q // w[i] <= t + 1
     THEN ((done[i] + 1) * q + w[i] - 1) // w[i] * 1000000 + i END for i in range(1, len(w) + 1)], 'min') % 1000000 AS pick FROM run, packed WHERE t + 1 < q)),
 plan AS (SELECT s[pick] AS source, w[pick] AS weight, q, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM run, packed WHERE t >= 0),
 horizon AS (SELECT MIN((b // p.weight) * q + slot) AS h FROM plan p JOIN (SELECT *, (n + 31) // 32 AS b FROM sizes) z
   ON p.source IS NOT DISTINCT FROM z.source AND k = b % p.weight),
 ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS r FROM documents)
SELECT doc_id, r.source, CAST(r // 32 AS BIGINT) AS block, CAST(r % 32 AS BIGINT) AS row_in_block, CAST((r // 32) // weight * q + slot AS BIGINT) AS mix_slot,
 CAST((r // 32) * q // weight AS BIGINT) AS release_slot, CAST(((r // 32 + 1) * q + weight - 1) // weight AS BIGINT) AS deadline_slot, (r // 32) // weight * q + slot < h AS in_mix
FROM ranked r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source AND (r // 32) % weight = k, horizon"""


@query("op9_mixing", OP9)
def _(spark, d):
    mixed = mixing.mix(read_table(spark, d, "documents").select("doc_id", "source"), MIX_WEIGHTS)
    return mixed.select("doc_id", "source", "block", "row_in_block", "mix_slot", "release_slot", "deadline_slot", "in_mix")


@query("op5_packing")
def _(spark, d):
    return packing.pack(read_table(spark, d, "documents"))


@query("op8_embedding_dedup")
def _(spark, d):
    return embeddings.near_vectors(read_table(spark, d, "embeddings"))


@query("op4_repeats")
def _(spark, d):
    return repeats.remove_repeats(read_table(spark, d, "documents")).drop("kept")


@query("op7_lm_scores")
def _(spark, d):
    return lm.language_scores(read_table(spark, d, "documents"))


@query("op6_token_counts")
def _(spark, d):
    return tokens.document_token_counts(read_table(spark, d, "documents"), scratch_path(spark, "token-files"))


@query("op13_sentencepiece")
def _(spark, d):
    done = pieces.encode_decode(read_table(spark, d, "documents"))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op11_alignment")
def _(spark, d):
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    done = align.align(read_table(spark, d, "documents"), groups=digest)
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"), "n_pairs")


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12 = f"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({LOWER}, '{TERM}') AS w FROM documents WHERE text IS NOT NULL),
 lengths AS (SELECT k, doc_id, len(w) AS n_terms FROM docs WHERE len(w) > 0),
 total AS (SELECT COUNT(*) AS N, SUM(n_terms) AS L FROM lengths),
 asked AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all({LOWER}, '{TERM}')) AS term FROM benchmark),
 counts AS (SELECT k, term, COUNT(*) AS tf FROM (SELECT k, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
 weights AS (SELECT term, CAST(floor(1000 * ln((2 * N + 2) / (2 * COUNT(*) + 1))) AS BIGINT) AS weight FROM counts, total GROUP BY term, N),
 scored AS (SELECT item_id, text, doc_id, SUM(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n_terms * N) // L)))) AS score
   FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (k), total GROUP BY item_id, text, k, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) <= 50"""


@query("op12_ranked_search", OP12)
def _(spark, d):
    return treap.ranked(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"))
