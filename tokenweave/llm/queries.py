"""The corpus operators applied, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontamination, html_text, jaccard_join, lattice_lm, quality_rules, sentencepieces, sharding, substring_dedup, token_counts, token_files
from .store import fresh_path

BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(table(spark, sf_dir, "documents"), fresh_path(spark, "tokens"), public_tokenizers.path(BPE), END_ID)
    return files.read(spark)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed_words(table(spark, sf_dir, "documents"), window=20)


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.lm_scores(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judged(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "similarity")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_components(table(spark, sf_dir, "documents"), size=3, percent=90)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.encoded_lengths(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE))
    return token_counts.context_table(token_counts.length_histogram(lengths))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_files, op2_substring_dedup, op3_lattice_lm, op4_quality_rules, op5_decontamination, op6_html_text, op7_sharding, op8_jaccard_join, op9_token_counts, op10_sentencepiece)
}

#: Words of a text, A-Z lower-cased, as a list.
_LOWER_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, s, array_to_string(w[s + 1 : s + 20], ' ') AS q FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS s FROM d)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY q ORDER BY doc_id, s) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM r),
k AS (SELECT d.doc_id, i, w[i + 1] AS word FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d) d ANTI JOIN c ON c.doc_id = d.doc_id AND c.p = d.i),
t AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
""",
    "op5_decontamination": f"""
WITH d AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_LOWER_WORDS} AS w FROM benchmark),
ds AS (SELECT doc_id, n, p, array_to_string(w[p + 1 : p + 5], ' ') AS q FROM (SELECT doc_id, w, len(w) AS n, unnest(range(0, len(w) - 4)) AS p FROM d)),
bs AS (SELECT item_id, m, q, count(*) AS k FROM (SELECT item_id, m, array_to_string(w[p + 1 : p + 5], ' ') AS q FROM (SELECT item_id, w, len(w) AS m, unnest(range(0, len(w) - 4)) AS p FROM b)) GROUP BY ALL),
seed AS (SELECT DISTINCT doc_id, item_id, n, m, least(n, m) AS l, p FROM ds JOIN bs USING (q)),
win AS (SELECT DISTINCT doc_id, item_id, m, l, s FROM (SELECT doc_id, item_id, m, l, unnest(range(greatest(0, p - (l - 5)), least(p, n - l) + 1)) AS s FROM seed)),
cnt AS (SELECT win.doc_id, item_id, m, l, s, q, count(*) AS c FROM win JOIN ds ON ds.doc_id = win.doc_id AND ds.p BETWEEN s AND s + l - 5 GROUP BY ALL),
both_ AS (SELECT doc_id, item_id, m, l, s, sum(least(c, k)) AS common FROM cnt JOIN bs USING (item_id, q, m) GROUP BY ALL),
sim AS (SELECT doc_id, item_id, s, l, common / (l + m - 8 - common) AS similarity FROM both_)
SELECT doc_id, item_id, s AS start, l AS n_words, similarity FROM sim WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) = 1
""",
    "op8_jaccard_join": f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i + 1 : i + 3], ' ')) AS q FROM (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS i FROM d)
  UNION ALL SELECT doc_id, hash(array_to_string(w, ' ')) FROM d WHERE len(w) BETWEEN 1 AND 2),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.q = b.q AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT a AS doc_id, coalesce(n, 0) AS n_shingles, min(b) AS component_id FROM r LEFT JOIN n ON n.doc_id = a GROUP BY a, n
""",
}
