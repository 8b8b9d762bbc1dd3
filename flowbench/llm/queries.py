"""Queries of the document operators, with SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flowbench.llm import bpe, conversations, decontamination, edits, jaccard, lines, media, phrases, pii, pseudo, quality, sharding, toxicity
from flowbench.llm.common import table


def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a benchmark item, with the item."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards (3 regions of 2 racks of 4 shards)."""
    return sharding.shard(table(spark, sf_dir, "documents"), sharding.topology(3, 2, 4))


def op3_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as JPEG, read back."""
    return media.digests(table(spark, sf_dir, "documents"))


def op4_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after four edits each."""
    return edits.counts(table(spark, sf_dir, "documents"), vocabulary())


def op5_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of all documents under a network trained on all of them."""
    return pseudo.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under links of at least 90 percent of three-word shingles."""
    return jaccard.components(table(spark, sf_dir, "documents"), 3, 90)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, with the nearest examples and telling terms."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms of all documents."""
    return pii.digests(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that five or more of them share."""
    return lines.digests(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language in all documents."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by a hash of each row and repaired."""
    rows = table(spark, sf_dir, "conversations")
    return conversations.digests(conversations.damaged(rows), rows)


def vocabulary() -> bpe.Vocabulary:
    """The byte-level vocabulary for many languages."""
    return bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> query."""
    return {f.__name__: f for f in (
        op1_benchmark_leaks, op2_hash_tree_sharding, op3_jpeg_media, op4_edit_aware_counts, op5_pseudo_likelihood,
        op6_quality, op7_bpe_round_trip,
        op8_jaccard_components, op9_toxicity,
        op10_personal_data, op11_line_dedup, op12_collocations, op13_conversation_repair,
    )}


#: Sets, exact links by counting shared shingles, and reachability.
JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT r.x AS doc_id, coalesce(n.n, 0) AS n_shingles, min(r.y) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.x GROUP BY ALL
"""


#: Keys that five documents or more hold, and the lines that they take from all but the largest.
LINES_SQL = r"""
WITH l AS (SELECT doc_id, k, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, row_number() OVER () AS k, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, g.key IS NOT NULL AND k.doc_id <> largest AS gone FROM k LEFT JOIN g ON g.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY k
"""


#: Counts of all phrases, the lowest-scoring cut of each candidate, and what no longer candidate covers.
COLLOCATIONS_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, [x for x in regexp_split_to_array(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+') if x <> ''] AS w FROM t),
g AS (SELECT lang, unnest(w) AS phrase, 1 AS k FROM p UNION ALL SELECT lang, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]), 2 FROM p
  UNION ALL SELECT lang, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]), 3 FROM p),
f AS (SELECT lang, phrase, k, count(*) AS n FROM g GROUP BY ALL),
tot AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
u AS (SELECT lang, phrase, k, a, 1 AS cut, w[1] AS lp, array_to_string(w[2:], ' ') AS rp FROM c UNION ALL SELECT lang, phrase, k, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE k = 3),
s AS (SELECT u.*, l.n AS l, r.n AS r, CAST((CAST(a AS HUGEINT) * a * 1000000) // (CAST(l.n AS HUGEINT) * r.n) AS BIGINT) AS score FROM u JOIN f l ON l.lang = u.lang AND l.phrase = lp JOIN f r ON r.lang = u.lang AND r.phrase = rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, part, max(a) AS a FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM c WHERE k = 3) GROUP BY ALL),
z AS (SELECT b.lang, b.phrase, b.a, l, r, score FROM b LEFT JOIN o ON o.lang = b.lang AND o.part = b.phrase WHERE o.a IS NULL OR 100 * o.a < 50 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z) JOIN tot USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL."""
    return {"op8_jaccard_components": JACCARD_SQL, "op11_line_dedup": LINES_SQL, "op12_collocations": COLLOCATIONS_SQL}
