"""The training-data queries (pN_...) by name, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import components, language, leakage, markup, mixture, neighbours, pages, pairs, quality, toxicity
from siltstone.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return components.connected_groups(table(spark, folder, "edges"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, folder, "vectors"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_documents(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mixture_report(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_documents(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_by_length(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture with sizes in characters, which SQL knows too."""
    return mixture.mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), size="n_chars")


def p9_report_by_length(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mixture_report(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), size="n_chars")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_cases(table(spark, folder, "documents"))


def p10_segments(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify_languages(table(spark, folder, "documents"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return quality.not_prose(table(spark, folder, "web_docs"))


def p5_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_statistics(table(spark, folder, "web_docs"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pairs.main_defect(table(spark, folder, "qa_pairs"), language.fit(docs, "doc_id", "text", "lang"))


def p7_defects(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pairs.defects(table(spark, folder, "qa_pairs"), language.fit(docs, "doc_id", "text", "lang"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return markup.residue(table(spark, folder, "posts"))


def p3_clean(spark: SparkSession, folder: str) -> DataFrame:
    return markup.clean_text(table(spark, folder, "posts"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "web_docs")
    return toxicity.toxic_records(docs, toxicity.fit(docs, table(spark, folder, "text_labels")))


def p6_rates(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "web_docs")
    return toxicity.rates_by_source(docs, toxicity.fit(docs, table(spark, folder, "text_labels")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return pages.main_blocks(table(spark, folder, "warc_pages"))


def p2_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages.main_text(table(spark, folder, "warc_pages"))


def queries() -> dict[str, Query]:
    found = [p1_found, p4_found, p8_found, p8_items, p9_mixture, p9_documents, p9_by_length, p9_report_by_length, p10_found, p10_segments, p5_found, p5_statistics, p7_found, p7_defects, p3_found, p3_clean, p6_found, p6_rates, p2_found, p2_text]
    return {f.__name__: f for f in found}


P1_SQL = """
WITH RECURSIVE pairs AS (
  SELECT DISTINCT coalesce(u, v) AS a, coalesce(v, u) AS b FROM edges WHERE u IS NOT NULL OR v IS NOT NULL
), both_ways AS (
  SELECT a, b FROM pairs UNION SELECT b, a FROM pairs UNION SELECT a, a FROM pairs UNION SELECT b, b FROM pairs
), reach(record_id, group_id) AS (
  SELECT a, min(b) FROM both_ways GROUP BY a
  UNION
  SELECT x.a, r.group_id FROM reach r JOIN both_ways x ON x.b = r.record_id WHERE r.group_id < x.a
)
SELECT record_id, min(group_id) AS group_id FROM reach GROUP BY record_id
"""


P4_SQL = """
WITH v AS (SELECT uuid, min(embedding)::DOUBLE[64] AS e FROM vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND uuid IS NOT NULL GROUP BY uuid),
p AS (SELECT a.uuid AS a, b.uuid AS b, array_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.uuid <> b.uuid),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM p)
SELECT DISTINCT least(a, b) AS uuid_a, greatest(a, b) AS uuid_b FROM k WHERE n <= 5 AND s >= 0.86
"""

# NFC and full-width digits instead of NFKC, which SQL doesn't have
P8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(translate(text, '０１２３４５６７８９', '0123456789'))), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(nfc_normalize(translate(item_text, '０１２３４５６７８９', '0123456789'))), '[\p{L}\p{N}]+') AS w FROM eval_items),
dg AS (SELECT doc_id, unnest(list_transform(range(1, (len(w) - 10)::BIGINT), lambda k: array_to_string(w[k:k+11], ' '))) AS g FROM d),
ig AS (SELECT item_id, unnest(list_transform(range(1, (len(w) - 10)::BIGINT), lambda k: array_to_string(w[k:k+11], ' '))) AS g FROM i)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""


# a source's last round takes the documents whose hash is below that at which the budget runs out
P9_CTE = """
WITH d AS (SELECT doc_id, source, n_chars AS tokens, ('0x' || substr(md5(doc_id::VARCHAR || ' 0'), 1, 15))::BIGINT AS h FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL AND n_chars > 0),
z AS (SELECT source, count(*) AS docs, sum(tokens)::BIGINT AS tokens FROM d GROUP BY source),
b AS (SELECT m.source, target_share, max_repeats::BIGINT AS max_repeats, coalesce(docs, 0) AS docs, coalesce(tokens, 0) AS tokens FROM mix_targets m LEFT JOIN z USING (source)),
g AS (SELECT *, least(round(target_share * sum(tokens) OVER ())::BIGINT, max_repeats * tokens) AS budget FROM b),
p AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS full_rounds FROM g),
r AS (SELECT d.*, full_rounds, budget - full_rounds * p.tokens AS rest, sum(d.tokens) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS run FROM d JOIN p USING (source)),
c AS (SELECT doc_id, source, tokens, full_rounds + CASE WHEN run <= rest THEN 1 ELSE 0 END AS copies FROM r)"""
P9_SQL = P9_CTE + " SELECT doc_id, source, tokens, copies::BIGINT AS copies FROM c WHERE copies > 0"
P9_REPORT_SQL = (
    P9_CTE
    + """, u AS (SELECT source, count(*) AS used_docs, sum(tokens * copies)::BIGINT AS used_tokens FROM c WHERE copies > 0 GROUP BY source)
SELECT source, target_share, max_repeats, docs, tokens, budget, coalesce(used_docs, 0) AS used_docs, coalesce(used_tokens, 0) AS used_tokens,
  round(coalesce(used_tokens, 0)::DOUBLE / sum(used_tokens) OVER (), 9) AS actual_share FROM p LEFT JOIN u USING (source)"""
)


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p4_found": P4_SQL, "p8_found": P8_SQL, "p9_by_length": P9_SQL, "p9_report_by_length": P9_REPORT_SQL}
