"""The core queries by name, each with the SQL that must give the same rows where SQL can express it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.functions import vectorised as V
from siltstone.operators import corpus, dedup, detectors, extract, filters, models
from siltstone.plans import engine
from siltstone.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

# ---- SQL fragments that mean what the Column builders mean

_SP = X.SPACE
_STRIP = f"regexp_replace(%s, '^[{_SP}]+|[{_SP}]+$', '', 'g')"
_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP % 'x'}), lambda x: length(x) > 0)"
_PARAS = f"list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {_STRIP % 'x'}), lambda x: length(x) > 0)"
_WORDS = f"len(regexp_extract_all(text, '{X.WORD}'))"
_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')"
_STOP = "['" + "', '".join(filters.STOPWORDS) + "']"


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN ({a})::DOUBLE / ({b}) END"


def _part(items: str, test: str) -> str:
    return _ratio(f"len(list_filter({items}, lambda x: {test}))", f"len({items})")


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{_q(pattern)}'))"


_NOTICE = " OR ".join("contains(lower(x), '" + _q(n) + "')" for n in filters.NOTICES)
_BAD = ["worthless", "moron", "scum", "brain dead", "piece of"]

#: name -> (table, id, filter, SQL of its measure)
_MEASURES: dict[str, tuple[str, str, Callable[[], filters.RowFilter], str | None]] = {
    "lorem": ("web_docs", "record_id", filters.LoremIpsumFilter, "contains(lower(text), 'lorem ipsum')::INT"),
    "curly": ("posts", "id", filters.CurlyBraceFilter, "contains(text, '{')::INT"),
    "min_lines": ("documents", "doc_id", filters.MinLinesFilter, f"len({_LINES})"),
    "length": ("documents", "doc_id", filters.LengthFilter, "length(text)"),
    "punctuation": ("web_docs", "record_id", filters.PunctuationFilter, _part(_LINES, f"NOT regexp_matches(x, '{_q(filters.TERMINAL)}')")),
    "bad_words": (
        "web_docs",
        "record_id",
        lambda: filters.BadWordsFilter(_BAD),
        f"CASE WHEN text IS NOT NULL THEN (len(list_intersect({_TOKENS}, ['worthless', 'moron', 'scum'])) > 0 OR contains(' ' || list_aggregate({_TOKENS}, 'string_agg', ' ') || ' ', ' brain dead ') OR contains(' ' || list_aggregate({_TOKENS}, 'string_agg', ' ') || ' ', ' piece of '))::INT END",
    ),
    "digit_ratio": ("web_docs", "record_id", filters.DigitRatioFilter, _ratio(_count("[0-9]"), "length(text)")),
    "non_alnum": ("documents", "doc_id", filters.NonAlphaNumericFilter, _ratio(_count(filters.OTHER_THAN_PLAIN), "length(text)")),
    "ellipsis": ("web_docs", "record_id", filters.EllipsisFilter, _part(_LINES, f"regexp_matches(x, '{_q(filters.ELLIPSIS_END)}')")),
    "word_count": ("documents", "doc_id", filters.WordCountFilter, _WORDS),
    "repeated_paragraphs": ("web_docs", "record_id", filters.RepeatedParagraphsFilter, _ratio(f"len(list_distinct({_PARAS}))", f"len({_PARAS})")),
    "repeated_lines": ("web_docs", "record_id", filters.RepeatedLinesFilter, _ratio(f"len(list_distinct({_LINES}))", f"len({_LINES})")),
    "repeated_lines_char": (
        "web_docs",
        "record_id",
        filters.RepeatedLinesByCharFilter,
        _ratio(f"coalesce(list_sum(list_transform(list_distinct({_LINES}), lambda x: length(x))), 0)", f"coalesce(list_sum(list_transform({_LINES}, lambda x: length(x))), 0)"),
    ),
    "repeated_paragraphs_char": (
        "web_docs",
        "record_id",
        filters.RepeatedParagraphsByCharFilter,
        _ratio(f"coalesce(list_sum(list_transform(list_distinct({_PARAS}), lambda x: length(x))), 0)", f"coalesce(list_sum(list_transform({_PARAS}, lambda x: length(x))), 0)"),
    ),
    "stop_density": ("documents", "doc_id", filters.StopWordDensityFilter, _ratio(f"len(list_filter({_TOKENS}, lambda x: list_contains({_STOP}, x)))", _WORDS)),
    "stop_count": ("documents", "doc_id", filters.StopWordFilter, f"len(list_filter({_TOKENS}, lambda x: list_contains({_STOP}, x)))"),
    "table_ratio": ("web_docs", "record_id", filters.TableRatioFilter, _part(_LINES, f"regexp_matches(x, '{_q(filters.TABULAR)}')")),
    "alphabetic_words": ("web_docs", "record_id", filters.AlphabeticWordsFilter, _ratio(_count(f"[^{_SP}A-Za-z]*[A-Za-z][^{_SP}]*"), _WORDS)),
    "bullets": ("web_docs", "record_id", filters.BulletsFilter, _part(_LINES, f"regexp_matches(x, '{filters.BULLET}')")),
    "symbols_to_words": ("posts", "id", filters.SymbolsToWordsFilter, _ratio(f"greatest({_count('#')}, {_count(filters.ELLIPSIS)})", _WORDS)),
    "mean_word_length": ("web_docs", "record_id", filters.MeanWordLengthFilter, _ratio(f"length(regexp_replace(text, '[{_SP}]+', '', 'g'))", _WORDS)),
    "boilerplate_string": ("documents", "doc_id", filters.BoilerPlateStringFilter, f"CASE WHEN contains(lower(text), 'lorem ipsum') THEN 1.0 ELSE {_part(_PARAS, _NOTICE)} END"),
    "gzip_ratio": ("documents", "doc_id", filters.GzipCompressionFilter, None),
    "ngram_top": ("web_docs", "record_id", filters.RepeatingTopNGramsFilter, None),
    "ngram_dup": ("web_docs", "record_id", filters.RepeatingDuplicateNGramsFilter, None),
}


def _measure_query(source: str, key: str, make: Callable[[], filters.RowFilter]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        f = make()
        # the measure once, in a projection that the planner doesn't fold into its uses
        m = table(spark, folder, source).select(F.col(key), f.measure.cast("double").alias("raw"))
        g = filters.RowFilter(f.name, F.col("raw"), f.low, f.high, f.strict)
        return m.select(key, F.round("raw", 6).alias("metric"), g.keep().alias("kept"))

    return run


def _measure_sql(source: str, key: str, f: filters.RowFilter, sql: str) -> str:
    op = (">", "<") if f.strict else (">=", "<=")
    tests = [f"m {op[0]} {f.low}"] * (f.low is not None) + [f"m {op[1]} {f.high}"] * (f.high is not None)
    return f"SELECT {key}, round(m, 6) AS metric, coalesce({' AND '.join(tests)}, false) AS kept FROM (SELECT {key}, ({sql})::DOUBLE AS m FROM {source})"


#: name -> (low, high, strict), as the filters' defaults say; checked against them in the tests
_BOUNDS = {
    "lorem": (None, 0, False), "curly": (None, 0, False), "min_lines": (3, None, False), "length": (0, 10_000, True), "punctuation": (None, 0.85, False), "bad_words": (None, 0, False),
    "digit_ratio": (None, 0.15, False), "non_alnum": (None, 0.25, False), "ellipsis": (None, 0.3, False), "word_count": (50, 100_000, False), "repeated_paragraphs": (0.7, None, False),
    "repeated_lines": (0.7, None, False), "repeated_lines_char": (0.8, None, False), "repeated_paragraphs_char": (0.8, None, False), "stop_density": (0.06, None, False), "stop_count": (2, None, False),
    "table_ratio": (None, 0.5, False), "alphabetic_words": (0.8, None, False), "bullets": (None, 0.9, False), "symbols_to_words": (None, 0.1, False), "mean_word_length": (3, 10, False), "boilerplate_string": (None, 0.4, False),
}


# ---- line editors

_EDITORS: dict[str, tuple[str, str, Callable[[], filters.LineEditor], str]] = {
    "edit_terminal_punct": ("web_docs", "record_id", filters.TerminalPunctuationLineFilter, f"array_to_string(list_filter({_LINES}, lambda x: regexp_matches(x, '{_q(filters.TERMINAL)}')), chr(10))"),
    "edit_min_words": ("web_docs", "record_id", filters.MinWordsLineFilter, f"array_to_string(list_filter({_LINES}, lambda x: len(regexp_extract_all(x, '{X.WORD}')) >= 5), chr(10))"),
    "edit_javascript": ("web_docs", "record_id", filters.JavascriptLineFilter, f"array_to_string(list_filter({_LINES}, lambda x: NOT contains(lower(x), 'javascript')), chr(10))"),
    "edit_boilerplate_line": ("web_docs", "record_id", filters.BoilerPlateLineFilter, f"array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT ({_NOTICE})), chr(10))"),
}


def _editor_query(source: str, key: str, make: Callable[[], filters.LineEditor]) -> Query:
    return lambda spark, folder: make()(table(spark, folder, source).select(key, "text"))


# ---- flags


def _flag(source: str, key: str, column: str, test: Callable[[Column], Column]) -> Query:
    return lambda spark, folder: table(spark, folder, source).select(key, test(F.col(column)).alias("flag"))


def _count_of(source: str, key: str, column: str, count: Callable[[Column], Column]) -> Query:
    return lambda spark, folder: table(spark, folder, source).select(key, count(F.col(column)).alias("hits"))


# ---- urls

_HOST_SQL = "coalesce(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#]*)', 1)), '')"
_LISTED = ["fairbrook.test", "greybrook.example", "invalid"]


def url_domain(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "web_docs").select("record_id", X.host(F.col("url")).alias("host"))


def url_blacklist(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.URLBlacklistFilter(_LISTED)(table(spark, folder, "web_docs")).select("record_id", "url")


def url_blacklist_table(spark: SparkSession, folder: str) -> DataFrame:
    listed = spark.createDataFrame([(d,) for d in _LISTED], "domain string")
    return corpus.URLBlacklistFilter(listed)(table(spark, folder, "web_docs")).select("record_id", "url")


_BLACKLIST_SQL = f"""
SELECT record_id, url FROM (SELECT *, {_HOST_SQL.format(u='url')} AS h FROM web_docs)
WHERE NOT ({' OR '.join(f"h = '{d}' OR ends_with(h, '.{d}')" for d in _LISTED)})"""

# ---- duplicates


def dedup_document(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.DocumentDeduplicator("doc_id")(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id")


def dedup_url(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.URLDeduplicator("doc_id")(table(spark, folder, "documents").select("doc_id", "url")).select("doc_id", "url")


def dedup_paragraph(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.ParagraphDeduplicator("doc_id")(table(spark, folder, "documents").select("doc_id", "text"))


def dedup_chained(spark: SparkSession, folder: str) -> DataFrame:
    stage = dedup.DeduplicationStage([dedup.URLDeduplicator("doc_id"), dedup.DocumentDeduplicator("doc_id")])
    return stage(table(spark, folder, "documents").select("doc_id", "url", "text")).select("doc_id")


def three_sentence(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.ThreeSentenceDedupFilter("doc_id")(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id")


def line_stats(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "url", "text")
    return corpus.BoilerPlateLineStatsFilter(doc_id="doc_id")(docs).select("doc_id", "text")


_FIRST = "SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY doc_id) AS n FROM {t}) WHERE n = 1 OR {k} IS NULL"
_SPAN_SQL = rf"""
WITH l AS (SELECT doc_id, text, array_to_string({_LINES}, chr(10)) AS body FROM documents),
s AS (SELECT doc_id, CASE WHEN len(regexp_extract_all(body, '(?:[^\n]+\n?){{1,3}}')) > 0
        THEN list_transform(regexp_extract_all(body, '(?:[^\n]+\n?){{1,3}}'), lambda x: replace({_STRIP % 'x'}, chr(10), ' ')) ELSE [text] END AS spans FROM l),
o AS (SELECT span, min(doc_id) AS owner FROM (SELECT doc_id, unnest(spans) AS span FROM s) GROUP BY span)
SELECT doc_id FROM documents WHERE doc_id IN (SELECT owner FROM o)"""
_PARAGRAPH_SQL = """
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS n FROM p)
SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM f WHERE n = 1 GROUP BY doc_id"""

_KEY = f"{_STRIP % chr(0)}".replace(chr(0), r"regexp_replace(nfc_normalize(lower(line)), '[^\p{L}\p{M}]+', ' ', 'g')")
_LINE_STATS_SQL = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts, {_HOST_SQL.format(u='url')} AS h FROM documents),
l AS (SELECT doc_id, h, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM d),
k AS (SELECT *, {_KEY} AS key FROM l),
n AS (SELECT h, count(*) AS n FROM d GROUP BY h),
c AS (SELECT h, key, count(DISTINCT doc_id) AS c FROM k WHERE key <> '' GROUP BY h, key),
g AS (SELECT key, sum(c) AS s FROM c GROUP BY key),
bad AS (SELECT h, key, true AS bad FROM c JOIN n USING (h) JOIN g USING (key) WHERE (c >= 3 AND c >= n * 0.05) OR s >= 1000),
e AS (SELECT k.*, coalesce(bad, false) AS bad, min(CASE WHEN length(line) >= 30 THEN pos END) OVER (PARTITION BY doc_id, key) AS long_at FROM k LEFT JOIN bad USING (h, key)),
t AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key = '' OR (NOT bad AND (long_at IS NULL OR pos <= long_at))), '') AS t FROM e GROUP BY doc_id)
SELECT doc_id, {_STRIP % "regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g')"} AS text FROM t"""

# folds over places carry two numbers in one: what is counted, times 10^9, and the place from which on words are free
_GRAMS = f"""
WITH r AS (SELECT row_number() OVER () AS rid, record_id, text, regexp_extract_all(text, '{X.WORD}') AS w FROM web_docs),
g AS (SELECT rid, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram, unnest(range(1, len(w))) AS pos FROM r WHERE len(w) >= 2)"""
_NGRAM_TOP_SQL = f"""{_GRAMS},
b AS (SELECT rid, gram, list(pos ORDER BY pos) AS spots, row_number() OVER (PARTITION BY rid ORDER BY count(*) DESC, min(pos)) AS nth FROM g GROUP BY rid, gram),
m AS (SELECT record_id, CASE WHEN text IS NOT NULL THEN coalesce((list_reduce(list_prepend(0::BIGINT, spots), lambda a, p: CASE WHEN p >= a % 1000000000 THEN (a // 1000000000 + 1) * 1000000000 + p + 2 ELSE a END) // 1000000000)
  * length(gram)::DOUBLE / length(text), 1.0) END AS m FROM r LEFT JOIN (SELECT * FROM b WHERE nth = 1) USING (rid))
SELECT record_id, round(m, 6) AS metric, coalesce(m <= 0.2, false) AS kept FROM m"""
_NGRAM_DUP_SQL = f"""{_GRAMS},
f AS (SELECT rid, pos, min(pos) OVER (PARTITION BY rid, gram) AS first FROM g),
d AS (SELECT rid, list(pos ORDER BY pos) AS spots FROM f WHERE pos > first GROUP BY rid),
s AS (SELECT r.*, spots, list_transform(range(1, len(w) + 2), lambda k: coalesce(list_sum(list_transform(w[1:k - 1], lambda x: length(x))), 0)::BIGINT) AS before FROM r LEFT JOIN d USING (rid)),
m AS (SELECT record_id, CASE WHEN text IS NULL THEN NULL WHEN len(w) < 2 THEN 1.0 WHEN spots IS NULL THEN 0.0 ELSE
  (list_reduce(list_prepend(0::BIGINT, spots), lambda a, p: (a // 1000000000 + before[p + 2] - before[greatest(p, a % 1000000000)] + least(p + 2 - greatest(p, a % 1000000000), 1)) * 1000000000 + p + 2) // 1000000000)::DOUBLE / length(text) END AS m FROM s)
SELECT record_id, round(m, 6) AS metric, coalesce(m <= 0.2, false) AS kept FROM m"""

_HASHES, _BANDS, _ROWS = 112, 14, 8


def minhash_signature(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", dedup.minhash_signature(F.col("text"), _HASHES).alias("sig")).filter("sig is not null").select("doc_id", F.array_join("sig", ",").alias("sig"))


def fuzzy_removal(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return dedup.fuzzy_groups(docs, "doc_id", "text")


#: The least member of what is linked, from pairs (a, b) of both directions in a table ``linked``.
_REACH = """reach(node, root) AS (SELECT a, least(a, min(b)) FROM linked GROUP BY a UNION SELECT l.a, r.root FROM reach r JOIN linked l ON l.b = r.node WHERE r.root < l.a),
groups AS (SELECT node, min(root) AS root FROM reach GROUP BY node)"""
_FUZZY_SQL = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]+') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, md5(unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, (len(w) - 3)::BIGINT), lambda i: array_to_string(w[i:i+4], ' ')) ELSE [array_to_string(w, ' ')] END)) AS s FROM t WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
linked AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)),
{_REACH}
SELECT node AS doc_id, root FROM groups WHERE node <> root"""
_VECTOR_LINKS = """
WITH RECURSIVE v AS (SELECT uuid, min(embedding)::DOUBLE[64] AS e FROM vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND uuid IS NOT NULL GROUP BY uuid),
linked AS (SELECT a.uuid AS a, b.uuid AS b FROM v a JOIN v b ON a.uuid <> b.uuid WHERE array_cosine_similarity(a.e, b.e) >= {t}),
""" + _REACH
_EMBED_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS x FROM t),
h AS (SELECT doc_id, ('0x' || substr(md5(x), 1, 8))::BIGINT AS h FROM x),
c AS (SELECT doc_id, h % 768 AS spot, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS c FROM h GROUP BY 1, 2),
n AS (SELECT doc_id, greatest(sqrt(sum(c * c)), 1e-30)::FLOAT AS n FROM c GROUP BY 1),
f AS (SELECT d.doc_id, i.spot, coalesce(c.c::FLOAT / n.n, 0)::FLOAT AS v FROM documents d CROSS JOIN (SELECT unnest(range(768)) AS spot) i LEFT JOIN c ON c.doc_id = d.doc_id AND c.spot = i.spot LEFT JOIN n ON n.doc_id = d.doc_id)
SELECT doc_id, list(v ORDER BY spot) AS embedding FROM f GROUP BY doc_id"""

_FAMILY = dedup.hash_family(_HASHES, 42)
_SIG_CTE = rf"""
t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]+') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, (len(w) - 3)::BIGINT), lambda i: array_to_string(w[i:i+4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM t WHERE len(w) > 0),
h AS (SELECT doc_id, ('0x' || substr(md5(s), 1, 8))::BIGINT % {dedup.PRIME} AS h FROM g),
sig AS (SELECT doc_id, {', '.join(f'min(({a} * h + {b}) % {dedup.PRIME}) AS m{i}' for i, (a, b) in enumerate(_FAMILY))} FROM h GROUP BY doc_id)"""
_SIG_SQL = f"WITH {_SIG_CTE} SELECT doc_id, concat_ws(',', {', '.join(f'm{i}' for i in range(_HASHES))}) AS sig FROM sig"


def lsh_edges(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    sigs = docs.select("doc_id", dedup.minhash_signature(F.col("text"), _HASHES).alias("sig")).filter("sig is not null")
    return dedup.lsh_edges(sigs, "doc_id", _BANDS, _ROWS)


_EDGES_SQL = f"""WITH {_SIG_CTE}, b AS ({' UNION ALL '.join(f"SELECT doc_id AS u, {i} AS band, concat_ws(',', {', '.join(f'm{i * _ROWS + j}' for j in range(_ROWS))}) AS k FROM sig" for i in range(_BANDS))})
SELECT DISTINCT u, v FROM (SELECT u, min(u) OVER (PARTITION BY band, k) AS v FROM b) WHERE u <> v"""


def semantic_removal(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.SemanticDedup().dropped(table(spark, folder, "vectors"))


def semantic_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Components at 0.999."""
    found = dedup.components(dedup.SemanticDedup(threshold=0.999).pairs(table(spark, folder, "vectors")))
    return found.select(F.col("node").alias("uuid"), "root")


# ---- pages, encodings, tokens, scores

_WEIGHTS = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]


def linear_probe(spark: SparkSession, folder: str) -> DataFrame:
    probe = models.linear_probe(F.col("embedding"), [_WEIGHTS], [0.1], "binary", 1)
    return table(spark, folder, "embeddings").select("vec_id", F.round(probe, 6).alias("score"))


_PROBE_SQL = f"SELECT vec_id, CASE WHEN len(embedding) = 64 THEN round(1 / (1 + exp(-(0.1 + list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * CAST({_WEIGHTS} AS DOUBLE[])[i]))))), 6) END AS score FROM embeddings"


def pii_mask(spark: SparkSession, folder: str) -> DataFrame:
    return extract.PIIAnonymizer("body")(table(spark, folder, "posts").select("id", "body"))


def _pii_sql() -> str:
    c = "body"
    for name, pattern in extract.PII_PATTERNS:
        c = f"regexp_replace({c}, '{_q(pattern)}', '<{name}>', 'g')"
    return f"SELECT id, {c} AS body FROM posts"


def html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract.ExtractHTML()(table(spark, folder, "warc_pages").select("warc_record_id", "html")).drop("html")


def mojibake(spark: SparkSession, folder: str) -> DataFrame:
    return extract.FixEncoding()(table(spark, folder, "web_docs").select("record_id", "text"))


def token_count(spark: SparkSession, folder: str) -> DataFrame:
    return extract.TokenCounter()(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def tokenize(spark: SparkSession, folder: str) -> DataFrame:
    return extract.Tokenize()(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def fasttext_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return extract.FastTextTokenize()(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def language(spark: SparkSession, folder: str) -> DataFrame:
    return models.Whichlang()(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def embed_text(spark: SparkSession, folder: str) -> DataFrame:
    return models.EmbedText()(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Labels by a classifier fitted on labelled documents."""
    docs = table(spark, folder, "documents")
    known = docs.filter(F.lower("lang").isin("en", "de", "fr", "es", "it", "pt", "nl", "ru")).select("text", F.concat(F.lit("__label__"), F.lower("lang")).alias("lang"))
    model = models.fit_classifier(known, "text", "lang", 1_500)
    return models.LanguageID(load=models.trained(model))(docs.select("doc_id", "text")).drop("text")


def nsfw(spark: SparkSession, folder: str) -> DataFrame:
    """Scores by a classifier fitted on the reviewers' labels."""
    docs = table(spark, folder, "web_docs").select("record_id", "text")
    known = docs.join(table(spark, folder, "text_labels").filter("toxic is not null").select("record_id", "toxic"), "record_id")
    model = models.fit_classifier(known, "text", "toxic", 3_000)
    return models.NSFW(models.trained(model, "1"))(docs).select("record_id", F.round("nsfw_score", 6).alias("score")).distinct()


def _counting():
    """Stands for a language model: answers by the contract with a score that the text's length gives."""
    return lambda asked: [json.dumps({"reasoning": "by length", "score": len(json.loads(a)[-1]["content"]) % 8}) for a in asked]


def generate_text(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return models.GenerateText(lambda: lambda asked: [json.loads(a)[-1]["content"] for a in asked], "Say it again.", truncate_to=200)(docs).drop("text")


def edu_scores(spark: SparkSession, folder: str) -> DataFrame:
    return engine.edu_scores(table(spark, folder, "documents").select("doc_id", "text"), lambda: _counting()).select("doc_id", "reasoning", "score")


def ocr_text(spark: SparkSession, folder: str) -> DataFrame:
    """Texts as bytes stand for images, and decoding them for a model; degenerate ends and picture blocks are taken out."""
    pages = table(spark, folder, "web_docs").select("record_id", F.concat(F.lit('<img src="images/bbox_1.png">\n\n'), "text").cast("binary").alias("image"))
    return models.OCRText(lambda: lambda images: [bytes(b).decode() for b in images])(pages).drop("image")


def unfinished(spark: SparkSession, folder: str) -> DataFrame:
    """Posts that aren't among the finished ones: an anti join by two keys."""
    posts = table(spark, folder, "posts").select("site", "id").distinct()
    done = table(spark, folder, "posts").filter("score >= 3").select("site", "id")
    return posts.join(done, ["site", "id"], "left_anti")


def qa_join(spark: SparkSession, folder: str) -> DataFrame:
    posts = table(spark, folder, "posts").select("id", "post_type_id", "parent_id", "score", "accepted_answer_id", "title", "text").distinct()
    return engine.qa_pairs(posts).select("question_id", "answer_id", "question_score", "answer_score", "accepted")


_QA_SQL = """
WITH p AS (SELECT DISTINCT id, post_type_id, parent_id, score, accepted_answer_id, title, text FROM posts)
SELECT q.id AS question_id, a.id AS answer_id, q.score AS question_score, a.score AS answer_score, coalesce(a.id = q.accepted_answer_id, false) AS accepted
FROM p q JOIN p a ON a.parent_id = q.id WHERE q.post_type_id = 1 AND a.post_type_id = 2 AND q.score >= 5 AND (a.score >= 5 OR a.id = q.accepted_answer_id)"""


def flagship_pipeline() -> engine.DataEngine:
    stages = [filters.WordCountFilter(), filters.StopWordDensityFilter(), filters.RepeatedLinesFilter(), dedup.DocumentDeduplicator("doc_id")]
    return engine.DataEngine(stages, "curation")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are long enough, in prose, without repeats, and first of their text."""
    return flagship_pipeline()(table(spark, folder, "documents").select("doc_id", "source", "text")).select("doc_id", "source")


_FLAGSHIP_SQL = f"""
WITH k AS (SELECT doc_id, source, text FROM documents WHERE {_WORDS} BETWEEN 50 AND 100000
  AND {_ratio(f"len(list_filter({_TOKENS}, lambda x: list_contains({_STOP}, x)))", _WORDS)} >= 0.06
  AND {_ratio(f"len(list_distinct({_LINES}))", f"len({_LINES})")} >= 0.7)
SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM k) WHERE n = 1"""


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {"curation": flagship}
    out |= {name: _measure_query(t, k, make) for name, (t, k, make, _) in _MEASURES.items()}
    out |= {name: _editor_query(t, k, make) for name, (t, k, make, _) in _EDITORS.items()}
    out |= {
        "ai_phrase": _flag("web_docs", "record_id", "text", detectors.ai_phrase),
        "ai_style": _count_of("web_docs", "record_id", "text", detectors.ai_style_hits),
        "ai_style_flag": _flag("web_docs", "record_id", "text", lambda c: detectors.ai_style(c, min_hits=1)),
        "ai_trace": _flag("warc_pages", "warc_record_id", "html", detectors.ai_trace),
        "has_code": _flag("posts", "id", "body", _lazy(detectors.html_has_code)),
        "has_math": _flag("posts", "id", "body", _lazy(detectors.html_has_math)),
    }
    plain = [url_domain, url_blacklist, url_blacklist_table, dedup_document, dedup_url, dedup_paragraph, dedup_chained, three_sentence, line_stats, minhash_signature, lsh_edges, fuzzy_removal]
    plain += [semantic_removal, semantic_pairs, linear_probe, pii_mask, html_text, mojibake, token_count, tokenize, fasttext_tokens, language, language_id, nsfw, generate_text, edu_scores, ocr_text, embed_text, qa_join, unfinished]
    return out | {f.__name__: f for f in plain}


def _lazy(function) -> Callable[[Column], Column]:
    return lambda c: V.per_text(function, "boolean")(c)


class _Fixed:
    def __init__(self, low, high, strict):
        self.low, self.high, self.strict = low, high, strict


def oracle_sql() -> dict[str, str]:
    out = {"curation": _FLAGSHIP_SQL}
    out |= {n: _measure_sql(t, k, _Fixed(*_BOUNDS[n]), sql) for n, (t, k, _, sql) in _MEASURES.items() if sql}
    out |= {n: f"SELECT {k}, {sql} AS text FROM {t}" for n, (t, k, _, sql) in _EDITORS.items()}
    out |= {
        "ai_phrase": f"SELECT record_id, coalesce(regexp_matches(text, '(?im){_q(detectors.AI_PHRASE_PATTERN)}'), false) AS flag FROM web_docs",
        "ai_style": f"SELECT record_id, len(regexp_extract_all(text, '(?i){_q(detectors.AI_STYLE_PATTERN)}')) AS hits FROM web_docs",
        "ai_trace": f"SELECT warc_record_id, coalesce(regexp_matches(html, '(?i){_q(detectors.AI_TRACE_PATTERN)}'), false) AS flag FROM warc_pages",
        "ai_style_flag": f"SELECT record_id, coalesce(h >= 1 AND h * 1000.0 / length(text) >= 0.5, false) AS flag FROM (SELECT *, len(regexp_extract_all(text, '(?i){_q(detectors.AI_STYLE_PATTERN)}')) AS h FROM web_docs)",
        "ngram_top": _NGRAM_TOP_SQL,
        "ngram_dup": _NGRAM_DUP_SQL,
        "line_stats": _LINE_STATS_SQL,
        "fuzzy_removal": _FUZZY_SQL,
        "semantic_removal": _VECTOR_LINKS.format(t=0.95) + " SELECT node AS uuid FROM groups WHERE node <> root",
        "semantic_pairs": _VECTOR_LINKS.format(t=0.999) + " SELECT node AS uuid, root FROM groups",
        "embed_text": _EMBED_SQL,
        "generate_text": "SELECT doc_id, substr(coalesce(text, ''), 1, 200) AS response FROM documents",
        "edu_scores": "SELECT doc_id, CASE WHEN n <= 5 THEN 'by length' END AS reasoning, CASE WHEN n <= 5 THEN n END::INT AS score FROM (SELECT doc_id, length(coalesce(text, '')) % 8 AS n FROM documents)",
        "ocr_text": "SELECT record_id, text FROM web_docs",
        "unfinished": "SELECT DISTINCT site, id FROM posts p WHERE NOT EXISTS (SELECT 1 FROM posts d WHERE d.score >= 3 AND d.site = p.site AND d.id = p.id)",
        "url_domain": f"SELECT record_id, {_HOST_SQL.format(u='url')} AS host FROM web_docs",
        "url_blacklist": _BLACKLIST_SQL,
        "url_blacklist_table": _BLACKLIST_SQL,
        "dedup_document": _FIRST.format(k="text", t="documents"),
        "dedup_url": "SELECT doc_id, url FROM documents WHERE doc_id IN (" + _FIRST.format(k="url", t="documents") + ")",
        "dedup_paragraph": _PARAGRAPH_SQL,
        "dedup_chained": "WITH u AS (SELECT * FROM documents WHERE doc_id IN (" + _FIRST.format(k="url", t="documents") + ")) " + _FIRST.format(k="text", t="u"),
        "three_sentence": _SPAN_SQL,
        "minhash_signature": _SIG_SQL,
        "lsh_edges": _EDGES_SQL,
        "linear_probe": _PROBE_SQL,
        "pii_mask": _pii_sql(),
        "qa_join": _QA_SQL,
    }
    return out
