"""Queries of the scalar functions on names, types and values, with their SQL.

Names are those of match_entries (pairs as delivered) and of the catalogues.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colmatch.functions import expressions as X
from colmatch.functions import names as N
from colmatch.plans.shared import table

_BOTH = "a <> '' AND b <> ''"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b: the distinct pairs of column names of match_entries."""
    return table(spark, sf_dir, "match_entries").select(F.col("source_column").alias("a"), F.col("target_column").alias("b")).where(_BOTH).distinct()


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name: the distinct column names of the catalogues and profiles."""
    of = lambda t: table(spark, sf_dir, t).select("name").where(F.col("name") != "")
    return of("catalog_left").unionByName(of("catalog_right")).unionByName(of("field_profiles")).distinct()


def _measure(f):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(f(x, y)) for x, y in zip(a, b)], dtype="float64")

    return run


def _scored(f):
    """A query of one Python measure on all pairs of names."""
    return lambda spark, sf_dir: _pairs(spark, sf_dir).select("a", "b", F.round(_measure(f)("a", "b"), 9).alias("score"))


def _native(expr):
    return lambda spark, sf_dir: _pairs(spark, sf_dir).select("a", "b", F.round(expr(F.col("a"), F.col("b")), 9).alias("score"))


def fn_normalize_name(spark, sf_dir):
    return _listed(spark, sf_dir).select("name", X.normalized_name(F.col("name")).alias("bare"))


def fn_tokenize_name(spark, sf_dir):
    return _listed(spark, sf_dir).select("name", F.array_join(F.array_sort(X.name_words(F.col("name"))), " ").alias("words"))


def fn_name_tokens(spark, sf_dir):
    return _listed(spark, sf_dir).select("name", F.array_join(X.name_tokens(F.col("name")), " ").alias("tokens"))


def fn_split_words(spark, sf_dir):
    @F.pandas_udf(T.StringType())
    def split(a: pd.Series) -> pd.Series:
        return a.map(lambda x: " ".join(N.split_words(x)))

    return _listed(spark, sf_dir).select("name", split("name").alias("words"))


def fn_document_tokens(spark, sf_dir):
    """How often each token stands in the sentences of lang_samples."""
    tokens = table(spark, sf_dir, "lang_samples").select(F.explode(X.document_tokens(F.col("sample_text"))).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def fn_types(spark, sf_dir):
    """Both type scores for all pairs of declared types."""
    t = table(spark, sf_dir, "field_profiles").select(F.col("data_type").alias("a")).where("a <> ''").distinct()
    both = t.join(t.select(F.col("a").alias("b")), F.lit(True))  # at most eight types
    return both.select("a", "b", X.suggestion_type_score(F.col("a"), F.col("b")).alias("suggestion"), X.type_similarity(F.col("a"), F.col("b")).alias("family"))


def fn_unit_vectors(spark, sf_dir):
    """The first place and the length of each vector scaled to length 1."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", X.unit_vector(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(X.cosine(F.col("v"), F.col("v")), 6).alias("length"))


def fn_parsed_numbers(spark, sf_dir):
    """What the distinct samples of all Fields are as numbers."""
    from colmatch.operators.distribution import parsed_number

    v = table(spark, sf_dir, "field_profiles").select(F.explode("samples").alias("value")).where(F.col("value").rlike(r"^[\x20-\x7e]+$")).distinct()
    return v.select("value", parsed_number(F.col("value")).alias("number")).where(F.col("number").isNotNull())


QUERIES = {f.__name__: f for f in (fn_normalize_name, fn_tokenize_name, fn_name_tokens, fn_split_words, fn_document_tokens, fn_types, fn_unit_vectors, fn_parsed_numbers)}
QUERIES |= {
    "fn_levenshtein": _native(X.levenshtein_similarity), "fn_hamming": _native(X.hamming_similarity), "fn_trigram": _native(X.trigram_similarity),
    "fn_damerau": _scored(N.damerau_similarity), "fn_jaro": _scored(N.jaro), "fn_jaro_winkler": _scored(N.jaro_winkler), "fn_name_score": _scored(N.name_score),
    "fn_abbreviation_score": _scored(N.abbreviation_score), "fn_is_abbreviation": _scored(N.is_abbreviation), "fn_tokens_similarity": _scored(N.tokens_similarity), "fn_word_similarity": _scored(N.flooding_word_similarity), "fn_prefix_suffix": _scored(N.prefix_suffix),
}

# --- SQL ---------------------------------------------------------------------------------------

_PAIRS = "pr AS (SELECT DISTINCT source_column AS a, target_column AS b FROM match_entries WHERE source_column <> '' AND target_column <> '')"
_LISTED = "nm AS (SELECT name FROM catalog_left WHERE name <> '' UNION SELECT name FROM catalog_right WHERE name <> '' UNION SELECT name FROM field_profiles WHERE name <> '')"


def bare_sql(x: str) -> str:
    return rf"lower(regexp_replace({x}, '[^\p{{L}}\p{{M}}\p{{N}}]', '', 'g'))"


def words_sql(x: str) -> str:
    known = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in N.SYNONYMS.items()) + "}"
    parts = rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(list_transform({parts}, lambda w: coalesce({known}[w], w)))"


def tokens_sql(x: str) -> str:
    """All tokens in order, repeats too: an upper-case letter before a capitalised word is set apart first."""
    return rf"list_transform(regexp_extract_all(regexp_replace({x}, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]+[a-z]*|[a-z]+|\p{{Nd}}+'), lambda w: lower(w))"


def abbreviation_sql(t: str, u: str) -> str:
    short, long = f"CASE WHEN length({t}) <= length({u}) THEN {t} ELSE {u} END", f"CASE WHEN length({t}) <= length({u}) THEN {u} ELSE {t} END"
    escaped = f"list_transform(string_split({short}, ''), lambda ch: regexp_escape(ch))"
    return (f"({t} = {u} OR (least(length({t}), length({u})) >= 2 AND left({t}, 1) = left({u}, 1) AND least(length({t}), length({u}))::DOUBLE / greatest(length({t}), length({u})) >= 0.3 "
            f"AND regexp_matches({long}, '^' || array_to_string({escaped}, '.*'))))")


def tokens_similarity_sql(pairs: str) -> str:
    """CTEs that end in toksim(a, b, score) for the pairs of the relation ``pairs``; needs WITH RECURSIVE."""
    first = lambda x: f"list_filter({x}, lambda w, i: list_position({x}, w) = i)"
    return f"""tk0 AS (SELECT a, b, {tokens_sql('a')} AS ta, {tokens_sql('b')} AS tb FROM {pairs}),
        tk1 AS (SELECT a, b, {first('ta')} AS ta, {first('tb')} AS tb FROM tk0),
        tk AS (SELECT a, b, CASE WHEN len(ta) <= len(tb) THEN ta ELSE tb END AS p, CASE WHEN len(ta) <= len(tb) THEN tb ELSE ta END AS q FROM tk1),
        gr(a, b, p, k, free, n, met) AS (
          SELECT a, b, p, 1, q, len(p) + len(q), 0 FROM tk UNION ALL
          SELECT a, b, p, k + 1, CASE WHEN h IS NULL THEN free ELSE list_filter(free, lambda x: x <> h) END, n, met + CASE WHEN h IS NULL THEN 0 ELSE 1 END
          FROM (SELECT *, list_filter(free, lambda u: {abbreviation_sql('p[k]', 'u')})[1] AS h FROM gr WHERE k <= len(p))),
        toksim AS (SELECT a, b, CASE WHEN len(p) = 0 THEN 0.0 ELSE 2.0 * met / n END AS score FROM gr WHERE k = len(p) + 1)"""


def trigram_sql(pairs: str) -> str:
    """CTEs that end in trisim(a, b, score) for nonempty names."""
    return f"""ns AS (SELECT a AS x FROM {pairs} UNION SELECT b FROM {pairs}),
        g0 AS (SELECT x, CASE WHEN length(x) < 3 THEN [lower(x)] ELSE list_transform(range(1, length(x) - 1), lambda i: substr(lower(x), i, 3)) END AS gs FROM ns),
        g1 AS (SELECT x, g, count(*) AS k FROM (SELECT x, unnest(gs) AS g FROM g0) GROUP BY ALL),
        g2 AS (SELECT a, b, sum(least(p.k, q.k)) AS o FROM {pairs} JOIN g1 p ON p.x = a JOIN g1 q ON q.x = b AND q.g = p.g GROUP BY ALL),
        trisim AS (SELECT pp.a, pp.b, coalesce(2 * o, 0)::DOUBLE / (len(u.gs) + len(v.gs)) AS score
                   FROM {pairs} pp JOIN g0 u ON u.x = pp.a JOIN g0 v ON v.x = pp.b LEFT JOIN g2 ON g2.a = pp.a AND g2.b = pp.b)"""


def name_score_sql(a: str, b: str) -> str:
    x, y, p, q = bare_sql(a), bare_sql(b), words_sql(a), words_sql(b)
    both = f"lower({a} || {b})"
    shared = f"CASE WHEN len({p}) = 0 OR len({q}) = 0 THEN 0.0 ELSE len(list_intersect({p}, {q}))::DOUBLE / least(len({p}), len({q})) END"
    return f"CASE WHEN {x} = {y} THEN 1.0 ELSE greatest(jaro_winkler_similarity({plain_sql(x, both)}, {plain_sql(y, both)}), {shared}) END"


def abbreviation_score_sql(pairs: str) -> str:
    """CTEs that end in abb(a, b, score) for the pairs of the relation ``pairs``; needs WITH RECURSIVE.

    The best score of the shorter bare name as a subsequence of the longer: 16 a letter, 8 more for
    the first place and for a run, less 3 for opening a gap and 1 for each further place of it.
    """
    here = ("CASE WHEN i = 0 THEN CASE WHEN j = 0 THEN 24 ELSE 16 END "
            "ELSE greatest(best[j + 1] + 24, list_max(list_transform(range(0, j), lambda k: best[k + 1] - 3 - (j - 1 - k))) + 16) END")
    return f"""ab0 AS (SELECT a, b, {bare_sql('a')} AS x, {bare_sql('b')} AS y FROM {pairs}),
        ab1 AS (SELECT a, b, CASE WHEN length(x) < length(y) OR length(x) = length(y) AND x <= y THEN x ELSE y END AS x, CASE WHEN length(x) < length(y) OR length(x) = length(y) AND x <= y THEN y ELSE x END AS y FROM ab0),
        abr(a, b, x, y, i, best) AS (SELECT a, b, x, y, 0, list_transform(range(0, length(y) + 1), lambda j: NULL::BIGINT) FROM ab1 UNION ALL
          SELECT a, b, x, y, i + 1, list_prepend(NULL::BIGINT, list_transform(range(0, length(y)), lambda j: CASE WHEN substr(y, j + 1, 1) = substr(x, i + 1, 1) THEN {here} END)) FROM abr WHERE i < length(x)),
        abb AS (SELECT a, b, CASE WHEN length(x) = 0 THEN 0.0 ELSE coalesce(least(1.0, greatest(0.0, list_max(best)::DOUBLE / (24 * length(x)))), 0.0) END AS score FROM abr WHERE i = length(x))"""


def _word_sql(a: str, b: str) -> str:
    m = f"least(length({a}), length({b}))"
    head = f"len(list_filter(range(1, {m} + 1), lambda i: left({a}, i) = left({b}, i)))"
    tail = f"least({m} - {head}, len(list_filter(range(1, {m} + 1), lambda i: right({a}, i) = right({b}, i))))"
    return f"CASE WHEN {a} = {b} THEN 1.0 ELSE ({head} + {tail})::DOUBLE * {m} / (greatest(length({a}), length({b})) ** 2) END"


_LONG = "greatest(length(a), length(b))"
_SHORT = "least(length(a), length(b))"


_CODES = "[" + ", ".join(f"chr({i})" for i in range(1, 32)) + "]"


def plain_sql(x: str, both: str) -> str:
    """``x`` with the letters beyond ASCII of ``both`` as control characters: similarities go by bytes there."""
    odd = f"list_sort(list_distinct(regexp_extract_all({both}, '[^\\x00-\\x7f]')))"
    return f"translate({x}, array_to_string({odd}, ''), array_to_string({_CODES}[:len({odd})], ''))"


_PLAIN = f"pl AS (SELECT a AS a0, b AS b0, {plain_sql('a', 'a || b')} AS a, {plain_sql('b', 'a || b')} AS b FROM pr)"


def _pair_sql(expr: str) -> str:
    return f"WITH {_PAIRS}, {_PLAIN} SELECT a0 AS a, b0 AS b, round(({expr})::DOUBLE, 9) AS score FROM pl"


_SPLIT = r"regexp_extract_all(regexp_replace({x}, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]+[a-z]*|[a-z]+|[0-9]+')"
_WORDS_OR_NAME = lambda x: f"CASE WHEN len({_SPLIT.format(x=x)}) = 0 THEN [{x}] ELSE {_SPLIT.format(x=x)} END"
_STOP = "['" + "', '".join(w.replace("'", "''") for w in X.STOP_WORDS) + "']"
_BEST = lambda p, q: f"list_sum(list_transform({p}, lambda w: list_max(list_transform({q}, lambda v: {_word_sql('w', 'v')}))))"

SQL = {
    "fn_normalize_name": f"WITH {_LISTED} SELECT name, {bare_sql('name')} AS bare FROM nm",
    "fn_tokenize_name": f"WITH {_LISTED} SELECT name, array_to_string(list_sort({words_sql('name')}), ' ') AS words FROM nm",
    "fn_name_tokens": f"WITH {_LISTED}, t AS (SELECT name, {tokens_sql('name')} AS w FROM nm) SELECT name, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS tokens FROM t",
    "fn_split_words": f"WITH {_LISTED} SELECT name, array_to_string({_WORDS_OR_NAME('name')}, ' ') AS words FROM nm",
    "fn_document_tokens": f"""SELECT token, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(sample_text), '[^a-z0-9]+')) AS token FROM lang_samples)
        WHERE token <> '' AND NOT list_contains({_STOP}, token) GROUP BY token""",
    "fn_types": """WITH t AS (SELECT DISTINCT data_type AS a FROM field_profiles WHERE data_type <> ''),
        f AS (SELECT a, CASE WHEN a = 'integer' THEN 'int' WHEN a IN ('float', 'decimal') THEN 'float' WHEN a IN ('date', 'timestamp') THEN 'date' ELSE a END AS f FROM t)
        SELECT x.a, y.a AS b, CASE WHEN 'unknown' IN (x.a, y.a) THEN 0.5 WHEN x.a = y.a THEN 1.0 WHEN x.a IN ('integer', 'float', 'decimal') AND y.a IN ('integer', 'float', 'decimal') THEN 0.75
                 WHEN x.a IN ('date', 'timestamp') AND y.a IN ('date', 'timestamp') THEN 0.65 ELSE 0.0 END::DOUBLE AS suggestion,
               CASE WHEN x.f = y.f THEN 1.0 WHEN x.f IN ('int', 'float') AND y.f IN ('int', 'float') THEN 0.5 WHEN x.f IN ('text', 'date') AND y.f IN ('text', 'date') THEN 0.3 ELSE 0.0 END::DOUBLE AS family
        FROM f x, f y""",
    "fn_unit_vectors": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v)
        SELECT vec_id, CASE WHEN n > 0 THEN round(e[1] / n, 6) END AS first, CASE WHEN n > 0 THEN 1.0::DOUBLE END AS length FROM n""",
    "fn_parsed_numbers": r"""WITH v AS (SELECT DISTINCT value FROM (SELECT unnest(samples) AS value FROM field_profiles) WHERE regexp_full_match(value, '[\x20-\x7e]+')),
        t AS (SELECT value, trim(value) AS s, regexp_replace(regexp_replace(trim(value), '([0-9])_([0-9])', '\1\2', 'g'), '([0-9])_([0-9])', '\1\2', 'g') AS j FROM v),
        n AS (SELECT value, CASE WHEN regexp_full_match(j, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(j AS DOUBLE)
                WHEN lower(s) IN ('inf', '+inf', 'infinity', '+infinity') THEN 'infinity'::DOUBLE WHEN lower(s) IN ('-inf', '-infinity') THEN '-infinity'::DOUBLE END AS number FROM t)
        SELECT value, CASE WHEN number = 0 THEN 0.0 ELSE number END AS number FROM n WHERE number IS NOT NULL""",
    "fn_levenshtein": _pair_sql(f"1 - levenshtein(a, b)::DOUBLE / {_LONG}"), "fn_damerau": _pair_sql(f"1 - damerau_levenshtein(a, b)::DOUBLE / {_LONG}"),
    "fn_hamming": _pair_sql(f"({_SHORT} - hamming(left(a, {_SHORT}), left(b, {_SHORT})))::DOUBLE / {_LONG}"),
    "fn_jaro": _pair_sql("jaro_similarity(a, b)"), "fn_jaro_winkler": _pair_sql("jaro_winkler_similarity(a, b)"), "fn_name_score": f"WITH {_PAIRS} SELECT a, b, round({name_score_sql('a', 'b')}, 9) AS score FROM pr",
    "fn_is_abbreviation": _pair_sql(f"CASE WHEN {abbreviation_sql('a', 'b')} THEN 1.0 ELSE 0.0 END"), "fn_word_similarity": _pair_sql(_word_sql("a", "b")),
    "fn_trigram": f"WITH {_PAIRS}, {trigram_sql('pr')} SELECT a, b, round(score, 9) AS score FROM trisim",
    "fn_tokens_similarity": f"WITH RECURSIVE {_PAIRS}, {tokens_similarity_sql('pr')} SELECT a, b, round(score, 9) AS score FROM toksim",
    "fn_abbreviation_score": f"WITH RECURSIVE {_PAIRS}, {abbreviation_score_sql('pr')} SELECT a, b, round(score, 9) AS score FROM abb",
    "fn_prefix_suffix": f"""WITH {_PAIRS}, w AS (SELECT a, b, {_WORDS_OR_NAME('a')} AS p, {_WORDS_OR_NAME('b')} AS q FROM pr)
        SELECT a, b, round(({_BEST('p', 'q')} + {_BEST('q', 'p')}) / (len(p) + len(q)), 9) AS score FROM w""",
}
