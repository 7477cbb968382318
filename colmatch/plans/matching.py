"""Queries of the matchers, selectors and metrics over the star schema, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colmatch.functions import expressions as X
from colmatch.operators import coma, cupid, distribution, flooding, jaccard, metrics, results, suggest
from colmatch.plans import scalar as S
from colmatch.plans.shared import materialize, table
from colmatch.sources import profile

STAR = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
}
# every text column
TEXT = {"region": "r_name", "nation": "n_name", "customer": "c_name c_mktsegment", "supplier": "s_name", "part": "p_name p_brand p_type", "orders": "o_orderstatus o_orderpriority",
        "lineitem": "l_returnflag l_linestatus", "events": "event_type props"}
TRUTH = [
    ("customer", "c_custkey", "orders", "o_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey"), ("part", "p_partkey", "lineitem", "l_partkey"),
    ("supplier", "s_suppkey", "lineitem", "l_suppkey"), ("nation", "n_nationkey", "customer", "c_nationkey"), ("nation", "n_nationkey", "supplier", "s_nationkey"),
    ("region", "r_regionkey", "nation", "n_regionkey"),
]


def _profile(spark: SparkSession, sf_dir: str, columns: dict[str, str]) -> profile.Profile:
    return profile.from_dataframes([(t, table(spark, sf_dir, t).select(*cols.split())) for t, cols in columns.items()])


def star(spark: SparkSession, sf_dir: str) -> profile.Profile:
    return _profile(spark, sf_dir, STAR)


def texts(spark: SparkSession, sf_dir: str) -> profile.Profile:
    return _profile(spark, sf_dir, TEXT)


def truth(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRUTH, "source_table string, source_column string, target_table string, target_column string")


def delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored pairs of match_entries as one result: valid rows, a pair with its best score."""
    e = table(spark, sf_dir, "match_entries")
    ok = F.col("score").between(0.0, 1.0) & ~F.isnan("score")
    for c in results.KEYS:
        ok = ok & (F.col(c) != "")
    return e.where(ok).groupBy(*results.KEYS).agg(F.max("score").alias("score"))


def profile_columns(spark, sf_dir):
    p = star(spark, sf_dir)
    n = p.counts.groupBy("col_id").agg(F.sum("n").alias("n_values"), F.count(F.lit(1)).alias("n_distinct"))
    return p.table().join(n, "col_id").select("table", "column", "dtype", "n_values", "n_distinct")


def infer_types(spark, sf_dir):
    p = star(spark, sf_dir)
    return profile.infer_types(p.counts).join(p.table().select("col_id", "table", "column"), "col_id").select("table", "column", "dtype")


def sample_even(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("c_name").alias("column"), "c_custkey", F.col("c_name").alias("value"))
    return profile.sample_evenly(c, "column", "c_custkey", 100).select("column", "value")


def jaccard_exact(spark, sf_dir):
    return jaccard.jaccard(star(spark, sf_dir), "exact")


def tversky_containment(spark, sf_dir):
    return jaccard.jaccard(star(spark, sf_dir), "exact", alpha=1.0, beta=0.0)


def tversky_asym(spark, sf_dir):
    return jaccard.jaccard(star(spark, sf_dir), "exact", alpha=0.25, beta=0.75)


def _fuzzy(distance: str, threshold: float):
    def run(spark, sf_dir):
        return jaccard.jaccard(texts(spark, sf_dir), distance, threshold).withColumn("score", F.round("score", 9))

    return run


def jaccard_cosine(spark, sf_dir):
    """Vectors of even labels against those of odd ones."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("value"), F.col("embedding").alias("vector"), (F.col("label") % 2).alias("odd"))
    p = profile.from_dataframes([("even", e.where("odd = 0").select("value")), ("odd", e.where("odd = 1").select("value"))])
    return p.named(jaccard.vector_scores(p, e, 0.5).withColumn("score", F.round("score", 9)))


def work_counts(spark, sf_dir):
    cells, work = jaccard.work_counts(star(spark, sf_dir))
    return spark.createDataFrame([(cells, work)], "cells long, comparisons long")


def name_trigram(spark, sf_dir):
    pairs = star(spark, sf_dir).pairs()
    return pairs.select(F.col("table_a").alias("source_table"), F.col("column_a").alias("source_column"), F.col("table_b").alias("target_table"), F.col("column_b").alias("target_column"),
                        F.round(X.trigram_similarity(F.col("column_a"), F.col("column_b")), 9).alias("score"))


def coma_name(spark, sf_dir):
    return coma.coma(star(spark, sf_dir)).select(*results.KEYS, F.round("score", 9).alias("score"))


def tfidf_idf(spark, sf_dir):
    return coma.idf(texts(spark, sf_dir)).select("token", "df", F.round("idf", 9).alias("idf"))


def tfidf_vectors(spark, sf_dir):
    return coma.vectors(texts(spark, sf_dir)).select("value", "token", F.round("weight", 9).alias("weight"))


def coma_instances(spark, sf_dir):
    p = texts(spark, sf_dir)
    return p.named(coma.instance_scores(p).select("a", "b", F.round("instance_score", 9).alias("score")))


def coma_combined(spark, sf_dir):
    return coma.coma(texts(spark, sf_dir), use_instances=True, instance_weight=2.5, max_n=2).select(*results.KEYS, F.round("score", 9).alias("score"))


def _fields(spark, sf_dir, name: str) -> tuple[DataFrame, DataFrame]:
    """The columns of a table as fields, and all distinct values of each."""
    p = _profile(spark, sf_dir, {name: STAR[name]})
    values = p.counts.join(F.broadcast(p.table().select("col_id", F.col("ordinal").alias("pos"))), "col_id").select("pos", "value")
    return p.table().select(F.col("ordinal").alias("pos"), F.col("column").alias("name"), F.col("dtype").alias("data_type")), values


def suggest_candidates(spark, sf_dir):
    (source, s), (target, t) = _fields(spark, sf_dir, "customer"), _fields(spark, sf_dir, "supplier")
    c = suggest.candidates(source, target, s, t)
    return c.select("source", "target", F.round("name_score", 9).alias("name_score"), "type_score", F.round("sample_score", 9).alias("sample_score"))


def suggest_decisions(spark, sf_dir):
    (source, s), (target, t) = _fields(spark, sf_dir, "customer"), _fields(spark, sf_dir, "supplier")
    return suggest.suggest(source, target, None, s, t).select("source", "decision", F.round("best_score", 9).alias("best_score"), "target")


def dist_ranks(spark, sf_dir):
    return distribution.value_ranks(star(spark, sf_dir))


def dist_quantiles(spark, sf_dir):
    p = star(spark, sf_dir)
    q = distribution.quantiles(distribution.column_ranks(p), 16)
    return q.join(p.table().select("col_id", "table", "column"), "col_id").select("table", "column", "i", F.round("boundary", 6).alias("boundary"))


def dist_bloom_bits(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("value"))
    bits, hashes = distribution.bloom_size(n.count())
    return n.select("value", F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))).alias("seed")).select("value", "seed", distribution.bloom_index(F.col("value"), F.col("seed"), F.lit(bits)).alias("bit"))


def dist_matches(spark, sf_dir):
    return distribution.distribution_based(star(spark, sf_dir), q=64)


def flood_weights(spark, sf_dir):
    return flooding.product_edges(star(spark, sf_dir))


def flood_scores(spark, sf_dir):
    return flooding.similarity_flooding(star(spark, sf_dir))


def cupid_scores(spark, sf_dir):
    return cupid.cupid(star(spark, sf_dir), th_accept=0.4).drop("details")


def rank_top_n(spark, sf_dir):
    return results.take_top_n(delivered(spark, sf_dir), 100)


def rank_top_percent(spark, sf_dir):
    return results.take_top_percent(delivered(spark, sf_dir), 2.5)


def rank_per_source(spark, sf_dir):
    return results.take_top_n_per_source(delivered(spark, sf_dir), 3)


def mutual_top(spark, sf_dir):
    return results.one_to_one_mutual_top(delivered(spark, sf_dir), 2)


def default_cutoff(spark, sf_dir):
    return spark.createDataFrame([(results.default_cutoff(delivered(spark, sf_dir)),)], "cutoff double")


def score_filter(spark, sf_dir):
    return results.filter_score(delivered(spark, sf_dir), 0.9)


def greedy_select(spark, sf_dir):
    return results.one_to_one_greedy(jaccard_exact(spark, sf_dir), 0.3)


def _assigned(method: str):
    def run(spark, sf_dir):
        return results.one_to_one(jaccard_exact(spark, sf_dir), method, 0.3)

    return run


def metrics_prf(spark, sf_dir):
    m, t = materialize(jaccard_exact(spark, sf_dir).where("score >= 0.9"), "matches"), truth(spark)
    return spark.createDataFrame([(metrics.precision(m, t), metrics.recall(m, t), metrics.f1(m, t))], "precision double, recall double, f1 double")


def metrics_topn_curve(spark, sf_dir):
    return metrics.precision_curve(jaccard_exact(spark, sf_dir), truth(spark)).select("percent", F.round("precision", 9).alias("precision"))


def metrics_recall_at_gold(spark, sf_dir):
    return spark.createDataFrame([(metrics.recall_at_size_of_truth(jaccard_exact(spark, sf_dir), truth(spark)),)], "recall double")


def metrics_mrr(spark, sf_dir):
    return spark.createDataFrame([(round(metrics.mean_reciprocal_rank(jaccard_exact(spark, sf_dir), truth(spark)), 9),)], "mrr double")


def metrics_selection(spark, sf_dir):
    """The named measures of a mutual-top selection and of all candidates."""
    got = metrics.get_metrics(jaccard_exact(spark, sf_dir), truth(spark), how="mutual_top")
    return spark.createDataFrame([(k, round(v, 9)) for k, v in got.items()], "metric string, value double")


def dist_shared(spark, sf_dir, bloom=False):
    """How many values of a column another one holds, with repeats: by value, or by its Bloom filter."""
    p = _profile(spark, sf_dir, SMALL)
    shared = distribution.shared_ranks(distribution.column_ranks(p), [c.col_id for c in p.columns], bloom)
    return p.named(shared.groupBy("a", "b").agg(F.sum("n").alias("n_shared")))


def dist_bloom_shared(spark, sf_dir):
    return dist_shared(spark, sf_dir, True)


def scan_csv(spark, sf_dir):
    """The customers, written as CSV and read again: all columns text."""
    return _scanned(spark, sf_dir, "customer", "csv")


def scan_json(spark, sf_dir):
    """The nations, written as an array of objects and read again."""
    return _scanned(spark, sf_dir, "nation", "json")


def _scanned(spark, sf_dir, name: str, kind: str):
    from colmatch.plans.shared import shared_path
    from colmatch.sources import readers

    t = table(spark, sf_dir, name).select(*(F.col(c).cast("string").alias(c) for c in STAR[name].split()))
    path = f"{shared_path(spark, kind)}.{kind}"
    if kind == "csv":
        t.write.csv(path, header=True, quote='"', escape='"')
    else:
        t.agg(F.to_json(F.collect_list(F.struct(*t.columns))).alias("value")).write.text(path)  # one document is one row
    return readers.from_path(spark, path)


def scan_types(spark, sf_dir):
    """Types inferred from the texts of customers and suppliers."""
    tables = [(n, table(spark, sf_dir, n).select(*(F.col(c).cast("string").alias(c) for c in STAR[n].split()))) for n in ("customer", "supplier")]
    p = profile.with_inferred_types(profile.from_dataframes(tables))
    return p.table().select("table", "column", "dtype")


SMALL = {t: STAR[t] for t in ("region", "nation", "customer", "supplier")}
QUERIES = {f.__name__: f for f in (
    metrics_selection, dist_shared, dist_bloom_shared, scan_csv, scan_json, scan_types,
    profile_columns, infer_types, sample_even, jaccard_exact, tversky_containment, tversky_asym, jaccard_cosine, work_counts, name_trigram, coma_name, tfidf_idf, tfidf_vectors,
    coma_instances, coma_combined, suggest_candidates, suggest_decisions, dist_ranks, dist_quantiles, dist_bloom_bits, dist_matches, flood_weights, flood_scores, cupid_scores,
    rank_top_n, rank_top_percent, rank_per_source, mutual_top, default_cutoff, score_filter, greedy_select, metrics_prf, metrics_topn_curve, metrics_recall_at_gold, metrics_mrr)}
_DISTANCES = {"jaccard_lev": ("levenshtein", 0.5), "jaccard_damerau": ("damerau_levenshtein", 0.5), "jaccard_jaro": ("jaro", 0.6), "jaccard_jw": ("jaro_winkler", 0.65), "jaccard_hamming": ("hamming", 0.3)}
QUERIES |= {name: _fuzzy(*how) for name, how in _DISTANCES.items()}
QUERIES |= {"hungarian": _assigned("hungarian"), "hungarian_aware": _assigned("hungarian_aware"), "rectangular": _assigned("rectangular"), "rectangular_aware": _assigned("rectangular_aware")}

# --- SQL ---------------------------------------------------------------------------------------


def _counts_sql(columns: dict[str, str]) -> str:
    parts, cid = [], 0
    for no, (t, cols) in enumerate(columns.items()):
        for c in cols.split():
            parts.append(f"SELECT {cid} AS c, {no} AS t, '{t}' AS tab, '{c}' AS col, CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '' GROUP BY ALL")
            cid += 1
    return "vals AS (" + " UNION ALL ".join(parts) + ")"


_KIND = ("CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT') THEN 'integer' WHEN column_type IN ('DOUBLE', 'FLOAT') THEN 'float' WHEN column_type LIKE 'DECIMAL%' THEN 'decimal' "
         "WHEN column_type = 'BOOLEAN' THEN 'boolean' WHEN column_type = 'DATE' THEN 'date' WHEN column_type LIKE 'TIMESTAMP%' THEN 'timestamp' ELSE 'text' END")


def _fields_sql(columns: dict[str, str]) -> str:
    """fields: t, tab, i, col, kind of the chosen columns, the types as their tables declare them."""
    parts = [f"SELECT {no} AS t, '{t}' AS tab, {i} AS i, column_name AS col, {_KIND} AS kind FROM (DESCRIBE {t}) WHERE column_name = '{c}'"
             for no, (t, cols) in enumerate(columns.items()) for i, c in enumerate(cols.split())]
    return "fields AS (" + " UNION ALL ".join(parts) + ")"


_STAR, _TEXT = _counts_sql(STAR), _counts_sql(TEXT)
_SIZES = "sizes AS (SELECT c, t, tab, col, count(*) AS m FROM vals GROUP BY ALL)"


def _tversky_sql(alpha: float, beta: float) -> str:
    one = f"(s::DOUBLE / (s + {alpha} * (x.m - s) + {beta} * (y.m - s)))"
    two = f"(s::DOUBLE / (s + {alpha} * (y.m - s) + {beta} * (x.m - s)))"
    return f"""WITH {_STAR}, {_SIZES},
        met AS (SELECT a.c AS ca, b.c AS cb, count(*) AS s FROM vals a JOIN vals b ON a.v = b.v AND a.t < b.t GROUP BY ALL)
        SELECT x.tab AS source_table, x.col AS source_column, y.tab AS target_table, y.col AS target_column, greatest({one}, {two}) AS score
        FROM met JOIN sizes x ON x.c = ca JOIN sizes y ON y.c = cb"""


def _fuzzy_sql(expr: str, threshold: float) -> str:
    return f"""WITH {_TEXT}, {_SIZES},
        near AS (SELECT x.v AS x, y.v AS y FROM (SELECT DISTINCT v FROM vals) x, (SELECT DISTINCT v FROM vals) y WHERE {expr} >= {X.float_cutoff(threshold)!r}),
        hits AS (SELECT a.c AS ca, b.c AS cb, a.t AS ta, b.t AS tb, count(DISTINCT a.v) AS m FROM vals a JOIN near ON a.v = x JOIN vals b ON b.v = y AND a.t <> b.t GROUP BY ALL),
        two AS (SELECT f.ca, f.cb, f.m AS ma, g.m AS mb FROM hits f JOIN hits g ON f.ca = g.cb AND f.cb = g.ca WHERE f.ta < f.tb)
        SELECT p.tab AS source_table, p.col AS source_column, q.tab AS target_table, q.col AS target_column,
               round(greatest(ma::DOUBLE / (ma + (p.m - ma) + (q.m - mb)), mb::DOUBLE / (mb + (q.m - mb) + (p.m - ma))), 9) AS score
        FROM two JOIN sizes p ON p.c = ca JOIN sizes q ON q.c = cb"""


_LONGEST = "greatest(length(x.v), length(y.v))"
_SHORTEST = "least(length(x.v), length(y.v))"
_HAMMING = f"({_SHORTEST} - hamming(left(x.v, {_SHORTEST}), left(y.v, {_SHORTEST})))::DOUBLE / {_LONGEST}"
_DELIVERED = """best AS (SELECT source_table, source_column, target_table, target_column, max(score) AS score FROM match_entries
          WHERE source_table <> '' AND source_column <> '' AND target_table <> '' AND target_column <> ''
            AND score IS NOT NULL AND NOT isnan(score) AND score >= 0 AND score <= 1 GROUP BY ALL)"""
_RANK = "ORDER BY score DESC, source_table, source_column, target_table, target_column"
_FIVE = "source_table, source_column, target_table, target_column, score"
_TRUTH = "truth(source_table, source_column, target_table, target_column) AS (VALUES " + ", ".join(str(t) for t in TRUTH) + ")"
_JACCARD = _tversky_sql(1.0, 1.0)
_STOP = "['" + "', '".join(w.replace("'", "''") for w in X.STOP_WORDS) + "']"
_TOKENS = f"""per AS (SELECT v, sum(n) AS n FROM vals GROUP BY v),
        docs AS (SELECT v, n, list_filter(regexp_split_to_array(lower(v), '[^a-z0-9]+'), lambda w: w <> '' AND NOT list_contains({_STOP}, w)) AS tokens FROM per),
        filled AS (SELECT * FROM docs WHERE len(tokens) > 0),
        idf AS (SELECT token, sum(n)::BIGINT AS df, ln((SELECT sum(n) FROM filled) / sum(n)) AS idf FROM (SELECT n, unnest(list_distinct(tokens)) AS token FROM filled) GROUP BY token),
        w AS (SELECT v, token, sqrt(count(*)) * any_value(idf) AS w FROM (SELECT v, unnest(tokens) AS token FROM filled) JOIN idf USING (token) GROUP BY v, token),
        vec AS (SELECT v, token, w / sqrt(sum(w * w) OVER (PARTITION BY v)) AS weight FROM w WHERE w > 0)"""
_NUMBER_SQL = "regexp_full_match(trim(v), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')"

_NAMED = """nm AS (SELECT x.t AS t, y.t AS u, x.tab AS source_table, x.col AS a, y.tab AS target_table, y.col AS b FROM fields x JOIN fields y ON x.t < y.t),
        pr AS (SELECT DISTINCT a, b FROM nm)"""


def _coma_sql(columns: dict[str, str], max_n: int = 0, weight: float | None = None, delta: float = 0.15) -> str:
    """Names by trigrams or tokens, with instances if ``weight`` is given, cut on both sides of each table pair."""
    inst = ""
    score = "n"
    if weight is not None:
        inst = f", {_counts_sql(columns)}, {_TOKENS}, {_INSTANCES}"
        score = f"(n + {weight!r} * coalesce(i, 0)) / {1 + weight!r}"
    join = "LEFT JOIN inst ON inst.source_table = nm.source_table AND inst.source_column = nm.a AND inst.target_table = nm.target_table AND inst.target_column = nm.b" if weight is not None else ""
    i = "inst.score" if weight is not None else "NULL::DOUBLE"
    cut = lambda side: (f"greatest(max(score) OVER (PARTITION BY t, u, {side}) * {1 - delta!r}" + (
        f", list_reverse_sort(list(score) OVER (PARTITION BY t, u, {side}))[least({max_n}, count(*) OVER (PARTITION BY t, u, {side}))]" if max_n else "") + ")")
    return f"""WITH RECURSIVE {_fields_sql(columns)}{inst}, {_NAMED}, {S.trigram_sql('pr')}, {S.tokens_similarity_sql('pr')},
        sc AS (SELECT nm.*, greatest(x.score, y.score) AS n, {i} AS i FROM nm JOIN trisim x ON x.a = nm.a AND x.b = nm.b JOIN toksim y ON y.a = nm.a AND y.b = nm.b {join}),
        st AS (SELECT *, {score} AS score FROM sc), ct AS (SELECT *, {cut('a')} AS ca, {cut('b')} AS cb FROM st)
        SELECT source_table, a AS source_column, target_table, b AS target_column, round(score, 9) AS score FROM ct WHERE score > 0 AND score >= ca AND score >= cb"""


_INSTANCES = """cos AS (SELECT a.v AS x, b.v AS y, least(sum(a.weight * b.weight), 1.0) AS c FROM vec a JOIN vec b USING (token) GROUP BY ALL),
        held AS (SELECT vals.* FROM vals SEMI JOIN filled USING (v)),
        best AS (SELECT l.c AS ca, r.c AS cb, l.t AS ta, r.t AS tb, l.v, any_value(l.n) AS n, max(cos.c) AS m FROM held l JOIN cos ON l.v = x JOIN held r ON r.v = y AND r.t <> l.t GROUP BY ALL),
        s AS (SELECT ca, cb, ta, tb, sum(m * n) AS s FROM best GROUP BY ALL), occ AS (SELECT c, tab, col, sum(n) AS o FROM held GROUP BY ALL),
        inst AS (SELECT p.tab AS source_table, p.col AS source_column, q.tab AS target_table, q.col AS target_column, (f.s + g.s) / (p.o + q.o) AS score
                 FROM s f JOIN s g ON f.ca = g.cb AND f.cb = g.ca AND f.ta < f.tb JOIN occ p ON p.c = f.ca JOIN occ q ON q.c = f.cb)"""
_TWO = {t: STAR[t] for t in ("customer", "supplier")}
_SUGGEST = f"""{_fields_sql(_TWO)}, {_counts_sql(_TWO)}, cl AS (SELECT DISTINCT col, lower(trim(v)) AS v FROM vals WHERE trim(v) <> ''), sz AS (SELECT col, count(*) AS n FROM cl GROUP BY col),
        sh AS (SELECT a.col AS a, b.col AS b, count(*) AS s FROM cl a JOIN cl b USING (v) GROUP BY ALL),
        sc AS (SELECT x.col AS source, y.col AS target, {S.name_score_sql('x.col', 'y.col')} AS name_score,
                 CASE WHEN x.kind = y.kind THEN 1.0 WHEN x.kind IN ('integer', 'float', 'decimal') AND y.kind IN ('integer', 'float', 'decimal') THEN 0.75 WHEN x.kind IN ('date', 'timestamp') AND y.kind IN ('date', 'timestamp') THEN 0.65 ELSE 0.0 END::DOUBLE AS type_score,
                 CASE WHEN p.n < 2 OR q.n < 2 THEN 0.0 ELSE coalesce(s, 0)::DOUBLE / greatest(p.n, q.n) END AS sample
               FROM fields x JOIN fields y ON x.tab = 'customer' AND y.tab = 'supplier' JOIN sz p ON p.col = x.col JOIN sz q ON q.col = y.col LEFT JOIN sh ON sh.a = x.col AND sh.b = y.col),
        tp AS (SELECT *, max(sample) OVER (PARTITION BY source) AS top FROM sc), tm AS (SELECT *, count(*) FILTER (abs(sample - top) <= 1e-12) OVER (PARTITION BY source) AS many FROM tp),
        cd AS (SELECT source, target, name_score, type_score, CASE WHEN top > 0 AND many > 1 AND abs(sample - top) <= 1e-12 THEN sample / 2 ELSE sample END AS sample FROM tm)"""
_EDGES = f"""{_fields_sql(STAR)}, ft AS (SELECT t, tab, i, col, CASE kind WHEN 'integer' THEN 'int' WHEN 'float' THEN 'float' WHEN 'decimal' THEN 'float' WHEN 'date' THEN 'date' WHEN 'timestamp' THEN 'date' ELSE 'varchar' END AS k FROM fields),
        fn AS (SELECT *, i = min(i) OVER (PARTITION BY t, k) AS fresh FROM ft),
        fs AS (SELECT *, 3 + coalesce(sum(CASE WHEN i = 0 THEN 3 ELSE 2 END + CASE WHEN fresh AND i = 0 THEN 3 WHEN fresh THEN 2 ELSE 0 END)
                  OVER (PARTITION BY t ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS c FROM fn),
        fc AS (SELECT *, c + CASE WHEN i = 0 THEN 2 ELSE 1 END AS name FROM fs),
        fo AS (SELECT *, max(CASE WHEN fresh THEN name + 1 END) OVER (PARTITION BY t, k) AS owner FROM fc),
        ed AS (SELECT DISTINCT t, 0 AS u, 1 AS v, 'Name' AS label FROM fo UNION ALL SELECT DISTINCT t, 0, 2, 'Type' FROM fo UNION ALL SELECT t, c, 4, 'Type' FROM fo UNION ALL SELECT t, 0, c, 'Column' FROM fo
               UNION ALL SELECT t, c, name, 'Name' FROM fo UNION ALL SELECT t, c, owner, 'SqlType' FROM fo
               UNION ALL SELECT t, owner, 7, 'Type' FROM fo WHERE fresh UNION ALL SELECT t, owner, CASE WHEN i = 0 THEN owner + 2 ELSE owner + 1 END, 'Name' FROM fo WHERE fresh),
        dg AS (SELECT *, count(*) OVER (PARTITION BY t, label, u) AS dout, count(*) OVER (PARTITION BY t, label, v) AS din FROM ed),
        bo AS (SELECT x.t AS g_1, y.t AS g_2, x.u AS u1, x.v AS v1, y.u AS u2, y.v AS v2, x.dout AS o1, y.dout AS o2, x.din AS i1, y.din AS i2 FROM dg x JOIN dg y ON x.label = y.label AND x.t < y.t)"""

def _selection_sql() -> str:
    on = "SEMI JOIN truth USING (source_table, source_column, target_table, target_column)"
    part = lambda n: f"(SELECT count(*) FROM (SELECT * FROM ms WHERE r <= ceil({n} * c / 100)) {on})::DOUBLE / (SELECT ceil({n} * any_value(c) / 100) FROM ms)"
    rows = [f"SELECT 'Precision' AS metric, hit::DOUBLE / f AS value FROM k", "SELECT 'Recall', hit::DOUBLE / g FROM k", "SELECT 'F1Score', 2.0 * hit / (f + g) FROM k"]
    rows += [f"SELECT 'PrecisionTop{n}Percent', {part(n)}" for n in (10, 30, 50, 70, 90)]
    rows += [f"SELECT 'RecallAtSizeofGroundTruth', (SELECT count(*) FROM (SELECT * FROM j {_RANK} LIMIT {len(TRUTH)}) {on})::DOUBLE / {len(TRUTH)}",
             f"SELECT 'MeanReciprocalRank', (SELECT sum(rr) FROM (SELECT 1.0 / min(r) AS rr FROM rs {on} GROUP BY source_table, source_column)) / (SELECT count(*) FROM (SELECT DISTINCT source_table, source_column FROM truth))"]
    return f"""WITH j AS ({_JACCARD}), {_TRUTH}, rs AS (SELECT *, row_number() OVER (PARTITION BY source_table, source_column {_RANK}) AS r, row_number() OVER (PARTITION BY target_table, target_column {_RANK}) AS q FROM j),
        ms AS (SELECT * EXCLUDE (r, q), row_number() OVER ({_RANK}) AS r, count(*) OVER () AS c FROM rs WHERE r = 1 AND q = 1),
        k AS (SELECT (SELECT count(*) FROM ms {on}) AS hit, (SELECT count(*) FROM ms) AS f, {len(TRUTH)} AS g)
        SELECT metric, round(value::DOUBLE, 9) AS value FROM ({' UNION ALL '.join(rows)})"""


def _texts_sql(name: str) -> str:
    return "SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in STAR[name].split()) + f" FROM {name}"


_SHARED_SQL = f"""WITH {_counts_sql(SMALL)}, {_SIZES}, own AS (SELECT c, sum(n)::BIGINT AS n FROM vals GROUP BY c)"""
_NAMED_SHARED = "x.tab AS source_table, x.col AS source_column, y.tab AS target_table, y.col AS target_column"

SQL = {
    "metrics_selection": _selection_sql(), "scan_csv": _texts_sql("customer"), "scan_json": _texts_sql("nation"),
    "scan_types": f"""WITH {_counts_sql(_TWO)} SELECT tab AS "table", col AS "column", CASE WHEN bool_and(lower(trim(v)) IN ('true', 'false')) THEN 'boolean'
        WHEN bool_and(regexp_full_match(v, '[+-]?[0-9]+')) THEN 'integer' WHEN bool_and(regexp_full_match(v, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')) THEN 'float' ELSE 'text' END AS dtype FROM vals GROUP BY tab, col""",
    "dist_shared": f"""{_SHARED_SQL} SELECT {_NAMED_SHARED}, sum(a.n)::BIGINT AS n_shared FROM vals a JOIN vals b ON a.v = b.v AND a.c <> b.c JOIN sizes x ON x.c = a.c JOIN sizes y ON y.c = b.c GROUP BY ALL""",
    "dist_bloom_shared": f"""{_SHARED_SQL}, sh AS (SELECT c, greatest(1, floor(-n * ln(0.01) / ln(2) ^ 2))::BIGINT AS bits, greatest(1, floor(floor(-n * ln(0.01) / ln(2) ^ 2) / n * ln(2)))::BIGINT AS hashes FROM own),
        hs AS (SELECT v, s, ('0x' || substr(sha256(s || ':' || v), 1, 16))::UBIGINT AS h FROM (SELECT DISTINCT v FROM vals), range(0, (SELECT max(hashes) FROM sh)) r(s)),
        bt AS (SELECT DISTINCT vals.c, (h % bits)::BIGINT AS bit FROM vals JOIN sh ON sh.c = vals.c JOIN hs ON hs.v = vals.v AND hs.s < hashes),
        hit AS (SELECT a.c AS a, sh.c AS b, a.v, any_value(a.n) AS n FROM vals a JOIN sh ON sh.c <> a.c JOIN hs ON hs.v = a.v AND hs.s < hashes JOIN bt ON bt.c = sh.c AND bt.bit = (h % bits)::BIGINT GROUP BY a.c, sh.c, a.v HAVING count(*) = any_value(hashes))
        SELECT {_NAMED_SHARED}, sum(hit.n)::BIGINT AS n_shared FROM hit JOIN sizes x ON x.c = a JOIN sizes y ON y.c = b GROUP BY ALL""",
    "coma_name": _coma_sql(STAR), "coma_combined": _coma_sql(TEXT, 2, 2.5),
    "flood_weights": f"""WITH {_EDGES}, pe AS (SELECT g_1, g_2, v1 AS from_1, v2 AS from_2, u1 AS to_1, u2 AS to_2, 2.0 / (i1 + i2) AS w, 0 AS prio FROM bo UNION ALL SELECT g_1, g_2, u1, u2, v1, v2, 2.0 / (o1 + o2), 1 FROM bo)
        SELECT g_1, g_2, from_1, from_2, to_1, to_2, arg_max(w, prio)::DOUBLE AS weight FROM pe GROUP BY ALL""",
    "suggest_candidates": f"""WITH {_SUGGEST}
        SELECT source, target, round(name_score, 9) AS name_score, type_score, round(sample, 9) AS sample_score FROM cd""",
    "suggest_decisions": f"""WITH RECURSIVE {_SUGGEST}, pr AS (SELECT source AS a, target AS b FROM cd), {S.abbreviation_score_sql('pr')},
        tw AS (SELECT cd.*, k, CASE WHEN k = 1 THEN name_score ELSE greatest(name_score, score) END AS name, {S.bare_sql('source')} = {S.bare_sql('target')} AS exact FROM cd JOIN abb ON a = source AND b = target, range(1, 3) r(k)),
        fu AS (SELECT *, CASE WHEN exact AND type_score >= 0.75 THEN greatest(0.6 * name + 0.25 * type_score + 0.15 * sample, 0.98) ELSE 0.6 * name + 0.25 * type_score + 0.15 * sample END AS full_score FROM tw),
        bs AS (SELECT *, max(full_score) OVER (PARTITION BY k, source) AS best, row_number() OVER (PARTITION BY k, source ORDER BY full_score DESC, target) AS place FROM fu),
        dc AS (SELECT k, source, any_value(best) AS best, arg_min(target, place) AS first, CASE WHEN any_value(best) < 0.72 THEN 'no_match' WHEN count(*) FILTER (full_score >= 0.72 AND best - full_score <= 0.05) > 1 THEN 'ambiguous' ELSE 'match' END AS decision FROM bs GROUP BY k, source)
        SELECT source, decision, round(best, 9) AS best_score, CASE WHEN decision = 'match' THEN first END AS target FROM dc WHERE k = 1 AND decision <> 'no_match' OR k = 2 AND source IN (SELECT source FROM dc WHERE k = 1 AND decision = 'no_match')""",
    "greedy_select": f"""WITH RECURSIVE j AS ({_JACCARD}), r AS (SELECT *, row_number() OVER ({_RANK}) AS k, source_table || '.' || source_column AS s, target_table || '.' || target_column AS g FROM j WHERE score >= 0.3),
        w(k, ss, gs, took) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], []::BIGINT[] UNION ALL
          SELECT rk, CASE WHEN ok THEN list_append(ss, s) ELSE ss END, CASE WHEN ok THEN list_append(gs, g) ELSE gs END, CASE WHEN ok THEN list_append(took, rk) ELSE took END
          FROM (SELECT ss, gs, took, r.k AS rk, r.s, r.g, NOT list_contains(ss, r.s) AND NOT list_contains(gs, r.g) AS ok FROM w JOIN r ON r.k = w.k + 1))
        SELECT {_FIVE} FROM r WHERE list_contains((SELECT took FROM w ORDER BY k DESC LIMIT 1), k)""",
    "profile_columns": f"WITH {_STAR}, {_fields_sql(STAR)} SELECT vals.tab AS \"table\", vals.col AS \"column\", kind AS dtype, sum(n)::BIGINT AS n_values, count(*) AS n_distinct FROM vals JOIN fields USING (t, col) GROUP BY ALL",
    "infer_types": f"""WITH {_STAR} SELECT tab AS "table", col AS "column", CASE WHEN bool_and(lower(trim(v)) IN ('true', 'false')) THEN 'boolean'
        WHEN bool_and(regexp_full_match(v, '[+-]?[0-9]+')) THEN 'integer' WHEN bool_and(regexp_full_match(v, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')) THEN 'float' ELSE 'text' END AS dtype FROM vals GROUP BY tab, col""",
    "sample_even": """WITH r AS (SELECT c_name AS value, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS l FROM customer WHERE c_name <> '')
        SELECT 'c_name' AS "column", value FROM r WHERE l <= 100 OR i IN (SELECT (k * l) // 100 FROM range(100) t(k))""",
    "jaccard_exact": _JACCARD, "tversky_containment": _tversky_sql(1.0, 0.0), "tversky_asym": _tversky_sql(0.25, 0.75),
    "jaccard_lev": _fuzzy_sql(f"(1 - levenshtein(x.v, y.v)::DOUBLE / {_LONGEST})", 0.5),
    "jaccard_damerau": _fuzzy_sql(f"(1 - damerau_levenshtein(x.v, y.v)::DOUBLE / {_LONGEST})", 0.5),
    "jaccard_jaro": _fuzzy_sql("jaro_similarity(x.v, y.v)", 0.6), "jaccard_jw": _fuzzy_sql("jaro_winkler_similarity(x.v, y.v)", 0.65), "jaccard_hamming": _fuzzy_sql(_HAMMING, 0.3),
    "jaccard_cosine": """WITH e AS (SELECT vec_id, label % 2 AS odd, embedding::DOUBLE[] AS v FROM embeddings),
        near AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.odd = 0 AND b.odd = 1 WHERE list_cosine_similarity(a.v, b.v) >= 0.5),
        k AS (SELECT (SELECT count(*) FROM e WHERE odd = 0) AS na, (SELECT count(*) FROM e WHERE odd = 1) AS nb, (SELECT count(DISTINCT x) FROM near) AS ma, (SELECT count(DISTINCT y) FROM near) AS mb)
        SELECT 'even' AS source_table, 'value' AS source_column, 'odd' AS target_table, 'value' AS target_column,
               round(greatest(ma::DOUBLE / (ma + (na - ma) + (nb - mb)), mb::DOUBLE / (mb + (nb - mb) + (na - ma))), 9) AS score FROM k WHERE ma > 0""",
    "work_counts": f"WITH {_STAR}, {_SIZES} SELECT count(*) AS cells, sum(x.m * y.m)::BIGINT AS comparisons FROM sizes x JOIN sizes y ON x.t < y.t",
    "name_trigram": f"""WITH {_STAR}, names AS (SELECT DISTINCT c, t, tab, col FROM vals),
        g AS (SELECT c, substr(lower(col), i, 3) AS g, count(*) AS k FROM names, range(1, 60) r(i) WHERE i <= length(col) - 2 GROUP BY ALL),
        s AS (SELECT c, sum(k) AS k FROM g GROUP BY c), m AS (SELECT a.c AS ca, b.c AS cb, sum(least(a.k, b.k)) AS o FROM g a JOIN g b USING (g) GROUP BY ALL)
        SELECT x.tab AS source_table, x.col AS source_column, y.tab AS target_table, y.col AS target_column, round(coalesce(2 * o, 0)::DOUBLE / (p.k + q.k), 9) AS score
        FROM names x JOIN names y ON x.t < y.t JOIN s p ON p.c = x.c JOIN s q ON q.c = y.c LEFT JOIN m ON ca = x.c AND cb = y.c""",
    "tfidf_idf": f"WITH {_TEXT}, {_TOKENS} SELECT token, df, round(idf, 9) AS idf FROM idf",
    "tfidf_vectors": f"WITH {_TEXT}, {_TOKENS} SELECT v AS value, token, round(weight, 9) AS weight FROM vec",
    "coma_instances": f"""WITH {_TEXT}, {_TOKENS},
        cos AS (SELECT a.v AS x, b.v AS y, least(sum(a.weight * b.weight), 1.0) AS c FROM vec a JOIN vec b USING (token) GROUP BY ALL),
        held AS (SELECT vals.* FROM vals SEMI JOIN filled USING (v)),
        best AS (SELECT l.c AS ca, r.c AS cb, l.t AS ta, r.t AS tb, l.v, any_value(l.n) AS n, max(cos.c) AS m FROM held l JOIN cos ON l.v = x JOIN held r ON r.v = y AND r.t <> l.t GROUP BY ALL),
        s AS (SELECT ca, cb, ta, tb, sum(m * n) AS s FROM best GROUP BY ALL), occ AS (SELECT c, tab, col, sum(n) AS o FROM held GROUP BY ALL)
        SELECT p.tab AS source_table, p.col AS source_column, q.tab AS target_table, q.col AS target_column, round((f.s + g.s) / (p.o + q.o), 9) AS score
        FROM s f JOIN s g ON f.ca = g.cb AND f.cb = g.ca AND f.ta < f.tb JOIN occ p ON p.c = f.ca JOIN occ q ON q.c = f.cb""",
    "dist_ranks": f"""WITH {_STAR}, d AS (SELECT DISTINCT v, CASE WHEN {_NUMBER_SQL} THEN CAST(trim(v) AS DOUBLE) END AS num FROM vals)
        SELECT v AS value, count(*) OVER (ORDER BY num IS NULL, num, CASE WHEN num IS NULL THEN v END RANGE UNBOUNDED PRECEDING) AS rank FROM d""",
    "dist_quantiles": f"""WITH {_STAR}, d AS (SELECT DISTINCT v, CASE WHEN {_NUMBER_SQL} THEN CAST(trim(v) AS DOUBLE) END AS num FROM vals),
        k AS (SELECT v, count(*) OVER (ORDER BY num IS NULL, num, CASE WHEN num IS NULL THEN v END RANGE UNBOUNDED PRECEDING) AS rank FROM d),
        u AS (SELECT c, tab, col, rank, sum(n)::BIGINT AS n FROM vals JOIN k USING (v) GROUP BY ALL),
        r AS (SELECT *, (sum(n) OVER (PARTITION BY c ORDER BY rank))::BIGINT - n AS lo, (sum(n) OVER (PARTITION BY c))::BIGINT AS l FROM u),
        p AS (SELECT c, tab, col, l, i, ((l - 1) * i) // 17 AS at, ((l - 1) * i) // 17 + 1 AS next, ((l - 1) * i) % 17 AS rest FROM (SELECT DISTINCT c, tab, col, l FROM r WHERE l > 1), range(1, 17) q(i)),
        a AS (SELECT p.*, r.rank AS low FROM p ASOF JOIN r ON p.c = r.c AND p.at >= r.lo), b AS (SELECT a.*, r.rank AS high FROM a ASOF JOIN r ON a.c = r.c AND a.next >= r.lo)
        SELECT tab AS "table", col AS "column", i::INT AS i, round((low * (17 - rest) + high * rest)::DOUBLE / 17, 6) AS boundary FROM b
        UNION ALL SELECT tab, col, 1, rank::DOUBLE FROM r WHERE l = 1""",
    "dist_bloom_bits": """WITH s AS (SELECT count(*) AS n FROM nation), k AS (SELECT floor(-n * ln(0.01) / ln(2) ^ 2)::BIGINT AS bits, greatest(1, floor(floor(-n * ln(0.01) / ln(2) ^ 2) / n * ln(2)))::BIGINT AS hashes FROM s)
        SELECT n_name AS value, seed::INT AS seed, (('0x' || substr(sha256(seed || ':' || n_name), 1, 16))::UBIGINT % bits)::BIGINT AS bit FROM nation, k, range(0, 64) r(seed) WHERE seed < hashes""",
    "rank_top_n": f"WITH {_DELIVERED} SELECT {_FIVE} FROM best {_RANK} LIMIT 100",
    "rank_top_percent": f"WITH {_DELIVERED} SELECT {_FIVE} FROM (SELECT *, row_number() OVER ({_RANK}) AS r, count(*) OVER () AS n FROM best) WHERE r <= ceil(2.5 * n / 100)",
    "rank_per_source": f"WITH {_DELIVERED} SELECT {_FIVE} FROM (SELECT *, row_number() OVER (PARTITION BY source_table, source_column {_RANK}) AS r FROM best) WHERE r <= 3",
    "mutual_top": f"WITH {_DELIVERED} SELECT {_FIVE} FROM (SELECT *, row_number() OVER (PARTITION BY source_table, source_column {_RANK}) AS r, row_number() OVER (PARTITION BY target_table, target_column {_RANK}) AS q FROM best) WHERE r <= 2 AND q <= 2",
    "default_cutoff": f"WITH {_DELIVERED}, d AS (SELECT score, row_number() OVER (ORDER BY score DESC) - 1 AS r, count(*) OVER () AS c FROM (SELECT DISTINCT score FROM best)) SELECT score AS cutoff FROM d WHERE r = least(ceil(c / 2), c - 1)",
    "score_filter": f"WITH {_DELIVERED} SELECT {_FIVE} FROM best WHERE score >= 0.9",
    "metrics_prf": f"""WITH j AS ({_JACCARD}), {_TRUTH}, m AS (SELECT * FROM j WHERE score >= 0.9), k AS (SELECT (SELECT count(*) FROM m SEMI JOIN truth USING (source_table, source_column, target_table, target_column)) AS hit, (SELECT count(*) FROM m) AS f, (SELECT count(*) FROM truth) AS g)
        SELECT hit::DOUBLE / f AS "precision", hit::DOUBLE / g AS recall, 2.0 * hit / (f + g) AS f1 FROM k""",
    "metrics_topn_curve": f"""WITH j AS ({_JACCARD}), {_TRUTH}, r AS (SELECT j.*, row_number() OVER ({_RANK}) AS r, count(*) OVER () AS n FROM j),
        h AS (SELECT r, n, EXISTS (SELECT 1 FROM truth t WHERE t.source_table = r.source_table AND t.source_column = r.source_column AND t.target_table = r.target_table AND t.target_column = r.target_column) AS hit FROM r)
        SELECT (p * 10)::INT AS percent, round(count(*) FILTER (hit)::DOUBLE / count(*), 9) AS "precision" FROM h, range(1, 11) q(p) WHERE r <= ceil(p * 10 * n / 100) GROUP BY p""",
    "metrics_recall_at_gold": f"WITH j AS ({_JACCARD}), {_TRUTH}, top AS (SELECT * FROM j {_RANK} LIMIT {len(TRUTH)}) SELECT count(*)::DOUBLE / {len(TRUTH)} AS recall FROM top SEMI JOIN truth USING (source_table, source_column, target_table, target_column)",
    "metrics_mrr": f"""WITH j AS ({_JACCARD}), {_TRUTH}, r AS (SELECT *, row_number() OVER (PARTITION BY source_table, source_column {_RANK}) AS r FROM j),
        f AS (SELECT source_table, source_column, 1.0 / min(r) AS rr FROM r SEMI JOIN truth USING (source_table, source_column, target_table, target_column) GROUP BY ALL)
        SELECT round(avg(coalesce(rr, 0)), 9) AS mrr FROM (SELECT DISTINCT source_table, source_column FROM truth) LEFT JOIN f USING (source_table, source_column)""",
}
