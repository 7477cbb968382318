import json

import pytest
from pyspark.sql import functions as F

from colmatch.functions.types import InvalidConfig, InvalidInput, MatchOptions
from colmatch.operators import cases, matchers, metrics, results
from colmatch.sources import profile


def pairs(df):
    return {(r.source_column, r.target_column): round(r.score, 9) for r in df.collect()}


@pytest.fixture
def tables(spark):
    a = spark.createDataFrame([(i, f"n{i}") for i in range(8)], "id long, name string")
    b = spark.createDataFrame([(i, f"n{i}") for i in range(4, 12)], "key long, label string")
    return {"a": a, "b": b}


def test_batches(spark, tables):
    assert pairs(matchers.match_all(tables, matchers.Jaccard("exact"))) == {("id", "key"): round(4 / 12, 9), ("name", "label"): round(4 / 12, 9)}
    few = matchers.match_tables(tables, matchers.Jaccard("exact"), MatchOptions(4), order=None)
    assert set(pairs(few)) <= {("id", "key"), ("name", "label")}
    with pytest.raises(InvalidInput):
        matchers.match_tables({"a": tables["a"]}, matchers.Coma())
    for m in (matchers.Coma(), matchers.Cupid(), matchers.Flooding(), matchers.Distribution(quantiles=8)):
        assert {"source_table", "score"} <= set(matchers.match_all(tables, m).columns)
    got = matchers.match_schemas(spark, [("x", "text", ["q"])], [("y", "text", ["q"])], matchers.Jaccard("exact"))
    assert [tuple(r) for r in got.collect()] == [("aaa", "x", "bbb", "y", 1.0)]


def test_own_matcher_and_doubled_pairs(tables):
    class Twice(matchers.Matcher):
        def match(self, p, limits=None):
            one = p.pairs().select(F.col("table_a").alias("source_table"), F.col("column_a").alias("source_column"), F.col("table_b").alias("target_table"), F.col("column_b").alias("target_column"), F.lit(0.5).alias("score"))
            return one.unionByName(one)

    with pytest.raises(InvalidInput):
        matchers.match_all(tables, Twice())


def test_provider(spark):
    class _Letters:  # classes of a test module don't reach the workers by name
        def encode(self, values):
            return [[float(len(v)), float(v.count("n")) + 1.0] for v in values]

    class _Short:
        def encode(self, values):
            return [[1.0]] * (len(values) + 1)

    p = profile.from_fields(spark, [("s", [("x", "text", ["nn", "nn", "ab"])]), ("t", [("y", "text", ["nn"])])])
    assert {r.value: r.vector for r in matchers.embed(p, _Letters()).collect()} == {"nn": [2.0, 3.0], "ab": [2.0, 1.0]}
    assert pairs(matchers.match_profile(p, matchers.Jaccard(threshold=0.99, provider=_Letters()))) == {("x", "y"): 0.5}
    with pytest.raises(Exception):
        matchers.embed(p, _Short()).collect()


def test_profile_round_trip(spark, tables):
    p = profile.from_dataframes(tables)
    q = profile.from_json(spark, profile.to_json(p, 100))
    assert q.columns == p.columns
    assert {(r.col_id, r.value) for r in q.counts.collect()} == {(r.col_id, r.value) for r in p.counts.collect()}
    assert profile.from_json(spark, profile.to_json(p)).counts.count() == 0
    with pytest.raises(InvalidInput):
        profile.from_json(spark, '[{"table": "t", "name": "c", "data_type": "blob", "ordinal": 0}]')


CASE = {"name": "c", "source": {"fields": [{"name": "a", "data_type": "text"}, {"name": "b", "data_type": "integer", "samples": ["1"]}, {"name": "d", "data_type": "text"}]},
        "target": {"fields": [{"name": "x", "data_type": "text"}, {"name": "y", "data_type": "text"}]},
        "answers": [{"kind": "match", "source": "a", "target": "x"}, {"kind": "no_match", "source": "b"}, {"kind": "ambiguous", "source": "d", "targets": ["y", "x"]}]}


def test_cases(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(CASE))
    loaded = cases.load_cases(str(tmp_path))
    assert loaded[0].answers[2] == ("d", "ambiguous", ["y", "x"]) and len(loaded[0].fingerprint) == 64
    for bad in ({"extra": 1}, {"name": " "}, {"answers": CASE["answers"][:2]}, {"answers": [{"kind": "match", "source": "a", "target": "zz"}] + CASE["answers"][1:]}, {"source": {"fields": CASE["source"]["fields"] * 2}}):
        with pytest.raises(InvalidInput):
            cases.parse_case(json.dumps({**CASE, **bad}))
    truth = cases.answers(spark, loaded)
    decided = spark.createDataFrame([("c", "a", "match", "y", []), ("c", "d", "ambiguous", None, ["x", "y"])], "case string, source string, decision string, target string, targets array<string>")
    got = {r.category: tuple(r)[1:] for r in cases.gate_counts(decided, truth).collect()}
    assert got == {None: (3, 2, 1, 0), "match": (1, 0, 1, 0), "no_match": (1, 1, 0, 0), "ambiguous": (1, 1, 0, 0)}
    ranked = spark.createDataFrame([("c", "a", "x", 0.9), ("c", "a", "y", 0.9), ("c", "b", "x", 0.5), ("c", "d", "y", 0.4)], "case string, source string, target string, score double")
    r = cases.ranking_counts(ranked, truth).first()
    assert (r.sources, r.matches, r.automatic, r.true_positives, r.top1_correct, r.recall_at5_correct, r.no_match_automatic, r.ambiguous_automatic, r.ambiguous_any_at5, r.ambiguous_all_at5) == (3, 1, 2, 1, 1, 1, 1, 0, 1, 0)


def test_metric_sets(tables):
    m = matchers.match_all(tables, matchers.Jaccard("exact"))
    truth = results.take_top_n(m, 1).select(*results.KEYS)
    assert list(metrics.get_metrics(m, truth, metrics.CORE)) == metrics.CORE and len(metrics.get_metrics(m, truth, metrics.INCREASING_N)) == 10
    with pytest.raises(InvalidConfig):
        metrics.get_metrics(m, truth, ["nothing"])
