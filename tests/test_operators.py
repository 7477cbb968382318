import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colmatch.functions import expressions as X
from colmatch.functions.types import AlgorithmError, InvalidInput, WorkLimits
from colmatch.operators import assign, cluster, coma, cupid, distribution, flooding, jaccard, lexicon, metrics, results, suggest
from colmatch.sources import profile, readers

FIVE = "source_table string, source_column string, target_table string, target_column string, score double"


def grid(spark, cells):
    return spark.createDataFrame([("s", a, "t", b, v) for (a, b), v in cells.items()], FIVE)


def pairs(df):
    return {(r.source_column, r.target_column) for r in df.collect()}


def scores(df):
    return {(r.source_column, r.target_column): round(r.score, 9) for r in df.collect()}


def two(spark, a, b, dtype="text"):
    return profile.from_fields(spark, [("aaa", [("x", dtype, a)]), ("bbb", [("y", dtype, b)])])


# --- sources -----------------------------------------------------------------


def test_profile_of_frames(spark):
    df = spark.createDataFrame([(1, 1e7, "a"), (1, float("nan"), ""), (None, 1e-5, None)], "i int, f double, s string")
    p = profile.from_dataframes([("t", df)])
    got = {(r.col_id, r.value): r.n for r in p.counts.collect()}
    assert got == {(0, "1"): 2, (1, "10000000.0"): 1, (1, "1e-5"): 1, (2, "a"): 1}
    assert [c.dtype for c in p.columns] == ["integer", "float", "text"]
    with pytest.raises(InvalidInput):
        profile.from_dataframes([("t", spark.createDataFrame([([1],)], "a array<int>"))])
    with pytest.raises(InvalidInput):
        profile.from_dataframes([("t", df), ("t", df)])


@pytest.mark.parametrize("values,want", [
    (["1_000"], "text"), (["0x10"], "text"), (["NaN"], "text"), (["1e400"], "text"), ([".5", "5.", "-2E-4"], "float"), (["+00018446744073709551615"], "integer"),
    (["1", "true"], "text"), ([" "], "text"), (["TRUE", " false "], "boolean"), (["18446744073709551616"], "float")])
def test_inference(spark, values, want):
    p = two(spark, values, ["a"])
    assert {r.col_id: r.dtype for r in profile.infer_types(p.counts).collect()}[0] == want


@pytest.mark.parametrize("n,limit,want", [(7, 3, [0, 2, 4]), (5, 3, [0, 1, 3]), (3, 5, [0, 1, 2]), (4, 0, []), (4, None, [0, 1, 2, 3])])
def test_sampling(spark, n, limit, want):
    df = spark.createDataFrame([("c", i) for i in range(n)], "g string, i int")
    assert sorted(r.i for r in profile.sample_evenly(df, "g", "i", limit).collect()) == want


def test_readers(spark, tmp_path):
    good, ragged, nested, flat = (tmp_path / n for n in ("a.csv", "b.csv", "c.json", "d.JSON"))
    good.write_text('id,note,flag\n1,"Hello, world",true\n2,,false\n')
    ragged.write_text("a,b\n1\n")
    nested.write_text('[{"b": 1, "a": {"x": 1}}]')
    flat.write_text('[{"b": 1, "a": null}, {"b": "x"}]')
    df = readers.from_path(spark, str(good))
    assert [tuple(r) for r in df.collect()] == [("1", "Hello, world", "true"), ("2", None, "false")]
    p = profile.with_inferred_types(profile.from_dataframes([("t", df)]))
    assert [c.dtype for c in p.columns] == ["integer", "text", "boolean"]
    with pytest.raises(Exception):
        readers.from_path(spark, str(ragged)).collect()
    with pytest.raises(InvalidInput, match="a is nested"):
        readers.from_path(spark, str(nested))
    assert readers.from_path(spark, str(flat)).columns == ["a", "b"]
    with pytest.raises(InvalidInput):
        readers.from_path(spark, str(good), max_bytes=3)


# --- jaccard -----------------------------------------------------------------


@pytest.mark.parametrize("a,b,d,t,ab,want", [
    (["a", "b", "a"], ["b", "c"], "exact", 0.8, (1, 1), 1 / 3), (["cat"], ["cats"], "levenshtein", 0.75, (1, 1), 1.0), (["abcde"], ["abcdz"], "levenshtein", 0.8, (1, 1), None),
    (["cat"], ["cat", "cats", "catsx"], "levenshtein", 0.59, (1, 1), 1.0), (["x"], ["y"], "levenshtein", 0.0, (1, 1), 1.0), (["x"], ["x", "y", "z"], "exact", 0.8, (1, 1), 1 / 3),
    (["x"], ["x", "y", "z"], "exact", 0.8, (1, 0), 1.0), (["x"], ["x", "y", "z"], "exact", 0.8, (0, 0), 1.0), ([], ["a"], "exact", 0.8, (1, 1), None), ([" Paris"], ["Paris"], "exact", 0.8, (1, 1), None)])
def test_jaccard(spark, a, b, d, t, ab, want):
    got = scores(jaccard.jaccard(two(spark, a, b), d, t, *ab))
    assert got == ({} if want is None else {("x", "y"): round(want, 9)})


def test_fuzzy_against_brute_force(spark):
    from colmatch.functions.names import DISTANCES

    rng = random.Random(5)
    a, b = (["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(12)] for _ in range(2))
    for name, f in DISTANCES.items():
        if name == "exact":
            continue
        cut = X.float_cutoff(0.6)
        m = len({x for x in a if any(f(x, y) >= cut for y in b)})
        k = len({y for y in b if any(f(x, y) >= cut for x in a)})
        n, o = len(set(a)), len(set(b))
        want = max(m / (m + (n - m) + (o - k)), k / (k + (o - k) + (n - m)))
        assert scores(jaccard.jaccard(two(spark, a, b), name, 0.6))["x", "y"] == pytest.approx(want, abs=1e-9), name


def test_jaccard_limits(spark):
    p = two(spark, ["a", "b"], ["b", "c", "d"])
    jaccard.jaccard(p, "exact", limits=WorkLimits(max_jaccard_comparisons=6))
    with pytest.raises(AlgorithmError):
        jaccard.jaccard(p, "exact", limits=WorkLimits(max_jaccard_comparisons=5))


# --- coma, cupid, flooding ------------------------------------------------------


def test_coma_selection(spark):
    df = spark.createDataFrame([(i, j, 0, 1, s) for (i, j), s in {(0, 0): 0.8, (0, 1): 0.8, (1, 0): 0.9, (1, 1): 0.1}.items()], "a int, b int, table_no_a int, table_no_b int, score double")
    assert {(r.a, r.b) for r in coma.select_both(df, 1, 0.0).collect()} == {(0, 1), (1, 0)}
    assert coma.select_both(df, 0, 0.0).count() == 4


def test_coma_instances(spark):
    assert scores(coma.coma(two(spark, ["the and or"], ["was is"]), use_instances=True, use_schema=False)) == {}
    assert scores(coma.coma(two(spark, ["same"], ["same"]), use_instances=True, use_schema=False)) == {}
    p = profile.from_fields(spark, [("s", [("a", "text", ["common rare"])]), ("t", [("b", "text", ["common other"])]), ("u", [("c", "text", ["common", "common", "extra"])])])
    got = scores(coma.coma(p, use_instances=True, use_schema=False, delta=0.0))
    i, r = np.log(5 / 4), np.log(5)
    one = i / np.sqrt(i * i + r * r)  # "other" is a stop word
    assert got["a", "b"] == pytest.approx(one, abs=1e-9)
    assert got["a", "c"] == pytest.approx((one + 2 * one) / 4, abs=1e-9)


def test_cupid():
    lex = lexicon.Lexicon()
    one = cupid.score_pair([("name", "text")], [("name", "text")], lex)
    assert one[0][2]["wsim"] == pytest.approx(0.8 + 0.2 * 0.5 * 0.9 ** 4)
    three = cupid.score_pair([("name", "text")], [("name", "text"), ("beta", "text"), ("gamma", "text")], lex)
    assert three[0][2]["wsim"] == pytest.approx(0.9)
    assert cupid.normalized("HelloWorld, 123 and hello") == {"symbol": [","], "number": ["123"], "stop": ["and"], "content": ["hello", "world", "hello"]}
    assert cupid.normalized("XMLHttpRequest_ID2")["content"] == ["xml", "http", "request", "id2"] and cupid.normalized("") == {k: [] for k in ("symbol", "number", "stop", "content")}
    assert lex.similarity("zxqabc", "zxqabd") == pytest.approx(5 / 6)
    small = lexicon.from_rows([("thing", 0, []), ("vehicle", 1, [0]), ("car", 2, [1]), ("automobile", 2, [1]), ("bike", 3, [1])])
    assert small.similarity("car", "automobile") == 1.0 and small.similarity("car", "bike") == pytest.approx(4 / 6)


def test_flooding(spark):
    p = profile.from_fields(spark, [("s", [("a", "text", [])]), ("s2", [("a", "text", [])])])
    assert scores(flooding.similarity_flooding(p, matcher="levenshtein"))["a", "a"] == pytest.approx(1.0, abs=1e-3)
    g = flooding.schema_graph("t", [("a", "integer"), ("b", "integer")])
    assert sum(label == "SqlType" for label in g.edges.values()) == 2 and len({v for (u, v), x in g.edges.items() if x == "SqlType"}) == 1
    nodes, edges = flooding.product_weights(g, g)
    w = {(a, b): x for a, b, x in edges}
    t, c = 0, g.columns[0][0]
    n = len(g.nodes)
    assert w[t * n + t, c * n + c] == 0.5 and w[c * n + c, t * n + t] == 1.0
    rel = {(r.from_1, r.from_2, r.to_1, r.to_2): r.weight for r in flooding.product_edges(p).collect()}
    a, b = (flooding.schema_graph(*s) for s in flooding.schemas(p))
    want = {(x // len(b.nodes), x % len(b.nodes), y // len(b.nodes), y % len(b.nodes)): v for x, y, v in flooding.product_weights(a, b)[1]}
    assert rel == want


# --- distribution ---------------------------------------------------------------


def test_distribution_parts(spark):
    p = two(spark, ["1", "2", "3", "4", "5"], ["1.0", "2", "3.0", "4", "5"], "integer")
    ranks = {r.value: r["rank"] for r in distribution.value_ranks(p).collect()}
    assert ranks["1"] == ranks["1.0"] == 2 and ranks["5"] == 7
    q = two(spark, list("12345"), ["1"])
    h = distribution.histograms(distribution.column_ranks(q), 4)
    assert list(h[0][1]) == [1.8, 2.6, 3.4, 4.2] and list(h[1][1]) == [1.0]
    assert distribution.cutoff([0.01, 0.02, 0.14, 0.8], 0.15) == 0.02 and distribution.cutoff([0, 0], 0.15) == 0
    assert distribution.bloom_size(3) == (28, 6)
    ref = np.array([1, 1, 1, 1.0])
    assert distribution.emd(ref, np.array([2, 0, 0, 0.0])) == pytest.approx(0.375) and distribution.emd(ref, np.zeros(4)) == float("inf")


@pytest.mark.parametrize("bloom", [False, True])
def test_distribution_matches(spark, bloom):
    p = profile.from_fields(spark, [("z_source", [("id", "integer", [str(i) for i in range(1, 11)]), ("city", "text", list("ABCD")), ("empty", "text", [])]),
                                    ("a_target", [("identifier", "integer", [str(i) for i in range(1, 11)]), ("location", "text", list("ABCD")), ("shifted", "integer", [str(i) for i in range(100, 110)])])])
    got = scores(distribution.distribution_based(p, bloom=bloom))
    assert got["id", "identifier"] == 1.0 and got["city", "location"] == 1.0 and ("id", "shifted") not in got


def test_clusters():
    clique = {(a, b) for a, b in itertools.permutations(range(3), 2)} | {(3, 4), (4, 3)}
    assert cluster.correlation_clusters(5, clique) == [[0, 1, 2], [3, 4]]
    rng = random.Random(1)
    for _ in range(25):
        n = 4
        arcs = {(i, j) for i in range(n) for j in range(n) if i != j and rng.random() < 0.5}
        every = [(i, j) for i in range(n) for j in range(n) if i != j]
        best = min(len(set(s) ^ arcs) for k in range(len(every) + 1) for s in itertools.combinations(every, k)
                   if all(u == w or (u, w) in set(s) for u, v in s for x, w in s if v == x))
        assert cluster.transitive(n, arcs)[0] == best


# --- results ------------------------------------------------------------------------


def test_assignment_goldens(spark):
    m = grid(spark, {("a", "x"): 0.9, ("a", "y"): 0.8, ("b", "x"): 0.85, ("b", "y"): 0.1})
    assert pairs(results.one_to_one(m, "hungarian", 0.0)) == {("a", "y"), ("b", "x")}
    m = grid(spark, {("a", "x"): 0.90, ("a", "y"): 0.80, ("b", "x"): 0.81, ("b", "y"): 0.79})
    assert pairs(results.one_to_one(m, "hungarian", 0.8)) == {("a", "x")}
    assert pairs(results.one_to_one(m, "hungarian_aware", 0.8)) == {("a", "y"), ("b", "x")}
    with pytest.raises(AlgorithmError):
        results.one_to_one(m, "hungarian", 0.8, WorkLimits(max_matrix_cells=3))
    assert pairs(results.one_to_one_greedy(m, 0.5)) == {("a", "x"), ("b", "y")}
    assert pairs(results.one_to_one_mutual_top(m, 1)) == {("a", "x")}


def test_assignment_brute_force():
    rng = random.Random(3)
    for method in ("hungarian_aware", "rectangular_aware", "rectangular", "hungarian"):
        for _ in range(60):
            n, m = rng.randint(1, 4), rng.randint(1, 4)
            cells = [((i,), (j,), rng.choice([0.1, 0.4, 0.5, 0.7, 0.9])) for i in range(n) for j in range(m)]
            got = assign.select(cells, method, 0.5)
            value = {(s, t): x for s, t, x in cells}
            small, large = (n, m) if n <= m else (m, n)
            ways = ([((i,), (j,)) if n <= m else ((j,), (i,)) for i, j in enumerate(p)] for p in itertools.permutations(range(large), small))
            if method.endswith("aware"):
                best = max((sum(value[w] >= 0.5 for w in way), round(sum(value[w] for w in way if value[w] >= 0.5), 9)) for way in ways)
                assert (len(got), round(sum(x for _, _, x in got), 9)) == best
            else:
                assert len({s for s, _, _ in got}) == len(got) == len({t for _, t, _ in got})


@pytest.mark.parametrize("values,want", [([0.8], 0.8), ([0.8, 0.8, 0.8], 0.8), ([1, 0.9, 0.8, 0.7], 0.8), ([1, 0.9, 0.9, 0.8, 0.7, 0.6], 0.7), ([], 0.0)])
def test_default_cutoff(spark, values, want):
    assert results.default_cutoff(grid(spark, {("a", str(i)): float(v) for i, v in enumerate(values)}) if values else spark.createDataFrame([], FIVE)) == want


def test_metrics(spark):
    m = grid(spark, {("a", "wrong"): 0.95, ("b", "yes"): 0.9, ("a", "yes"): 0.8})
    truth = spark.createDataFrame([("a", "yes"), ("b", "yes"), ("c", "absent")], "source_column string, target_column string")
    assert metrics.precision(m, truth) == pytest.approx(2 / 3) and metrics.recall(m, truth) == pytest.approx(2 / 3) and metrics.f1(m, truth) == pytest.approx(2 / 3)
    assert metrics.mean_reciprocal_rank(m, truth) == pytest.approx(0.5)
    assert set(metrics.get_metrics(m, truth, ["Precision", "Recall"])) == {"Precision", "Recall"}


# --- suggestions ----------------------------------------------------------------------


def fields(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos int, name string, data_type string, samples array<string>")


def decide(spark, source, target):
    return [(r.decision, r.target, list(r.targets or [])) for r in suggest.suggest(fields(spark, source), fields(spark, target)).orderBy("s_pos").collect()]


def test_suggestions(spark):
    ids = ["101", "102", "103"]
    assert decide(spark, [("customer_id", "integer", ids)], [("cust_id", "integer", ids), ("email", "text", [])]) == [("match", "cust_id", [])]
    assert decide(spark, [("status", "text", [])], [("payment_status", "text", []), ("order_status", "text", [])]) == [("ambiguous", None, ["order_status", "payment_status"])]
    assert decide(spark, [("email", "text", [])], [("email", "boolean", [])])[0][0] == "no_match"
    assert decide(spark, [("wind_spd", "float", ["1.5", "2.5"])], [("wspd", "float", ["1.5", "2.5"]), ("temperature", "float", ["9.0", "8.0"])]) == [("match", "wspd", [])]
    assert decide(spark, [("a", "text", [])], []) == [("no_match", None, [])]


def test_suggestions_read_whole_columns(spark):
    from colmatch.plans import matching

    data = "/root/testdata/sf0.01"
    values = lambda t, c: {str(r[0]) for r in spark.read.parquet(f"{data}/{t}.parquet").select(c).distinct().collect()}
    score = {(r.source, r.target): r.sample_score for r in matching.suggest_candidates(spark, data).collect()}
    keys = values("customer", "c_custkey")
    assert len(keys) > 100
    for c in ("s_suppkey", "s_nationkey"):
        other = values("supplier", c)
        assert score["c_custkey", c] == pytest.approx(len(keys & other) / max(len(keys), len(other)), abs=1e-9)
    fields = spark.createDataFrame([(0, "a", "text")], "pos int, name string, data_type string")
    some = lambda of: spark.createDataFrame([(0, v) for v in of], "pos int, value string")
    got = suggest.candidates(fields, fields, some([" A", "a", "b", "", None]), some(["B ", "c", "d"])).first()
    assert got.sample_score == pytest.approx(1 / 3)
    assert suggest.candidates(fields, fields, some(["a", "b"]), some([])).first().sample_score is None


def test_text_queries_read_every_text_column(spark):
    from colmatch.functions.names import DISTANCES
    from colmatch.plans import matching

    data, near = "/root/testdata/sf0.001", DISTANCES["levenshtein"]
    sets = [(no, t, c, {r[0] for r in spark.read.parquet(f"{data}/{t}.parquet").select(c).distinct().collect() if r[0]})
            for no, (t, cols) in enumerate(matching.TEXT.items()) for c in cols.split()]
    hit = lambda x, y: sum(any(near(v, w) >= 0.5 for w in y) for v in x)
    want = {}
    for no, t, c, x in sets:
        for other, u, d, y in sets:
            m, k = (hit(x, y), hit(y, x)) if no < other else (0, 0)
            if m:
                want[t, c, u, d] = pytest.approx(max(m / (len(x) + len(y) - k), k / (len(x) + len(y) - m)), abs=1e-9)
    got = {tuple(r)[:4]: r.score for r in matching.QUERIES["jaccard_lev"](spark, data).collect()}
    assert got == want and ("customer", "c_name", "supplier", "s_name") in got
    held = {r.value for r in matching.QUERIES["tfidf_vectors"](spark, data).collect()}
    assert {v for _, _, c, x in sets for v in x if c in ("c_name", "s_name", "p_brand")} <= held


# --- expressions, streaming ------------------------------------------------------------


def test_expressions(spark):
    df = spark.createDataFrame([("aaaa", "aaa"), ("", ""), ("ab", "")], "a string, b string")
    assert [round(r[0], 9) for r in df.select(X.trigram_similarity(F.col("a"), F.col("b"))).collect()] == [0.666666667, 1.0, 0.0]
    t = spark.createDataFrame([("XMLHTTPRequest42_id_ID",)], "n string").select(X.name_tokens(F.col("n"))).first()[0]
    assert t == ["xmlhttp", "request", "42", "id"]
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(X.unit_vector(F.col("v"))).collect()
    assert v[0][0] == pytest.approx([0.6, 0.8]) and v[1][0] is None


def test_stream(spark, tmp_path):
    from colmatch.streaming import incremental

    data = tmp_path / "in"
    spark.createDataFrame([("a",), ("a",), ("b",)], "s string").write.parquet(str(data))
    cols = (profile.ColumnInfo(0, 0, "t", "s", 0, "text"),)
    stream = spark.readStream.schema(T.StructType([T.StructField("s", T.StringType())])).parquet(str(data))
    incremental.follow(stream, cols, str(tmp_path / "out"), str(tmp_path / "cp")).processAllAvailable()
    got = {r.value: r.n for r in incremental.read(spark, str(tmp_path / "out"), cols).counts.collect()}
    assert got == {"a": 2, "b": 1}
