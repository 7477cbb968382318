import itertools
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from colmatch.llm import bpe, columns, entities, language, packing, registry, setjoin, terms, topn

DATA = "/root/testdata/sf0.001"

# --- 1: top N ------------------------------------------------------------------------


def best(rows, n):
    pairs = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and s == s:
            pairs[g, i] = max(s, pairs.get((g, i), -math.inf))
    by = defaultdict(list)
    for (g, i), s in pairs.items():
        by[g].append((-s, i.encode(), i))
    return sorted((g, i) for g, v in by.items() for _, _, i in sorted(v)[:n])


@pytest.mark.parametrize("rows", [
    [], [("a", "x", 0.5), ("a", "x", 0.9), ("a", "y", 0.9), ("a", "z", None), ("a", "w", float("nan")), (None, "q", 1.0), ("b", None, 1.0), ("b", "é", 0.5), ("b", "z", 0.5), ("B", "z", 0.1)],
    [("hot", f"i{k % 997}", (k % 31) / 31) for k in range(6000)] + [(f"g{k % 50}", f"i{k}", 0.5) for k in range(300)]])
def test_top_n(spark, rows):
    df = spark.createDataFrame(rows, "g string, i string, s double").withColumn("rank", F.lit("clash")).repartition(5)
    got = topn.top_n_per_group(df, ["g"], ["i"], "s", 3, row_group_bytes=2048)
    assert sorted((r.g, r.i) for r in got.collect()) == best(rows, 3)


def test_row_groups_are_skipped(spark, tmp_path):
    """Of a large group over several files the first row groups are read, of the others all."""
    rows = [("hot", f"i{k:06d}", (k * 7919 % 60_000) / 60_000) for k in range(60_000)] + [(f"g{k % 400}", f"i{k}", 0.5) for k in range(4000)] + [("few", "a", 0.1)]
    df = spark.createDataFrame(rows, "g string, i string, s double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so little data is one file
    topn.cluster_by_group(df, ["g"], ["i"], "s", f"file://{tmp_path}/c", row_group_bytes=32 << 10)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    files = spark.createDataFrame([(str(f"file://{f}"),) for f in (tmp_path / "c").glob("*.parquet")], "uri string").repartition(2)
    index = topn.row_group_index(files, ["g"], "s", 5).collect()
    hot = [r for r in index if r.g0 == "hot"]
    assert len({r.uri for r in index}) > 1 and len(hot) > 10
    assert sum(r.read for r in hot) <= 2 and all(r.read for r in index if r.g0 != "hot")
    assert sum(r.n for r in index if not r.read) > 50_000
    facts = [(0, 10, 0.5, 0.9, ("a",)), (1, 10, 0.1, 0.4, ("a",)), (2, 10, 0.0, 0.3, None), (3, 10, 0.5, 0.5, ("b",))]
    assert [i for _, i, _ in topn.row_groups_to_read(facts, {("a",): 0.5, ("b",): 0.5})] == [0, 3, 2]
    got = topn.top_n_per_group(df, ["g"], ["i"], "s", 5, row_group_bytes=32 << 10)
    assert sorted((r.g, r.i) for r in got.collect()) == best(rows, 5)


# --- 4: terms ---------------------------------------------------------------------------


def test_terms(spark):
    rows = [(1, ["Red red-Apple", None, "the"]), (2, ["the APPLE"]), (3, ["the", "İx"]), (4, None), (5, []), (6, ["", "--", None]), (7, ["red " * 5000]), (8, ["the APPLE"])]
    df = spark.createDataFrame(rows, "id long, samples array<string>").withColumn("term", F.lit("clash"))
    tf = {i: Counter(t for s in (x or []) if s is not None for t in re.findall("[a-z0-9]+", s.lower())) for i, x in rows}
    tf = {i: c for i, c in tf.items() if c}
    dfreq = Counter(t for c in tf.values() for t in c)
    want = {(i, t): round(math.sqrt(n) * math.log(len(tf) / dfreq[t]), 9) for i, c in tf.items() for t, n in c.items()}
    got = terms.term_weights(df, "id", "samples", "tfidf")
    assert {(r.id, r.term): r.weight for r in got.collect()} == pytest.approx(want)
    top = [(i, t) for i in tf for t in sorted((t for t in tf[i] if want[i, t] > 0), key=lambda t: (-want[i, t], t))[:3]]
    assert sorted((r.id, r.term) for r in terms.heaviest_terms(got, "id").collect()) == sorted(top)
    n = sum(sum(c.values()) for c in tf.values())
    total = Counter()
    for c in tf.values():
        total.update(c)
    for r in terms.term_weights(df, "id", "samples", "residual", 6).collect():
        e = sum(tf[r.id].values()) * total[r.term] / n
        free = (1 - sum(tf[r.id].values()) / n) * (1 - total[r.term] / n)
        assert r.weight == pytest.approx((tf[r.id][r.term] - e) / math.sqrt(e) / math.sqrt(free), abs=1e-5)
    assert terms.term_weights(df.limit(0), "id", "samples").count() == 0


# --- 5: entities --------------------------------------------------------------------------


def test_column_facts():
    assert columns.name_tokens("stoumiastork-crrnt-prdct-unt")[0] == ["current", "product", "unit"]
    assert columns.name_tokens("f01 foreign mrch mass")[0] == ["foreign", "merchant", "weight"]
    assert columns.table_keys("stg.patient_flatu") == ["flatu"] and "flatu" in columns.table_keys("PATIFLATU") and columns.table_keys("T793") == [] == columns.table_keys(None)
    assert columns.value_keys("2604107,930") == ["n2604107.93"] == columns.value_keys("02604107.93") and columns.value_keys("302,230,404") == ["n302230404"]
    assert columns.value_keys("12/21/2022") == ["d20221221"] == columns.value_keys("21.12.2022") == columns.value_keys("20221221") == columns.value_keys("2022-12-21 00:00:00")
    assert columns.value_keys("n/a") == [] == columns.value_keys(None) and columns.value_keys("Red  Box") == columns.value_keys("red_box")


def test_entities(spark):
    codes = lambda p, n: [f"{p}-{i:06d}" for i in range(1, n)]
    left = [(1, "order_fumhe", "ORDER_NAME", "text", codes("ABC", 9)), (2, "stg.order_fumhe", "orderName", "text", codes("ABC", 8)), (3, "tax_zulo", "TaxRate", "float", ["1.25", "77.5", "31.125"]),
            (4, "visit_gor", "date", "date", []), (5, None, None, None, None), (6, "x_" + "y" * 50_000, "name" * 9000, "text", ["z" * 100_000])]
    right = [(10, "FUMHE", "purchase_nm", "text", [c.lower() for c in codes("ABC", 7)]), (11, None, "TAX_RT", "decimal", ["31,125", "1,250", "77,5"]), (12, None, "date", "date", []),
             (13, "T12", "rate", "text", ["q"]), (14, None, "TAX_RT", "decimal", ["31,125", "1,250", "77,5"]), (15, None, None, None, None)]
    schema = "id long, table_name string, name string, data_type string, samples array<string>"
    a, b = spark.createDataFrame(left, schema).withColumn("rec", F.lit(1)), spark.createDataFrame(right, schema)
    found = entities.match_columns(a, b).collect()
    assert {(r.left_id, r.right_id) for r in found} == {(1, 10), (2, 10), (3, 11), (3, 14)} and all(0.5 <= r.confidence <= 1 for r in found)
    assert entities.match_columns(a.limit(0), b).count() == 0 == entities.match_columns(a, b.limit(0)).count()


def test_entities_with_frequent_keys_only(spark):
    """A table held by more than 64 columns, named by dictionary words and without samples."""
    schema = "id long, table_name string, name string, data_type string, samples array<string>"
    words = {k: v.split()[0] for k, v in columns.SYNONYMS.items()}
    left = spark.createDataFrame([(i, "big_zulo", k, "text", None) for i, k in enumerate(words)], schema)
    right = spark.createDataFrame([(i, "stg.all_zulo", w, "text", None) for i, w in enumerate(words.values())], schema)
    assert {(r.left_id, r.right_id) for r in entities.match_columns(left, right).collect()} == {(i, i) for i in range(len(words))}


def test_no_candidate_of_positive_evidence_is_missed(spark):
    rng, words = random.Random(5), ["amount", "price", "code", "date", "customer", "first"]
    some = lambda of, n: rng.sample(of, rng.randint(0, n))
    samples = lambda: some(["0", "1", "red", "blue", "7"], 3) + some(["2020-01-01", "2020-01-02", "2020-01-03"], 3) + some(["AB-001", "AB-002", "AB-003"], 3)
    rows = [(i, i % 2, rng.choice([None, "x_zulo", "x_gorm", "x_fumhe"]), " ".join(some(words, 2) + some(["grosk", "plimt"], 1)), "text", samples()) for i in range(220)]
    told = spark.createDataFrame(rows, "rec long, side int, table_name string, name string, data_type string, samples array<string>").mapInPandas(entities._describe, entities._TOLD).persist()
    of = lambda s: told.drop("keys").select(*(F.col(c).alias(s if c == "rec" else f"{c}_{s}") for c in told.columns if c != "keys"))
    want = {(r.a, r.b) for r in of("a").join(of("b"), F.col("a") < F.col("b")).where(entities._log_odds() >= 0).collect()}
    for few, deep, block in ((3, 4, 16), (12, 2, 1024)):
        got = {(r.a, r.b) for r in entities._blocked(told, few, deep, block).collect()}
        assert len(want) > 1000 and want <= got and all(x < y for x, y in got)


def test_a_table_listed_whole_on_both_sides(spark):
    """80 columns of equal names, without samples: their keys are all frequent."""
    schema = "id long, table_name string, name string, data_type string, samples array<string>"
    side = spark.createDataFrame([(i, "big_zulo", f"{a} {b}", "text", None) for i, (a, b) in enumerate(itertools.islice(itertools.product(list(columns.SYNONYMS)[:8], columns.QUALIFIERS[:10]), 80))], schema)
    assert {(r.left_id, r.right_id) for r in entities.match_columns(side, side).collect()} == {(i, i) for i in range(80)}


def test_propagation_is_exact_on_trees(spark):
    theta = {(1, 1): 1.0, (1, 2): 0.5, (2, 2): 2.0, (3, 3): -1.0}
    got = {(r.l, r.r): r.belief for r in entities.propagate(spark.createDataFrame([(*k, v) for k, v in theta.items()], "l long, r long, theta double"), 60, 1e-9).collect()}
    weight, mass = Counter(), 0.0
    for n in range(len(theta) + 1):
        for s in itertools.combinations(theta, n):
            if len({x for x, _ in s}) == len(s) == len({y for _, y in s}):
                w = math.exp(sum(theta[k] for k in s))
                mass += w
                for k in s:
                    weight[k] += w
    assert got == pytest.approx({k: weight[k] / mass for k in theta}, abs=1e-4)


def test_messages_that_have_not_settled_are_told(spark):
    hard = spark.createDataFrame([(i, j, 3.0 + 0.01 * ((i * j) % 3)) for i in range(5) for j in range(5)] + [(9, 9, 1.0)], "l long, r long, theta double")
    assert {(r.l, r.settled) for r in entities.propagate(hard, 2).collect() if r.l in (0, 9)} == {(0, False), (9, True)}
    assert all(r.settled for r in entities.propagate(hard).collect())


# --- 6: sets --------------------------------------------------------------------------------


def similar(rows, num=3, den=5, least=3):
    sets = {i: (t, {s.strip().lower() for s in (x or []) if s is not None} - {""}) for i, t, x in rows}
    sets = {i: v for i, v in sets.items() if len(v[1]) >= max(least, 1)}
    return sorted((a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a][0] != sets[b][0] and den * len(sets[a][1] & sets[b][1]) >= num * len(sets[a][1] | sets[b][1]))


SETS = "id long, tab string, samples array<string>"


def test_set_join(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, f"t{i % 7}", rng.choices(words[: rng.choice([6, 12, 30])], k=rng.randint(0, 9))) for i in range(260)]
    rows += [(1000 + i, "t1", ["A ", "b", "c", None, ""]) for i in range(20)] + [(1100 + i, "t2", ["a", "B", "C"]) for i in range(3)] + [(1200, None, ["a", "b", "c"]), (1201, None, ["a", "b", "c"]), (1202, "t9", None)]
    rows += [(1300 + i, f"u{i}", [f"long{k}" for k in range(i * 30, i * 30 + 600)]) for i in range(6)]
    df = spark.createDataFrame(rows, SETS).withColumn("n", F.lit(1))
    for tuning in ({}, {"rare": 2, "frequent": 3, "short": 5}):
        got = sorted((r.a, r.b) for r in setjoin.similar_rows(df, "id", "tab", "samples", **tuning).collect())
        assert got == similar(rows), tuning
    assert setjoin.similar_rows(df.limit(0), "id", "tab", "samples").count() == 0


@pytest.mark.parametrize("num,den,least,tuning", [
    (1, 2, 1, {"rare": 2, "frequent": 2, "deep": 1, "block": 7}), (3, 5, 2, {"rare": 3, "frequent": 4, "deep": 4, "short": 3, "most": 200}),
    (1, 5, 1, {"rare": 2, "frequent": 3, "deep": 2, "block": 9}), (1, 1, 1, {})])
def test_set_join_by_threshold(spark, num, den, least, tuning):
    """Small sets of few, frequent tokens: one or two in common may be enough."""
    rng = random.Random(num * den)
    rows = [(i, f"t{i % 5}", [f"w{int(rng.random() ** 2 * 9)}" for _ in range(rng.randint(1, 12))]) for i in range(150)]
    got = sorted((r.a, r.b) for r in setjoin.similar_rows(spark.createDataFrame(rows, SETS), "id", "tab", "samples", num, den, least, **tuning).collect())
    assert got == similar(rows, num, den, least)


def test_set_join_on_one_or_two_frequent_tokens(spark):
    star = [(i, f"t{i}", ["hub"] if not i else ["hub", f"w{i}"]) for i in range(80)]
    got = {(r.a, r.b) for r in setjoin.similar_rows(spark.createDataFrame(star, SETS), "id", "tab", "samples", 1, 2, 1).collect()}
    assert got == {(0, i) for i in range(1, 80)}
    star = [(i, f"t{i}", ["hub", "rim"] + ([f"w{i}"] if i else [])) for i in range(400)]
    got = {(r.a, r.b) for r in setjoin.similar_rows(spark.createDataFrame(star, SETS), "id", "tab", "samples", 3, 5, 2).collect()}
    assert got == {(0, i) for i in range(1, 400)}


# --- 7: tokens ---------------------------------------------------------------------------------

TEXTS = ["", None, " ", "Hello world!  It's  42\n\n\tnaïve façade — 東京タワーに行きました。 Привет, мир", "<|endoftext|> x", "a" * 3000, "  x​ \x85y  ", "👩‍⚕️🙂 end ", "ééé\r\n", "word " * 4000, "don't we'll I'M"]


def test_bpe(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = list(enumerate(TEXTS * 2))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash"))
    for size in (0, 5, 1000):
        out = bpe.encode(df, "text", dictionary_words=size)
        assert {r.doc_id: list(r.ids) for r in out.collect()} == {i: enc.encode_ordinary(t or "") for i, t in rows}, size
    assert {r.doc_id: r.decoded for r in bpe.decode(out, "ids").collect()} == {i: t or "" for i, t in rows}
    assert bpe.encode(df.limit(0), "text").count() == 0


def test_bpe_dictionaries_are_not_in_plans(spark):
    """The driver keeps the plan text of every query, so its memory would grow with each one."""
    df = spark.createDataFrame([(i, f"hello w{i % 500} world") for i in range(1_000)], "doc_id long, text string")
    out = bpe.encode(df, "text")
    out.write.format("noop").mode("overwrite").save()
    assert len(out._jdf.queryExecution().toString()) < 100_000


# --- 8: packing -----------------------------------------------------------------------------------


def test_packing(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, 5, 40, 60, 100, 101, 250, 1000, None])) for i in range(500)]
    items = spark.createDataFrame(rows, "id long, size int").withColumn("fill", F.lit(9))
    budgets = spark.createDataFrame([(1, 100), (2, 256), (3, 0)], "budget_id int, capacity int")
    out = packing.pack(items, budgets, shard_items=64, group_bins=16).collect()
    for b, cap in ((1, 100), (2, 256)):
        mine = [r for r in out if r.budget_id == b]
        load, parts = Counter(), defaultdict(list)
        for r in mine:
            load[r.container] += r.size
            parts[r.id].append((r.start, r.size))
        assert max(load.values()) <= cap and all(load[r.container] == r.fill for r in mine)
        for i, s in rows:
            p = sorted(parts[i])
            assert sum(x for _, x in p) == (s or 0) and (len(p) == 1 or (s or 0) > cap)
            assert [a for a, _ in p] == [k * cap for k in range(len(p))]
        rest = [s % cap if s > cap else s for _, s in rows if s]
        whole = len(packing.best_fit_decreasing([x for x in rest if x], cap)) + sum(s // cap for _, s in rows if s and s > cap)
        assert len(load) <= 1.02 * whole + 2  # shards cost next to nothing against one packing of all
    assert not any(r.budget_id == 3 for r in out)
    assert packing.pack(items.limit(0), budgets).count() == 0


def test_local_search():
    assert len(packing.improve([6, 6, 4, 4, 3, 7], [[0], [1], [2], [3], [4], [5]], 10)) == 3
    # only the last of a hundred containers has the two items that make room
    far = [[i] for i in range(100)] + [[100, 101, 102], [103]]
    assert len(packing.improve([9] * 100 + [3, 3, 3, 7], far, 10)) == 102
    assert len(packing.improve([9] * 99 + [1] + [3, 3, 3, 7], far, 10)) == 101
    assert packing.improve([0, 0, 5], [[0], [1], [2]], 10) == [[0, 1, 2]] and packing.improve([0], [[0]], 10) == [[0]] and packing.improve([], [], 10) == []
    rng = random.Random(8)
    for _ in range(20):
        sizes = [rng.randint(1, 99) for _ in range(120)]
        first = packing.best_fit_decreasing(sizes, 100)
        last = packing.improve(sizes, [[i] for i in range(len(sizes))], 100)
        assert sorted(i for b in last for i in b) == list(range(120)) and all(sum(sizes[i] for i in b) <= 100 for b in last)
        assert len(packing.improve(sizes, first, 100)) <= len(first)


# --- 9: languages ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def samples(spark):
    return spark.read.parquet(f"{DATA}/lang_samples.parquet").select("lang", "sample_text")


def test_held_out_sentences(samples):
    rows = [tuple(r) for r in samples.collect()]
    random.Random(1).shuffle(rows)
    right = 0
    for fold in range(4):
        m = language.Model.train([r for i, r in enumerate(rows) if i % 4 != fold])
        right += sum(m.langs[int(m.sentence(language.clean(s)).argmax())] == lang for i, (lang, s) in enumerate(rows) if i % 4 == fold)
    assert right >= 0.98 * len(rows)


def test_confidence_is_a_hit_rate(samples):
    """On sentences that neither the model nor its temperature has seen, cut to a few words."""
    rows = [tuple(r) for r in samples.collect()]
    random.Random(3).shuffle(rows)
    told = []
    for fold in range(2):
        known = [r for i, r in enumerate(rows) if i % 2 != fold]
        m = language.Model.train(known)
        m.calibrate(known)
        for i, (lang, s) in enumerate(rows):
            found = language.words(language.clean(s))
            for n in (1, 2, 3, 6, 100) if i % 2 == fold else ():
                p = m.confidence(m.score(found[:n]), len(found[:n]))
                told.append((float(p.max()), m.langs[int(p.argmax())] == lang))
    for low, high in ((0.0, 0.6), (0.6, 0.9), (0.9, 1.01)):
        part = [x for x in told if low <= x[0] < high]
        assert len(part) > 50 and abs(sum(c for c, _ in part) - sum(h for _, h in part)) / len(part) < 0.1, (low, len(part))


def test_layout():
    prose = "Der Bericht wurde gestern an alle gesendet."
    assert len(language.sentences(f"Menge\tPreis\tName\n3\t4,50\trot und blau\n1\t{prose}")) == 1
    long = "the old ledger was closed and nobody had a look at it " * 8
    assert language.words(f'Das Feld "{long}" ist neu') == ["das", "feld", "ist", "neu"] and len(language.words(f'"{long}"')) > 50


def test_labels():
    assert [language.label_language(x) for x in ("EN", "deu", "pt-BR", "German", " français ", "xx", "", None, "multi")] == ["en", "de", "pt", "de", "fr", None, None, None, None]


def test_stretches(spark, samples):
    by = defaultdict(list)
    for lang, s in samples.collect():
        by[lang].append(s)
    mixed = " ".join(by["de"][:3]) + "\n| a | b |\nhttps://x.invalid/de/und/der\n" + " ".join(by["fr"][:2] + by["de"][3:5])
    rows = [(1, " ".join(by["es"][:4]), "es"), (2, " ".join(by["es"][:4]), "pt"), (3, mixed, "de"), (4, "", "en"), (5, None, None), (6, "12 | 3 ---\n0xfff", "en"), (7, "".join(by["ja"][:2]), None),
            (8, " ".join(by["en"] * 100), "English"), (9, '{"name": "the old ledger"}\n' + by["sv"][0], "sv-FI")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("seg_no", F.lit("clash"))
    out = language.identify(df, samples, "doc_id", "text", "lang").collect()
    got = {d: [(r.lang, r.is_case) for r in sorted((r for r in out if r.doc_id == d), key=lambda r: r.seg_no)] for d in range(1, 10)}
    assert got == {1: [("es", False)], 2: [("es", True)], 3: [("de", True), ("fr", True), ("de", True)], 4: [], 5: [], 6: [], 7: [("ja", True)], 8: [("en", False)], 9: [("sv", False)]}
    assert all(r.confidence > 0.9 for r in out)
    assert language.identify(df.limit(0), samples, "doc_id", "text", "lang").count() == 0


# --- queries -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(name, against_sql):
    against_sql(name)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(name, spark):
    assert registry.queries()[name](spark, DATA).count() > 0
