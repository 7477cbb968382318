import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colmatch.operators import drift, nested
from colmatch.operators.tree_edit import Edit, Node, assign, edit_script, from_struct
from colmatch.plans import prepared

# --- nested records ------------------------------------------------------------


def found(spark, tmp_path, payloads, extra=""):
    rows = [(i, p) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "message_id long, payload string")
    if extra:
        df = df.withColumn(extra, F.lit("clash"))
    df.write.parquet(str(tmp_path / "raw_messages.parquet"))
    return sorted(map(tuple, prepared.p2_found(spark, str(tmp_path)).collect()))


def event(parties=None, doc=None, more=None):
    e = {"eventRouting": {"originatingParties": parties}, "shipmentDetails": {"documentReference": doc, "additionalDocumentReferences": more}}
    return {k: {a: b for a, b in v.items() if b is not None} for k, v in e.items()}


def test_messages(spark, tmp_path):
    one = event([{"partyCode": "A"}, None, {}, "x", {"partyCode": 12}], {"type": "D"}, [[], {"type": None}])
    long = "x" * 200_000
    payloads = [
        json.dumps({"events": [None, one]}),  # 0
        json.dumps(json.dumps({"events": one})),  # 1: wrapped, object in place of an array
        json.dumps([event(doc=[{"type": "T"}])]),  # 2: top-level array
        json.dumps(event(parties={"partyCode": True})),  # 3: the object itself
        json.dumps({"events": None}), json.dumps({"events": "no"}), "", "  ", None, '{"events": [', '{"events": []} x', "NaN", "12", '"12"',  # 4-13: nothing
        '{"events": {"eventRouting": {"originatingParties": {"partyCode": 1.50}}, "partyCode": "elsewhere"}}',  # 14: digits as written
        json.dumps({"events": [event([{"partyCode": long}])]}),  # 15
        json.dumps({"events": [event([{"partyCode": "A"}])]}), json.dumps({"events": [event([{"partyCode": "A"}])]}),  # 16, 17: sent again
    ]
    got = found(spark, tmp_path, payloads, "event")
    level = lambda i, p: [(i, p, "additional_document", 1, ""), (i, p, "document", 0, "D"), (i, p, "party", 0, "A"), (i, p, "party", 2, ""), (i, p, "party", 4, "12")]
    want = level(0, 1) + level(1, 0) + [(2, 0, "document", 0, "T"), (3, 0, "party", 0, "true"), (14, 0, "party", 0, "1.50"), (15, 0, "party", 0, long), (16, 0, "party", 0, "A"), (17, 0, "party", 0, "A")]
    assert got == sorted(want)


def test_no_messages(spark, tmp_path):
    assert found(spark, tmp_path, []) == []


def test_merged_schema_and_child_tables(spark):
    df = spark.createDataFrame([(1, '{"a": [{"b": 1, "c": [{"d": "x"}, {"d": "y"}]}, null], "ordinal": 5}'), (2, '{"a": {"b": "t"}}'), (3, "broken"), (4, None)], "id long, j string")
    kinds = {(r.path, r.kind): r.n for r in nested.infer_schema(df, "j").collect()}
    assert kinds["$.a", "array"] == 1 and kinds["$.a", "object"] == 1 and kinds["$.a[].c[].d", "string"] == 2
    t = nested.child_tables(df, "id", "j")
    assert set(t) == {"$", "$.a[]", "$.a[].c[]"}
    assert [(r.id, r.ordinal_) for r in t["$"].orderBy("id").collect()] == [(1, "5"), (2, None)]
    assert [(r.id, r.ordinal, r.b) for r in t["$.a[]"].orderBy("id", "ordinal").collect()] == [(1, 0, "1"), (2, 0, "t")]
    linked = t["$.a[].c[]"].alias("c").join(t["$.a[]"].alias("p"), F.col("c.parent_key") == F.col("p.row_key"))
    assert sorted((r[0], r[1]) for r in linked.select("c.d", "p.b").collect()) == [("x", "1"), ("y", "1")]
    with pytest.raises(ValueError):
        nested.child_tables(df, "id", "j", max_paths=2)


def test_child_tables_of_records(spark):
    """Records at a key, in a top-level array or alone; only the arrays asked for are levels."""
    rows = [(1, '{"ev":[{"a":{"p":[{"c":"x"},null,{"c":1.50},{}]}},null,{"a":{"p":{"c":null}}}]}'), (2, '[{"a":[{"p":[{"c":"no"}]}]}, 5]'), (3, '{"a":{"p":["s",{"c":[1,2]}]}}'), (4, None), (5, "{"), (6, '"{\\"ev\\":{\\"a\\":{\\"p\\":[{\\"c\\":\\"y\\"}]}}}"'), (7, '{"ev":3}')]
    df = spark.createDataFrame(rows, "id long, j string").withColumn("ordinal", F.lit("clash"))
    t = nested.child_tables(df, "id", "j", records_key="ev", only=["$", "$[].a.p", "$[].z"])
    assert set(t) == {"$", "$[]", "$[].a.p[]", "$[].z[]"} and t["$[].z[]"].count() == 0
    assert sorted((r.id, r.ordinal, r.is_object) for r in t["$[]"].collect()) == [(1, 0, True), (1, 2, True), (2, 0, True), (2, 1, False), (3, 0, True), (6, 0, True)]
    got = sorted((r.id, list(r.places), r.is_object, r.c, r.parent_key) for r in t["$[].a.p[]"].collect())
    assert [x[:3] for x in got] == [(1, [0, 0], True), (1, [0, 2], True), (1, [0, 3], True), (1, [2, 0], True), (3, [0, 0], False), (3, [0, 1], True), (6, [0, 0], True)]
    assert [x[3] for x in got] == ["x", "1.50", None, None, None, '["1","2"]', "y"] and {x[4] for x in got} <= {r.row_key for r in t["$[]"].collect()}


def test_every_array_level_has_a_table(spark, tmp_path):
    """Arrays that p2_found doesn't read, some only below an object in place of an array or below odd keys, and all their scalars."""
    one = event([{"partyCode": "A", "PartyCode": "no", "phones": [{"no": 1}, "x", None]}, {"partyCode": {"a": "b"}}], {"type": "D"})
    one["equipmentDetails"] = {"seals": [{"number": "S1"}, {"number": "S2"}], "it's": {"a.b": [{"": "q", " z": "r"}]}}
    payloads = [
        json.dumps({"events": [one]}),
        json.dumps({"events": [{"seals": {"by": ["k"]}}, {"seals": [{"n": True}]}]}),  # an array below an object in place of an array only
        json.dumps({"events": [{"eventRouting": [{"originatingParties": [{"partyCode": "not of the event"}]}]}]}),
        json.dumps({"events": [[{"deep": "d"}]]}),
    ]
    assert found(spark, tmp_path, payloads) == [(0, 0, "document", 0, "D"), (0, 0, "party", 0, "A"), (0, 0, "party", 1, '{"a":"b"}')]
    rows = prepared.p2_levels(spark, str(tmp_path)).collect()
    got = {(r.level, r.row_key): json.loads(r.fields) for r in rows}
    assert len(got) == len(rows) and {r.parent_key for r in rows} <= {r.row_key for r in rows} | {str(i) for i in range(4)}
    by, party = "$[].seals[].by[]", "$[].eventRouting.originatingParties[]"
    want = {
        ("$[]", "0/$[]:0"): {}, ("$[]", "1/$[]:0"): {}, ("$[]", "1/$[]:1"): {}, ("$[]", "2/$[]:0"): {}, ("$[]", "3/$[]:0"): {},
        (party, f"0/$[]:0/{party}:0"): {"PartyCode": "no", "partyCode_": "A"}, (party, f"0/$[]:0/{party}:1"): {"partyCode_": '{"a":"b"}', "partyCode_a": "b"},
        ("$[].shipmentDetails.documentReference[]", "0/$[]:0/$[].shipmentDetails.documentReference[]:0"): {"type": "D"},
        (f"{party}.phones[]", f"0/$[]:0/{party}:0/{party}.phones[]:0"): {"no": "1"}, (f"{party}.phones[]", f"0/$[]:0/{party}:0/{party}.phones[]:1"): {"value": "x"},
        **{("$[].equipmentDetails.seals[]", f"0/$[]:0/$[].equipmentDetails.seals[]:{i}"): {"number": f"S{i + 1}"} for i in (0, 1)},
        ("$[].equipmentDetails.it's.a%2Eb[]", "0/$[]:0/$[].equipmentDetails.it's.a%2Eb[]:0"): {"value": "q", " z": "r"},
        ("$[].seals[]", "1/$[]:0/$[].seals[]:0"): {}, ("$[].seals[]", "1/$[]:1/$[].seals[]:0"): {"n": "true"}, (by, f"1/$[]:0/$[].seals[]:0/{by}:0"): {"value": "k"},
        ("$[].eventRouting[]", "2/$[]:0/$[].eventRouting[]:0"): {}, ("$[].eventRouting[].originatingParties[]", "2/$[]:0/$[].eventRouting[]:0/$[].eventRouting[].originatingParties[]:0"): {"partyCode": "not of the event"},
        ("$[][]", "3/$[]:0/$[][]:0"): {"deep": "d"},
    }
    assert got == want


def test_levels_of_all_messages(spark):
    """Every scalar that a plain walk over the messages meets below an event is a field of some row."""
    from collections import Counter

    import pyarrow.parquet as pq

    want: Counter = Counter()
    for i, t in zip(*pq.read_table("/root/testdata/sf0.001/raw_messages.parquet", columns=["message_id", "payload"]).to_pydict().values()):
        try:
            todo = nested._records(nested.decode_strict(t), "events")
        except ValueError:
            continue
        while todo:
            v = todo.pop()
            if isinstance(v, (dict, list)):
                todo += v.values() if isinstance(v, dict) else v
            elif v is not None:
                want[i, str(v).lower() if isinstance(v, bool) else str(v)] += 1
    got: Counter = Counter()
    for r in prepared.p2_levels(spark, "/root/testdata/sf0.001").collect():
        got.update((r.message_id, v) for v in json.loads(r.fields).values() if v[:1] not in ("{", "["))
    assert got == want and len(want) > 1_000


# --- drifting schemas -------------------------------------------------------------

FILES = "file_id long, site string, extract_no int, arrived_at timestamp, declared_fields array<struct<name:string,data_type:string>>"


def changes(spark, files, rows):
    f = spark.createDataFrame([(i, s, n, None, None if h is None else [tuple(x.split(":")) for x in h]) for i, s, n, h in files], FILES)
    r = spark.createDataFrame([(i, k, c) for i, cells in rows.items() for k, c in enumerate(cells)], "file_id long, row_no int, cells array<string>")
    return f, r


def test_changes(spark):
    base = [[str(100 + i), f"p{i}", f"2023-01-{i + 1:02d}", str(i * 7)] for i in range(8)]
    files = [(1, "S", 1, ["visit_id:int", "Who :text", "start:date", "cost:integer"]), (2, "S", 3, ["who:varchar(20)", "begin:timestamp", "VISIT_ID:bigint", "extra:text"]),
             (3, "S", 3, ["other:text"]), (4, "S", 4, ["who:text", "visit_no:text", "begin:timestamp", "extra:text"]), (5, "T", 1, ["a:int"]), (6, "U", 1, None), (7, None, 1, ["a:int"])]
    rows = {1: base, 2: [[b[1], b[2] + " 00:00:00", b[0] + ".0", None] for b in base[2:]] + [["z", None, None, "q"]], 4: [[b[1], b[0], b[2] + " 00:00:00", None] for b in base[3:]] * 2, 5: [["1"]]}
    f, r = changes(spark, files, rows)
    got = sorted(map(tuple, drift.header_changes(f.withColumn("pos", F.lit(1)), r).collect()))
    assert got == sorted([(2, "renamed", "start", "begin"), (2, "retyped", "start", "begin"), (2, "added", "", "extra"), (2, "removed", "cost", ""),
                          (4, "renamed", "visit_id", "visit_no"), (4, "retyped", "visit_id", "visit_no")])
    wide = {(x.file_id, x.row_no): x for x in drift.unify(f.where("declared_fields is not null and site is not null"), r).collect()}
    assert wide[1, 0]["visit_no"] == "100" and wide[2, 0]["visit_no"] == "102" and wide[1, 3]["begin"] == "2023-01-04" and wide[2, 1]["cost"] is None


def test_no_files(spark):
    f, r = changes(spark, [], {})
    assert drift.header_changes(f, r).count() == 0


def test_plain_values(spark):
    df = spark.createDataFrame([("00012.50", "decimal"), ("12.5", "float"), ("1.25e1", "float"), (" YES ", "boolean"), ("2023-01-02 00:00:00", "timestamp"), ("-0.0", "float"), ("Ä x", "text")], "v string, t string")
    assert [r[0] for r in df.select(drift.plain_value(F.col("v"), F.col("t"))).collect()] == ["12.5", "12.5", "12.5", "true", "2023-01-02", "-0", "ä x"]


def test_edit_scripts():
    a = Node("", "struct", (Node("id", "int"), Node("addr", "struct", (Node("zip", "text"), Node("city", "text"))), Node("old", "date")))
    b = Node("", "struct", (Node("addr", "struct", (Node("zip", "int"),)), Node("id", "int"), Node("city", "text"), Node("new", "date")))
    assert set(edit_script(a, b)[1]) == {Edit("retyped", "addr.zip", "addr.zip"), Edit("moved", "addr.city", "city"), Edit("renamed", "old", "new")}
    assert edit_script(a, a) == (0.0, [])
    t = T.StructType([T.StructField("x", T.ArrayType(T.StructType([T.StructField("y", T.LongType())])))])
    assert from_struct(t).children[0].children[0].children[0].name == "y"
    assert assign([[4, 1, 3], [2, 0, 5]]) == [1, 0]


def test_moves_are_part_of_the_minimum():
    from colmatch.operators.tree_edit import Node, edit_script

    leaf = lambda n, t="int": Node(n, t)
    before = Node("", "struct", (Node("a", "struct", (leaf("x"), leaf("y", "text"))), Node("b", "struct", (leaf("z"),))))
    after = Node("", "struct", (Node("a", "struct", (leaf("y", "text"),)), Node("b", "struct", (leaf("z"), leaf("x", "long")))))
    cost, script = edit_script(before, after)
    assert cost == 1.1 and {(e.kind, e.before, e.after) for e in script} == {("moved", "a.x", "b.x"), ("retyped", "a.x", "b.x")}
    # a rename in place costs less than the move of a like-named field and an addition
    after = Node("", "struct", (Node("a", "struct", (leaf("w"), leaf("y", "text"))), Node("b", "struct", (leaf("z"),))))
    assert edit_script(before, after)[0] == 1.5
    assert edit_script(before, before) == (0.0, [])


def test_one_telling_field_aligns(spark):
    """Narrow headers: the key alone keeps its name, everything else is renamed."""
    h = lambda *names: [(n, "text") for n in names]
    files = spark.createDataFrame([(1, "s", 1, h("k", "a")), (2, "s", 2, h("k", "b"))], "file_id long, site string, extract_no int, declared_fields array<struct<name string, data_type string>>")
    rows = spark.createDataFrame([(f, i, [f"id{i}", f"v{i % 4}"]) for f in (1, 2) for i in range(12)], "file_id long, row_no int, cells array<string>")
    assert [tuple(r) for r in drift.header_changes(files, rows).collect()] == [(2, "renamed", "a", "b")]


def test_unified_columns_have_types(spark):
    assert drift.common_type({"integer", "decimal"}) == "decimal" and drift.common_type({"date", "timestamp"}) == "timestamp" and drift.common_type({"text", "date"}) == "text" == drift.common_type({"odd"})
    files = spark.createDataFrame([(1, "s", 1, [("k", "int"), ("v", "numeric"), ("d", "date")]), (2, "s", 2, [("k", "bigint"), ("v", "int"), ("d", "datetime")])], "file_id long, site string, extract_no int, declared_fields array<struct<name string, data_type string>>")
    rows = spark.createDataFrame([(1, 0, ["1", "2.50", "2020-01-02"]), (1, 1, ["x", None, ""]), (2, 0, ["3", "4", "2020-01-02 03:04:05"])], "file_id long, row_no int, cells array<string>")
    t = drift.unify(files, rows, typed=True)
    assert [str(f.dataType.simpleString()) for f in t.schema.fields] == ["bigint", "int", "timestamp", "bigint", "decimal(38,10)", "map<string,string>"]
    got = {(r.file_id, r.row_no): (r.k, None if r.v is None else float(r.v), r.d is not None, r.unconverted) for r in t.collect()}
    assert got == {(1, 0): (1, 2.5, True, {}), (1, 1): (None, None, False, {"k": "x"}), (2, 0): (3, 4.0, True, {})}
