import pytest

import __spark_entry__ as entry
from colmatch.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(name, against_sql):
    against_sql(name)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(name, spark):
    """All columns of all rows; count() alone would let the planner drop what is to be tested."""
    rows = registry.queries()[name](spark, DATA).collect()
    assert rows and all(any(v is not None for v in r) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_partitions_do_not_matter(spark):
    want = None
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = sorted(map(tuple, registry.queries()["jaccard_exact"](spark, DATA).collect()))
        want = want or got
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_command_line(tmp_path, capsys, spark):
    from colmatch import cli
    from colmatch.functions.types import InvalidConfig, MatchError

    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("id,name\n1,x\n2,y\n")
    b.write_text("key,label\n1,x\n2,z\n")
    out = cli.run(["jaccard_exact", str(a), str(b), "--one-to-one"])
    assert '"source_column": "id"' in out and '"score": 1.0' in out
    for bad in (["coma", str(a), str(b), "--max-jaccard-comparisons", "5"], ["coma", str(a), str(b), "--sample-size", "1", "--sample-size", "2"], ["nothing", "a", "b"], ["coma", "a", "b", "--option", "delta=x"], ["coma", "a", "b", "--option", "none=1"], ["jaccard", "a", "b", "--option", "alpha=1", "--option", "alpha=2"], ["coma", "a", "b", "--threshold", "0.5"], ["coma", "a", "b", "--max-assignment-dimension", "5"]):
        with pytest.raises(InvalidConfig):
            cli.parse(bad)
    assert '"score": 0.5' in cli.run(["jaccard", str(a), str(b), "--option", "distance=exact", "--option", "alpha=1.0", "--option", "beta=0.0"])
    assert '"score"' not in cli.run(["jaccard_exact", str(a), str(b), "--bounded", "--assignment", "rectangular-threshold-aware", "--threshold", "2"])
    with pytest.raises(MatchError):
        cli.run(["jaccard_exact", str(a), str(b), "--max-jaccard-comparisons", "1"])
