"""Every registered query with an SQL statement agrees with DuckDB on small tables."""

from pathlib import Path

import duckdb
import pytest

from lumenframe.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    cur = duck.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted(repr(tuple(dict(zip(columns, r))[c] for c in order)) for r in cur.fetchall())
    assert sorted(repr(tuple(r[c] for c in order)) for r in df.collect()) == want


def test_entry(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.count() > 0 and out.columns == ["l_returnflag", "l_linestatus", "sum_qty", "sum_price", "avg_disc", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.oracle_sql())


def test_readme_example(spark):
    text = (Path(__file__).parent.parent / "README.md").read_text()
    code = text.split("```python\n")[1].split("```")[0]
    names = {n: spark.read.parquet(str(DATA / f"{n}.parquet")) for n in ("orders", "customer", "nation")}
    exec(code.replace(".show()", ".collect()"), names)  # noqa: S102
    assert [r["o_orderstatus"] for r in names["q"].rows(names["Sort"].DESC).collect()]
