"""Operator semantics on small hand-written tables."""

import datetime as dt
import warnings
from dataclasses import dataclass

import pytest

import lumenframe as lf
from lumenframe import Bucket, Clause, ComputedFields, JoinKind, Metric, OrderKey, Query, QueryError, Separator, Sort, WindowFunction, parse, rule
from lumenframe.errors import suggestions
from lumenframe.fluent import EMPTY_GROUPING
from lumenframe.metamodel import constants
from lumenframe.operators.columns import flatten
from lumenframe.operators.joins import joined_names
from lumenframe.testing import Fixture, assert_rows, assert_same, rows_of

C = Clause


@pytest.fixture(scope="module")
def employees(spark):
    rows = [(1, "Alice", "Engineering", 120000, True), (2, "Bob", "Finance", 90000, True), (3, "Cara", "Engineering", 130000, True), (4, "Dan", "Engineering", 110000, False)]
    return spark.createDataFrame(rows, "id int, name string, department string, salary int, active boolean")


@pytest.fixture(scope="module")
def nullable(spark):
    return spark.createDataFrame([(1, None, 100), (2, None, None), (3, "HR", None), (4, "IT", 5)], "id int, department string, salary int")


def ids(df):
    return sorted(r["id"] for r in df.collect())


# -- predicates ------------------------------------------------------------
@pytest.mark.parametrize(
    "field, clause, value, expected",
    [
        ("salary", C.EQUAL, "120000", [1]), ("salary", C.EQUAL, "many", []), ("salary", C.NOT_EQUAL, "many", []), ("salary", C.NOT_SMALLER, 120000, [1, 3]),
        ("salary", C.NOT_BIGGER, 90000, [2]), ("name", C.BIGGER, "A", []), ("name", C.CONTAINS, "a", [3, 4]), ("name", C.MATCHES, "A.*|B.*", [1, 2]),
        ("name", C.MATCHES, "lic", []), ("active", C.EQUAL, "yes", [1, 2, 3]), ("active", C.EQUAL, "0", [4]), ("active", C.EQUAL, "maybe", []), ("active", C.BIGGER, False, []),
        ("name", C.IN, ["Bob", "Dan", None], [2, 4]), ("salary", C.IN, {"a": 90000, "b": "110000"}, [2, 4]), ("salary", C.IN, [], []), ("salary", C.NOT_EQUAL, [], [1, 2, 3, 4]),
        ("salary", C.NOT_EQUAL, [90000, 110000], [1, 3]), ("salary", C.BIGGER, [125000, 115000], [1, 3]), ("salary", C.NOT_SMALLER, [100000, 120000], [1, 3]), ("salary", C.CONTAINS, 1, []),
    ],
)
def test_predicates(employees, field, clause, value, expected):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert ids(Query.of(employees).where(field, clause, value).rows()) == expected


def test_nulls(nullable):
    q = Query.of(nullable)
    assert ids(q.where("department", C.EQUAL, None).rows()) == [1, 2]
    assert ids(q.where("department", C.NOT_EQUAL, None).rows()) == [3, 4]
    assert ids(q.where("department", C.BIGGER, None).rows()) == []
    assert ids(q.where("department", C.NOT_EQUAL, "HR").rows()) == [4]
    assert ids(q.all_of(rule("department", C.NOT_EQUAL, "HR")).rows()) == [1, 2, 4]
    assert ids(parse("where department != 'HR'").rows(nullable)) == [4]
    assert ids(parse("where department != 'HR' and id < 4").rows(nullable)) == [1, 2]
    assert ids(parse("where department = null or salary = null").rows(nullable)) == [1, 2, 3]


def test_flat_rules_and_unknown_fields(employees):
    q = Query.of(employees).where("department", C.EQUAL, "Finance").where("salary", C.BIGGER, 100000).where("id", C.EQUAL, 4, Separator.OR)
    assert ids(q.rows()) == [4]
    with pytest.warns(UserWarning, match="nope"):
        assert ids(Query.of(employees).where("nope", C.EQUAL, 1).rows()) == [1, 2, 3, 4]
    with pytest.raises(QueryError) as e:
        parse("where nope = 1").rows(employees)
    assert e.value.code == "EQ-SQL-VAL-001"


def test_groups_override_flat_rules(employees):
    q = Query.of(employees).where("id", C.EQUAL, 2).all_of(rule("department", C.EQUAL, "Engineering"), rule("active", C.EQUAL, True)).all_of(rule("id", C.EQUAL, 4))
    assert ids(q.rows()) == [1, 3, 4]
    assert ids(q.any_of(rule("id", C.EQUAL, 1), rule("id", C.EQUAL, 4)).rows()) == [1, 4]


def test_operators_split_the_rows(spark):
    import random

    rng = random.Random(7)
    df = spark.createDataFrame([(i, rng.randint(0, 20)) for i in range(200)], "id int, n int")
    for v in (0, 7, 20, 25):
        count = lambda c: Query.of(df).where("n", c, v).rows().count()  # noqa: B023, E731
        assert count(C.EQUAL) + count(C.NOT_EQUAL) == 200
        assert count(C.BIGGER) + count(C.NOT_BIGGER) == 200
        assert count(C.SMALLER) + count(C.NOT_SMALLER) == 200


def test_dates(spark):
    rows = [(1, dt.datetime(2025, 1, 15, 10, 0, 30)), (2, dt.datetime(2025, 1, 20, 12)), (3, None)]
    df = spark.createDataFrame(rows, "id int, at timestamp_ntz")
    q = Query.of(df)
    assert ids(q.where("at", C.EQUAL, "2025-01-15 10:00:30").rows()) == [1]
    assert ids(q.where("at", C.BIGGER, dt.datetime(2025, 1, 16)).rows()) == [2]
    assert ids(q.where("at", C.BIGGER, dt.date(2025, 1, 16)).rows()) == [2]
    assert ids(q.where("at", C.EQUAL, "2025-01", date_format="yyyy-MM").rows()) == [1, 2]
    assert ids(q.where("at", C.SMALLER, "20/01/2025", date_format="dd/MM/yyyy").rows()) == [1]
    assert ids(q.where("at", C.EQUAL, "not a date").rows()) == []


# -- projection, computed --------------------------------------------------
def test_expressions(spark):
    df = spark.createDataFrame([(1, 2.5, 3.5), (2, -2.5, 4.0)], "id int, a double, b double")
    out = parse("select id, round(a) as r, round(b) as s, floor(a) as f, ceil(a) as c, ceiling(a) as g, abs(a) as d, (a + b) * -2 / 4 as e, a -1 as m").rows(df)
    assert_rows(out, [(1, 2.0, 4.0, 2.0, 3.0, 3.0, 2.5, -3.0, 1.5), (2, -2.0, 4.0, -3.0, -2.0, -2.0, 2.5, -0.75, -3.5)])
    for bad in ("select a + as x", "select nofn(a) as x", "select (a as x"):
        with pytest.raises(QueryError):
            parse(bad).rows(df)


def test_computed_fields(spark):
    df = spark.createDataFrame([(1, 5.0), (2, -5.0)], "id int, a double")
    fields = ComputedFields().add("c", "b + 1").add("b", "a / 2", "int").add("lost", "nothing * 2")
    assert_rows(Query.of(df).computed(fields).rows(), [(1, 5.0, 3, 4.0), (2, -5.0, -2, -1.0)], columns=["id", "a", "b", "c"])
    assert_rows(parse("select id, c where c > 0").computed(fields).rows(df), [(1, 4.0)])
    assert [f.name for f in ComputedFields().add("a", "a * 2").applicable(["a"])] == ["a"]
    with pytest.raises(ValueError):
        fields.add("b", "a")


def test_nested_paths_and_exclusion(spark):
    df = spark.sql("select 'Ann' as name, named_struct('city', 'Oslo', 'geo', named_struct('x', 1), 'secret', 's') as address")
    assert flatten(df).columns == ["name", "address.city", "address.geo.x", "address.secret"]
    assert flatten(df, exclude=("secret",)).columns == ["name", "address.city", "address.geo.x"]
    assert_rows(parse("select name, address.city as city where address.geo.x = 1").rows(df), [("Ann", "Oslo")])


# -- distinct, order, paging -----------------------------------------------
def test_distinct_keeps_first_place_and_last_values(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "a", 3), (4, None, 4), (5, None, 5)], "id int, k string, v int").coalesce(1)
    assert ids(Query.of(df).distinct("k").rows()) == [2, 3, 5]
    assert ids(Query.of(df).distinct("k").where("v", C.SMALLER, 3).rows()) == [1, 2]  # the filter runs first
    q = Query.of(df).distinct("k").all_of(rule("v", C.SMALLER, 3))
    assert q.spec.distinct_stage == "before where"
    assert ids(q.rows()) == [2]


def test_distinct_reads_only_what_is_used(spark, tmp_path):
    spark.range(20).selectExpr("id", "id % 3 as k", "id * 2 as v", "'x' as unused").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for q in (Query.of(df).distinct("k").where("v", C.BIGGER, 1).select("id"), Query.of(df).distinct("k").all_of(rule("v * 2", C.BIGGER, 1)).select("id").order("ID")):
        assert "unused" not in q.rows(Sort.ASC)._jdf.queryExecution().executedPlan().toString()
        assert q.rows(Sort.ASC).count() == 3
    assert Query.of(df).distinct("k").rows().columns == ["id", "k", "v", "unused"]
    assert [r["n"] for r in Query.of(df).distinct("k").count("n").rows().collect()] == [3]


def test_distinct_compat_keys(spark):
    df = spark.createDataFrame([(1, "a", ""), (2, "", "a"), (3, "", ""), (4, None, "x")], "id int, p string, q string").coalesce(1)
    assert ids(Query.of(df).distinct("p", "q").compat().rows()) == [2, 4]


def test_order_and_paging(employees):
    q = Query.of(employees).order("SALARY")
    assert [r["id"] for r in q.rows(Sort.DESC).collect()] == [3, 1, 4, 2]
    assert [r["id"] for r in q.limit(2).offset(1).rows(Sort.ASC).collect()] == [4, 1]
    assert Query.of(employees).limit(0).rows().count() == 0
    assert q.rows().count() == 4  # without a direction nothing sorts
    with pytest.raises(ValueError):
        q.limit(-1)


def test_unknown_fluent_fields_are_ignored(employees):
    q = Query.of(employees)
    with pytest.warns(UserWarning, match="nope"):
        assert q.order("nope").select("id", "nope").rows(Sort.ASC).columns == ["id"]
    with pytest.warns(UserWarning, match="nope"):
        assert q.select("nope").rows().columns == employees.columns
    with pytest.warns(UserWarning, match="nope"):
        assert_rows(q.group("nope").group("department").count("n").rows(), [("Engineering", 3), ("Finance", 1)])
    assert ids(q.distinct("nope").rows()) == [1, 2, 3, 4]
    with pytest.raises(QueryError):
        parse("select id order by nope").rows(employees)


def test_places_of_keys(employees):
    q = Query.of(employees).order("id").order("department", at=0)
    assert q.spec.orders == ("department", "id")
    assert [r["id"] for r in q.rows(Sort.DESC).collect()] == [2, 4, 3, 1]
    assert [g.field for g in Query.of(employees).group("a").group("b", at=0).spec.groups] == ["b", "a"]
    assert Query.of(employees).distinct("a").distinct("b", at=0).spec.distinct == ("b", "a")


def test_top_k_plan(employees):
    plan = Query.of(employees).order("salary").limit(2).explain(Sort.DESC)["plan"]
    assert "TakeOrderedAndProject" in plan


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 as k", "cast(id as string) as s").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = parse("select id where k = 3 or k = null").rows(df)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,3)" in plan and "ReadSchema: struct<id:bigint,k:bigint>" in plan
    plan = Query.of(df).where("k", C.NOT_EQUAL, 3).order("id").select("id").rows(Sort.ASC)._jdf.queryExecution().executedPlan().toString()
    assert "Not(EqualTo(k,3))" in plan


# -- aggregates ------------------------------------------------------------
def test_aggregates(nullable):
    out = parse("select department, count(salary) as n, sum(salary) as s, avg(salary) as a, min(salary) as lo group by department").rows(nullable)
    assert_rows(out, [(None, 2, 100, 100.0, 100), ("HR", 1, None, None, None), ("IT", 1, 5, 5.0, 5)])
    assert_rows(parse("select count(*) as n, sum(salary) as s where id > 99").rows(nullable), [(0, None)])
    assert parse("select sum(salary) as s").rows(nullable).dtypes == [("s", "bigint")]
    with pytest.raises(QueryError):
        parse("select max(department) as m").rows(nullable)


def test_compat_grouping(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "id int, k string").coalesce(1)
    assert_rows(Query.of(df).group("k").count("n").compat().rows(), [(None, 2), ("x", 1)])
    assert_rows(Query.of(df).group("k").count("n").rows(), [(None, 1), ("", 1), ("x", 1)])


def test_having_and_hidden_metrics(employees):
    base = "select department as dept, count(*) as n group by dept"
    assert_rows(parse(f"{base} having dept = 'Finance' order by dept").rows(employees), [("Finance", 1)])
    assert_rows(parse(f"{base} having max(salary) > 100000 order by sum(salary) desc").rows(employees), [("Engineering", 3)], columns=["dept", "n"])
    assert_rows(parse(f"{base} having n * 10 > 20").rows(employees), [("Engineering", 3)])
    q = Query.of(employees).group("department").count("n").having("n", C.BIGGER, 1)
    assert_rows(q.rows(), [("Engineering", 3)])
    with pytest.raises(QueryError) as e:
        Query.of(employees).having("n", C.BIGGER, 1).rows()
    assert e.value.code == "EQ-SQL-VAL-005"


def test_grouped_sink(nullable):
    assert set(Query.of(nullable).group("department").groups()) == {"<NULL>,", "HR,", "IT,"}
    assert list(Query.of(nullable).groups()) == [EMPTY_GROUPING]


# -- buckets ---------------------------------------------------------------
def test_buckets(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 12, 30, 23, 30),), (None,)], "at timestamp_ntz")

    def label(*args):
        return rows_of(Query.of(df).time_bucket("at", lf.parse_bucket(*args), "p").count("n").rows())

    assert (("2024-12-30", 1)) in label("day") and (None, 1) in label("day")
    assert ("2025-W01", 1) in label("week")
    assert ("2024-W53", 1) in label("week", None, "sunday") or ("2025-W01", 1) in label("week", None, "sunday")
    assert ("2024-12-31", 1) in label("day", "Europe/Berlin")
    assert ("2024-Q4", 1) in label("QUARTER") and ("2024", 1) in label("year") and ("2024-12", 1) in label("month")
    for bad in (("hour",), ("day", "Nowhere/Town"), ("day", "UTC", "monday"), ("week", "UTC", "someday")):
        with pytest.raises(ValueError):
            lf.parse_bucket(*bad)


def test_week_labels_follow_four_day_weeks(spark):
    start = dt.date(2018, 1, 1)
    days = [start + dt.timedelta(days=i) for i in range(0, 2600, 3)]
    df = spark.createDataFrame([(dt.datetime(d.year, d.month, d.day),) for d in days], "at timestamp_ntz")
    for first in range(7):
        bucket = Bucket("week", "UTC", ("MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY")[first])
        got = {r["p"] for r in Query.of(df).time_bucket("at", bucket, "p").count("n").rows().collect()}
        want = set()
        for d in days:
            monday_like = d - dt.timedelta(days=(d.weekday() - first) % 7)
            pivot = monday_like + dt.timedelta(days=3)
            want.add(f"{pivot.year}-W{(pivot.timetuple().tm_yday - 1) // 7 + 1:02d}")
        assert got == want


# -- joins -----------------------------------------------------------------
def test_collision_names():
    assert joined_names(["id", "name"], ["parentId", "name"]) == {"parentId": "parentId", "name": "child_name"}
    assert joined_names(["id", "name", "child_name"], ["name"]) == {"name": "child_name_1"}
    assert joined_names(["name", "child_name", "child_name_1"], ["name"]) == {"name": "child_name_2"}


def test_joins(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id int, name string")
    c = spark.createDataFrame([(1, "x"), (1, "y"), (9, "z"), (None, "m")], "parentId int, name string")
    q = Query.of(p)
    assert_rows(q.join(c, "id", "parentId").rows(), [(1, "a", 1, "x"), (1, "a", 1, "y")], columns=["id", "name", "parentId", "child_name"])
    left = q.join(c, "id", "parentId", JoinKind.LEFT)
    assert_rows(left.select("name", "child_name").rows(), [("a", "x"), ("a", "y"), ("b", None), ("n", None)])
    assert_rows(q.join(c, "id", "parentId", null_safe=True).select("name", "child_name").rows(), [("a", "x"), ("a", "y"), ("n", "m")])
    right = q.join(c, "id", "parentId", JoinKind.RIGHT).rows()
    assert_rows(right, [(1, "x", 1, "a"), (1, "y", 1, "a"), (9, "z", None, None), (None, "m", None, None)], columns=["parentId", "name", "id", "child_name"])
    empty = c.limit(0)
    assert q.join(empty, "id", "parentId").rows().count() == 0
    with pytest.raises(QueryError):
        q.join(c, "id", "nope").rows()


def test_mixed_key_types_compare_as_text(spark):
    p, c = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([("1", "x"), ("z", "y")], "pid string, v string")
    assert_rows(Query.of(p).join(c, "id", "pid").select("id", "v").rows(), [(1, "x")])


def test_sql_joins(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    c = spark.createDataFrame([(1, "x", 7)], "pid int, name string, gid int")
    g = spark.createDataFrame([(7, "g")], "gid int, title string")
    text = "select p.name as parent, c.name as child, title from p left join c on c.pid = p.id left join g on c.gid = g.gid order by p.id"
    assert_rows(parse(text).rows(p, {"c": c, "g": g}), [("a", "x", "g"), ("b", None, None)], ordered=True)
    with pytest.raises(QueryError) as e:
        parse("select name from p join c on id = pid").rows(p, {"c": c})
    assert e.value.code == "EQ-SQL-VAL-011"
    with pytest.raises(QueryError) as e:
        parse("select * from p join c on id = pid").rows(p)
    assert e.value.code == "EQ-SQL-VAL-003"
    right = parse("select p.name as parent, c.name as child from p right join c on p.id = c.pid").rows(p, {"c": c})
    assert_rows(right, [("a", "x")])
    for bad in ("select * from p join p on a = b", "select * from p join c on c.a = c.b", "select * join c on a = b", "select * where a = 1 join c on a = b"):
        with pytest.raises(QueryError):
            parse(bad)


# -- windows ---------------------------------------------------------------
def test_running_metrics(spark):
    rows = [("A", 1, 10), ("A", 2, None), ("A", 3, 5), ("B", 1, 2), ("B", 2, 3), ("C", 1, None)]
    df = spark.createDataFrame(rows, "department string, seq int, amount int")
    frame = "over (partition by department order by seq rows between unbounded preceding and current row)"
    text = f"select department, seq, sum(amount) {frame} as s, count(amount) {frame} as n, count(*) {frame} as c, avg(amount) {frame} as a, min(amount) {frame} as lo, max(amount) {frame} as hi"
    want = [("A", 1, 10, 1, 1, 10.0, 10, 10), ("A", 2, 10, 1, 2, 10.0, 10, 10), ("A", 3, 15, 2, 3, 7.5, 5, 10), ("B", 1, 2, 1, 1, 2.0, 2, 2), ("B", 2, 5, 2, 2, 2.5, 2, 3), ("C", 1, None, 0, 1, None, None, None)]
    assert_rows(parse(text).rows(df), want)


def test_ranks_and_qualify(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "a", 7), (4, "b", None), (5, "b", 1)], "id int, k string, v int").coalesce(1)
    text = "select id, rank() over (partition by k order by v desc) as r, dense_rank() over (partition by k order by v desc) as d, row_number() over (partition by k order by v desc) as n"
    assert_rows(parse(text).rows(df), [(3, 1, 1, 1), (1, 2, 2, 2), (2, 2, 2, 3), (5, 1, 1, 1), (4, 2, 2, 2)])
    assert ids(parse(f"{text} qualify n <= 1 or r * 2 > 3").rows(df)) == [1, 2, 3, 4, 5]
    assert ids(parse(f"{text} qualify row_number() over (partition by k order by v desc) = 1").rows(df)) == [3, 5]
    q = Query.of(df).window(WindowFunction.ROW_NUMBER, "n", partition=("k",), orders=(OrderKey("v", Sort.DESC),)).qualify("n", C.EQUAL, 1)
    assert ids(q.rows()) == [3, 5]
    with pytest.raises(QueryError):
        parse(f"{text} qualify id = 1").rows(df)


# -- SQL-like surface ------------------------------------------------------
@pytest.mark.parametrize(
    "text, code",
    [
        ("", "EQ-SQL-API-002"), (None, "EQ-SQL-API-001"), ("select a from", "EQ-SQL-PAR-001"), ("select a where b", "EQ-SQL-PAR-001"), ("select a limit -1", "EQ-SQL-PAR-001"),
        ("select a limit 1.5", "EQ-SQL-PAR-001"), ("select 'x", "EQ-SQL-PAR-001"), ("where a = :", "EQ-SQL-PAR-001"), ("where a in (1, 2)", "EQ-SQL-PAR-001"), ("select a, a", "EQ-SQL-VAL-002"),
        ("select a + 1", "EQ-SQL-PAR-001"), ("where a = 1 ;", "EQ-SQL-PAR-001"), ("where a = 1." , "EQ-SQL-PAR-001"), ("select " + ", ".join(f"c{i}" for i in range(101)), "EQ-SQL-PAR-004"),
        ("where " + " and ".join("a = 1" for _ in range(101)), "EQ-SQL-PAR-004"), ("x" * 4001, "EQ-SQL-PAR-002"), ("where " + "(" * 520, "EQ-SQL-PAR-003"), ("order by " + ", ".join(f"c{i}" for i in range(21)), "EQ-SQL-PAR-004"),
        ("select sum(a) over (order by b) as s", "EQ-SQL-PAR-001"), ("select rank() over (order by b range between unbounded preceding and current row) as s", "EQ-SQL-PAR-001"), ("select bucket(a, 'hour') as b", "EQ-SQL-PAR-001"),
    ],
)
def test_parse_errors(text, code):
    with pytest.raises(QueryError) as e:
        parse(text)
    assert e.value.code == code


def test_error_places():
    with pytest.raises(lf.ParseError) as e:
        parse("select a\nwhere b ? 1")
    assert (e.value.line, e.value.column) == (2, 9)
    assert e.value.snippet.endswith("^")
    assert suggestions("salry", ["salary", "name"]) == ["salary"]


@pytest.mark.parametrize(
    "text, code",
    [
        ("select department group by department", "EQ-SQL-VAL-006"), ("select id, count(*) as n group by department", "EQ-SQL-VAL-006"), ("select id + 1 as x, count(*) as n group by id", "EQ-SQL-VAL-007"),
        ("select id having id > 1", "EQ-SQL-VAL-005"), ("select department, count(*) as n group by department having salary > 1", "EQ-SQL-VAL-005"), ("select id order by id asc, salary desc", "EQ-SQL-BIND-001"),
        ("select id where id in (select id, name)", "EQ-SQL-VAL-010"), ("select id where id in (select id from other)", "EQ-SQL-VAL-010"), ("select id where salary + 1 contains 'a'", "EQ-SQL-VAL-009"),
        ("select id where id = :x", "EQ-SQL-PRM-003"), ("select id qualify id = 1", "EQ-SQL-VAL-006"), ("select bucket(name, 'day') as d, count(*) as n group by d", "EQ-SQL-VAL-008"), ("select nme", "EQ-SQL-VAL-001"),
        ("select id where " + " and ".join("(id = 1 or id = 2)" for _ in range(12)), "EQ-SQL-BIND-002"), ("select rank() over (partition by department) as r", "EQ-SQL-VAL-006"),
    ],
)
def test_validation_errors(employees, text, code):
    with pytest.raises(QueryError) as e:
        parse(text).rows(employees)
    assert e.value.code == code


def test_values_and_words(employees):
    assert ids(parse("where name = Alice").rows(employees)) == [1]  # a bare word is a text
    assert ids(parse("where (salary - 10000) * 2 >= 200000 and active = true").rows(employees)) == [1, 3]
    assert ids(parse("where (department = 'Finance' or salary > 125000) and id != 9").rows(employees)) == [2, 3]
    assert ids(parse("where id in (select id where salary > 100000) and active = false").rows(employees)) == [4]
    assert ids(parse("where id in (select id where salary > 125000) or name = 'Bob'").rows(employees)) == [2, 3]


def test_params_and_templates(employees):
    q = parse("select id where salary > :low and department = :dept order by id limit :n")
    assert ids(q.params(low=1, dept=["Engineering", "Finance"], n=2).rows(employees)) == [1, 2]
    for values, code in (({"low": 1}, "EQ-SQL-PRM-001"), ({"low": 1, "dept": "a", "n": 1, "z": 1}, "EQ-SQL-PRM-002"), ({"low": 1, "dept": "a", "n": -1}, "EQ-SQL-PRM-005"), ({" ": 1}, "EQ-SQL-PRM-004")):
        with pytest.raises(QueryError) as e:
            q.params(values)
        assert e.value.code == code
    with pytest.raises(QueryError) as e:
        parse("where salary > :low").strict_types().params(low="1").rows(employees)
    assert e.value.code == "EQ-SQL-PRM-005"
    assert ids(parse("where salary > :low").strict_types().params(low=125000).rows(employees)) == [3]
    assert ids(lf.Template("where id = :id", ("id",)).bind(id=3).rows(employees)) == [3]
    with pytest.raises(QueryError):
        lf.Template("where id = :id", ())


def test_cursor_tokens():
    values = {"a": "x;y,z é", "b": 3, "c": 1 << 40, "d": 1.5, "e": True, "f": dt.datetime(2025, 1, 2, 3, 4, 5), "g": 1 << 70}
    assert dict(lf.Cursor.from_token(lf.Cursor.of(**values).token()).values) == values
    for bad in ("", "###", "djI7YSxTVFIseA", "djE"):
        with pytest.raises(QueryError) as e:
            lf.Cursor.from_token(bad)
        assert e.value.code == "EQ-SQL-CUR-003"


def test_keyset_walk_equals_sort(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(60)], "id int, k int")
    q, walked, cursor = parse("select id, k order by k desc, id desc limit 7"), [], None
    while True:
        page = (q.keyset_after(cursor) if cursor else q).rows(df).collect()
        if not page:
            break
        walked += [r["id"] for r in page]
        cursor = lf.Cursor.at(page[-1], ["k", "id"]).token()
    assert walked == [r["id"] for r in df.orderBy("k", "id", ascending=False).collect()]
    for text, cur, code in (("select id", lf.Cursor.of(id=1), "EQ-SQL-CUR-001"), ("select id order by id", lf.Cursor.of(k=1), "EQ-SQL-CUR-002"), ("select id order by id", lf.Cursor.of(id=None), "EQ-SQL-CUR-004")):
        with pytest.raises(QueryError) as e:
            parse(text).keyset_after(cur)
        assert e.value.code == code


def test_lint_and_explain(employees):
    q = parse("select * where name = 'Bob' limit 3")
    assert [w["code"] for w in q.lint()] == ["LINT-001", "LINT-002", "LINT-003"]
    assert [w["code"] for w in q.suppress("LINT-001").lint()] == ["LINT-002", "LINT-003"]
    out = parse("select department, count(*) as n where salary > 1 group by department order by n desc").explain(employees, counts=True)
    assert out["metrics"] == ["COUNT(*) as n"] and out["sort_direction"] == "DESC" and out["stage_rows"]["aggregate"] == 2
    assert Query.of(employees).where("id", C.EQUAL, 1).explain(counts=True)["stage_rows"]["where"] == 1


def test_fluent_and_text_agree(employees):
    pairs = [
        ("select id, salary where salary >= 110000 and active = true", Query.of(employees).where("salary", C.BIGGER_EQUAL, 110000).where("active", C.EQUAL, True).select("id", "salary")),
        ("select department, sum(salary) as s group by department", Query.of(employees).group("department").metric(Metric.SUM, "salary", "s").select("department", "s")),
    ]
    for text, q in pairs:
        assert_same(parse(text).rows(employees), q.rows())


# -- runtime, sources, sinks -----------------------------------------------
def test_runtime_cache_and_telemetry(employees):
    events = []
    rt = lf.Runtime.test().with_(listeners=(events.append,), cache=lf.ParseCache(entries=1))
    out = rt.parse("select department, count(*) as n where salary > 100000 group by department").rows(employees)
    assert out.collect() and [e.stage for e in events] == ["PARSE", "BIND", "FILTER", "AGGREGATE", "PROJECT"]
    assert {e.step: e.rows() for e in events[1:4]} == {"source": 4, "where": 3, "aggregate": 1}
    rt.parse("select id"), rt.parse("select id"), rt.parse("select name")
    assert rt.cache.stats() == {"size": 1, "hits": 1, "misses": 3, "evictions": 2}
    assert rt.query(employees).rows().count() == 4


def test_records_objects_and_maps(spark):
    @dataclass
    class City:
        name: str
        size: int | None

    @dataclass
    class Person:
        name: str
        city: City
        at: dt.datetime

    people = [Person("Ann", City("Oslo", None), dt.datetime(2025, 1, 1)), None]
    df = lf.from_records(spark, people)
    assert df.columns == ["name", "city.name", "city.size", "at"] and df.count() == 1

    @dataclass
    class Out:
        name: str
        missing: int

    assert Query.of(df).objects(Out) == [Out("Ann", None)]
    assert lf.to_maps(df.select("name"), None) == [{"name": "Ann"}]
    assert "NAME = 'name'" in constants(df, "Fields") and "CITY_NAME = 'city.name'" in constants(df, "Fields")


def test_files_round_trip(spark, employees, tmp_path):
    for fmt in ("parquet", "orc", "json", "csv"):
        path = str(tmp_path / fmt)
        lf.write(employees, path, fmt, **({"header": True} if fmt == "csv" else {}))
        back = lf.read(spark, path, fmt, schema=employees.schema, **({"header": True} if fmt == "csv" else {}))
        assert_same(back, employees)


def test_benchmark_report(spark, tmp_path):
    from lumenframe.sources.readers import read_benchmark_report

    (tmp_path / "r.json").write_text('[{"benchmark": "b", "mode": "avgt", "params": {"size": "10", "kind": "x"}, "primaryMetric": {"score": 1.5, "scoreError": "NaN", "scoreUnit": "ms/op"}}]')
    row = read_benchmark_report(spark, str(tmp_path / "r.json")).first()
    assert (row.benchmark, row.params, row.score, row.unit) == ("b", "kind=x,size=10", 1.5, "ms/op")


def test_bindings(employees):
    b = lf.JoinBindings().add("e", employees)
    with pytest.raises(QueryError) as e:
        b.add("e", employees)
    assert e.value.code == "EQ-SQL-JOIN-001"
    with pytest.raises(QueryError):
        b.add(" ", employees)
    bundle = lf.DatasetBundle(employees, {"e": employees})
    assert parse("select employees.id as id from employees join e on employees.id = e.id").rows(bundle).count() == 4
    assert ids(parse("where id = 1").bind(employees).rows()) == [1]


def test_iterators(employees):
    assert len(list(Query.of(employees).where("salary", C.BIGGER, 100000).limit(2).iterate())) == 2
    assert [r["id"] for r in parse("select id order by id").iterate(employees)] == [1, 2, 3, 4]


def test_regression_fixture(employees):
    f = Fixture(employees).case("one", lambda d: parse("select id where id = 1").rows(d), [(1,)])
    f.run()
    with pytest.raises(AssertionError, match="two"):
        f.case("two", lambda d: parse("select id where id = 1").rows(d), [(2,)]).run()


# -- snapshots -------------------------------------------------------------
def test_snapshot(spark):
    schema = "id int, name string, v double"
    now = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", None)], schema)
    then = spark.createDataFrame([(1, "a", 1.0), (2, "x", 3.0), (4, "d", 4.0)], schema)
    cmp = lf.SnapshotComparison(now, then, "id")
    got = cmp.rows().select("key", "key_text", "change", "changed_field_count", "changed_field_summary")
    assert_rows(got, [(1, "1", "UNCHANGED", 0, ""), (2, "2", "CHANGED", 2, "name,v"), (3, "3", "ADDED", 0, ""), (4, "4", "REMOVED", 0, "")])
    s = cmp.summary()
    assert (s.added, s.removed, s.changed, s.unchanged, s.net_row_delta) == (1, 1, 1, 1, 0)
    with pytest.raises(Exception, match="Duplicate snapshot key '1' in current rows|Duplicate snapshot key"):
        lf.SnapshotComparison(now.union(now), then, "id").summary()
    with pytest.raises(Exception, match="Duplicate snapshot key"):
        lf.SnapshotComparison(now, then.union(then), "id").rows().collect()
    with pytest.raises(ValueError, match="Unknown"):
        lf.SnapshotComparison(now, then, "none").rows()
    with_null = now.union(spark.createDataFrame([(None, "n", 0.0)], schema))
    with pytest.raises(Exception, match="Null snapshot key in current rows"):
        lf.SnapshotComparison(with_null, then, "id").rows().collect()
    assert lf.SnapshotComparison(with_null, with_null, "id", allow_null_keys=True).summary().unchanged == 4


# -- streaming -------------------------------------------------------------
def test_streams(spark, tmp_path):
    from lumenframe.streaming import StreamQuery

    path = str(tmp_path / "in")
    rows = [(dt.datetime(2025, 1, 1, h), "a" if h % 2 else "b", h) for h in range(24)] + [(dt.datetime(2025, 1, 5), "a", 1)]
    spark.createDataFrame(rows, "at timestamp, k string, v int").write.parquet(path)
    stream = spark.readStream.schema("at timestamp, k string, v int").parquet(path)
    q = Query.of(stream).where("v", C.BIGGER, 3)

    def run(df, mode):
        sink = df.writeStream.format("memory").queryName(f"t{mode}").outputMode(mode).option("checkpointLocation", str(tmp_path / f"c{mode}")).start()
        sink.processAllAvailable()
        sink.stop()
        return spark.table(f"t{mode}")

    assert run(StreamQuery(q.select("k")).rows(), "append").count() == 20
    out = run(StreamQuery(q.group("k").count("n"), "at").rows(), "complete")
    assert sorted((r["k"], r["n"]) for r in out.collect()) == [("a", 10), ("b", 10)]
    with pytest.raises(ValueError):
        StreamQuery(q.order("k")).rows()
    with pytest.raises(ValueError):
        StreamQuery(Query.of(spark.range(3))).rows()


# -- bounds and snapshots --------------------------------------------------
def test_sinks_stop_at_their_bound(spark):
    from lumenframe.sources import sinks

    assert len(list(sinks.bounded(spark.range(5), 5))) == 5
    with pytest.raises(ValueError, match="more than 4 rows"):
        list(sinks.bounded(spark.range(5), 4))


def test_result_snapshots(spark, tmp_path):
    from lumenframe.testing import Snapshots

    df = spark.createDataFrame([(2, "b", None), (1, "a", 0.5)], "id int, t string, v double")
    with pytest.raises(AssertionError, match="no snapshot"):
        Snapshots(str(tmp_path / "kept")).check("one", df)
    Snapshots(str(tmp_path / "kept"), update=True).check("one", df)
    Snapshots(str(tmp_path / "kept")).check("one", df.orderBy("id"))
    with pytest.raises(AssertionError, match="differs"):
        Snapshots(str(tmp_path / "kept")).check("one", df.filter("id = 1"))
    with pytest.raises(AssertionError, match="differs"):
        Snapshots(str(tmp_path / "kept")).check("one", df.drop("v"))


def test_parse_cache_is_bounded_by_weight():
    from lumenframe.sql.query import ParseCache

    texts = [f"select a where a > {i}" for i in range(10)]
    cache = ParseCache(weight=3 * len(texts[0]))
    for t in texts:
        cache.parse(t)
    assert cache.stats()["size"] == 3 and cache.held_weight == 3 * len(texts[0]) and cache.stats()["evictions"] == 7
    cache.parse(texts[9])
    assert cache.hits == 1
    small = ParseCache(weight=4)
    small.parse(texts[0])
    assert small.stats()["size"] == 0
    cache.clear()
    assert cache.held_weight == 0


def test_window_over_all_rows_warns(spark):
    q = Query.of(spark.range(5)).window(WindowFunction.ROW_NUMBER, "n", None, (), ("id",)).select("id", "n")
    with pytest.warns(UserWarning, match="one task"):
        assert [r["n"] for r in q.rows().orderBy("id").collect()] == [1, 2, 3, 4, 5]
