"""Tables: row-form and cell-form operators on small frames, and every contract query against DuckDB."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.errors import BY_NAME
from quillon.lang.compile import Compiler
from quillon.operators.collection import Coll
from quillon.operators.position import with_position
from quillon.operators.relations import inverse, search
from quillon.plans.queries import QUERIES, SQL
from quillon.runtime.engine import Engine
from quillon.streaming import rooms

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b)
    for c in cols:
        same = (a[c].values == b[c].values) | (pd.isna(a[c]) & pd.isna(b[c])).values
        assert same.all(), c


@pytest.fixture
def people(spark):
    rows = [(1, "Iris", 6, None), (2, "Anne", 31, 1), (3, "cato", 5, 1), (4, "Anne", 31, 9)]
    me = Coll(spark.createDataFrame(rows, "id long, name string, age int, boss long"), ["id"], "id")
    return Coll(me.rows, ["id"], "id", {"chief": ("boss", me)})


def test_rows(people):
    assert people.filter("|p| p.age > 5").map("|p| p.name").list() == ["Iris", "Anne", "Anne"]
    assert people.map("|p| p.chief.name").list() == [None, "Iris", "Iris", None]
    assert people.sort("|p| p.name.lower()").map("|p| p.id").list() == [2, 4, 3, 1]
    assert people.sort("|p| p.age", True).slice(0, 2).map("|p| p.id").list() == [2, 4]
    assert people.map("|p| p.name").unique().list() == ["Iris", "Anne", "cato"]
    assert people.slice(None, None, -2).map("|p| p.id").list() == [4, 2]
    assert people.slice(-3, -1).map("|p| p.id").list() == [2, 3]
    assert people.reverse().map("|p, i| [p.id, i].sum()").list() == [4, 4, 4, 4]
    assert people.find("|p| p.age == 31")["id"] == 2 and people.find("|p| p.age > 99", "none") == "none"
    assert people.find_index("|p| p.age < 6") == 2 and people.find_index("|p| p.age > 99") is None
    assert people.first()["id"] == 1 and people.last()["id"] == 4
    assert people.some("|p| p.age > 30") and not people.every("|p| p.age > 30")
    assert people.sum("|p| p.age") == 73 and people.count(people.fn("|p| p.age == 31")) == 2 and people.len() == 4
    assert people.reduce("|a, p| a + p.age", 1) == 74
    assert people.map("|p| p.age").reduce("|a, x| a * 2 + x", 0) == ((6 * 2 + 31) * 2 + 5) * 2 + 31
    assert people.map("|p| p.name").join("+") == "Iris+Anne+cato+Anne"
    left, gone = people.splice(1, 2)
    assert [left.map("|p| p.id").list(), gone.map("|p| p.id").list()] == [[1, 4], [2, 3]]
    assert people.map("|p| p.name").extend_unique(people.map("|p| p.name.lower()")).list()[-2:] == ["iris", "anne"]
    assert people.wrap({"name": "str", "chief": {"name": "str"}}).list()[1] == {"name": "Anne", "chief": {"name": "Iris"}}


def test_empty_and_errors(people, spark):
    none = people.filter("|p| p.age > 99")
    assert none.sum("|p| p.age") == 0 and none.every("|p| false") and not none.some("|p| true") and none.list() == []
    for bad in (lambda: none.first(), lambda: none.max("|p| p.age")):
        with pytest.raises(BY_NAME["lookup_err"]):
            bad()
    with pytest.raises(BY_NAME["type_err"]):
        people.sum("|p| p.boss")
    with pytest.raises(BY_NAME["type_err"]):
        people.filter("|p| p.name > 1")
    with pytest.raises(BY_NAME["zero_div_err"]):
        people.map("|p| 1 / (p.age - 6)").sum()
    with pytest.raises(BY_NAME["overflow_err"]):
        people.map("|p| p.age + INT_MAX").sum()
    with pytest.raises(BY_NAME["operation_err"]):
        Coll(people.rows).slice(0, 1)


def test_text_queries_over_tables(people, spark):
    engine = Engine(spark)
    engine.bind("stuff", "people", people)
    assert engine.query("people.filter(|p| p.age > least).map(|p| p.name).sort()[:1].first()", least=5) == "Anne"
    assert engine.query("n = people.sum(|p| p.age); n > 70 ? 'many' : 'few'") == "many"
    out = engine.query("people.map(|p| {id: p.id, k: p.age * 2})")
    assert isinstance(out, Coll) and out.list()[0] == {"id": 1, "k": 12}
    assert engine.query("(people.filter(|p| p.age > 5) - people.filter(|p| p.age > 30)).len()") == 1


def test_plans_stay_in_the_jvm_and_push_down(spark):
    t = Coll(spark.read.parquet(f"{SF}/lineitem.parquet"))
    plan = t.filter("|l| l.l_quantity > 45").map("|l| l.l_extendedprice").rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double>" in plan
    assert "Python" not in plan and "Exchange" not in plan


def test_nan_and_kinds(spark):
    df = spark.createDataFrame([(1, float("nan"), "a"), (2, 1.0, None)], "id long, x double, s string")
    c = Coll(df, ["id"], "id")
    assert c.map("|r| r.x == r.x").list() == [False, True]
    assert c.map("|r| r.s == nil").list() == [False, True]
    assert c.map("|r| is_nan(r.x)").list() == [True, False]
    assert c.map("|r| r.s || 'none'").list() == ["a", "none"]


def test_compiler_errors():
    c = Compiler()
    for bad in ("|x| x.push", "|x| for (a in x) a", "|x| y"):
        with pytest.raises(Exception):
            c.closure(bad).apply(__import__("quillon.functions.semantics", fromlist=["lit"]).lit(1))


def test_positions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = with_position(df, [F.col("k").asc()]).toPandas()
    assert (got.k == got._pos).all()


def test_relations(spark, people):
    assert {r.boss: list(r.ids) for r in inverse(people, "boss").collect()} == {1: [2, 3], 9: [4]}
    edges = spark.createDataFrame([(1, "a", 2), (2, "b", 3), (3, "c", 1), (1, "d", 3)], "parent long, key string, child long")
    assert [(r.parent, r.key, r.depth) for r in search(edges, 1, 3, deep=3, limit=5).collect()] == [(1, "d", 0), (2, "b", 1)]


def test_rooms_as_streams(spark, tmp_path):
    path, seen = str(tmp_path / "events"), []
    rooms.emit(spark.range(3), path, "news", "tick", "id")
    rooms.emit(spark.range(2), path, "other", "tock", "id")
    assert rooms.replay(spark, path, "news").count() == 3
    q = rooms.listen(rooms.join(spark, path, "news"), lambda df, _: seen.append(df.count()), str(tmp_path / "cp"), available_now=True)
    q.awaitTermination(60)
    assert sum(seen) == 3
    counts = rooms.windowed(rooms.join(spark, path))
    w = counts.writeStream.outputMode("complete").format("memory").queryName("room_counts").start()
    w.processAllAvailable()
    w.stop()
    assert {(r.room, r.n) for r in spark.sql("SELECT room, sum(n) AS n FROM room_counts GROUP BY room").collect()} == {("news", 3), ("other", 2)}


def test_types_over_tables_and_snapshots(spark, people, tmp_path):
    engine = Engine(spark)
    engine.query("set_type('Person', {name: 'str', age: 'uint', note: 'str<0:9:none>'}); set_type('Old', {age: 'int<40:99>'})")
    table = people.df().withColumnRenamed("id", "#")
    engine.bind_type("stuff", "Person", table)
    assert engine.query("type_count('Person')") == 4
    assert engine.query("type_all('Person').filter(|p| p.age > 6).map(|p| p.note).unique()").list() == ["none"]
    assert engine.query("Person(2).name") == "Anne"
    with pytest.raises(BY_NAME["lookup_err"]):
        engine.query("Person(77)")
    engine.bind_type("stuff", "Old", table)
    with pytest.raises(BY_NAME["value_err"]):
        engine.query("type_all('Old').sum(|p| p.age)")
    engine.bind("stuff", "people", people)
    engine.query(".x = 5")
    names = engine.dump_tables("stuff", str(tmp_path / "snap"))
    other = Engine(spark)
    other.load_tables("stuff", str(tmp_path / "snap"), names, {"people": "id"})
    assert other.query(".x + people.len()") == 9 and other.query("has_type('Person')")
