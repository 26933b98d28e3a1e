"""Contract queries: each runs program text (or the same operators) over whole tables; SQL says the same for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.lang.compile import Compiler
from quillon.operators import relations
from quillon.operators.collection import Coll
from quillon.runtime.types import Types
from quillon.sources import tables
from quillon.streaming import rooms

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


class Tables:
    """The tables of a folder as collections with their references; read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, compiler: Compiler | None = None):
        self.spark, self.dir, self.compiler = spark, sf_dir, compiler

    def df(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def coll(self, name: str, key: str | None = None, refs: dict | None = None) -> Coll:
        return Coll(self.df(name), [key] if key else None, key, refs, self.compiler)

    @property
    def region(self) -> Coll:
        return self.coll("region", "r_regionkey")

    @property
    def nation(self) -> Coll:
        return self.coll("nation", "n_nationkey", {"region": ("n_regionkey", self.region)})

    @property
    def customer(self) -> Coll:
        return self.coll("customer", "c_custkey", {"nation": ("c_nationkey", self.nation)})

    @property
    def orders(self) -> Coll:
        return self.coll("orders", "o_orderkey", {"customer": ("o_custkey", self.customer)})

    @property
    def part(self) -> Coll:
        return self.coll("part", "p_partkey")

    @property
    def supplier(self) -> Coll:
        return self.coll("supplier", "s_suppkey", {"nation": ("s_nationkey", self.nation)})

    @property
    def lineitem(self) -> Coll:
        return self.coll("lineitem", None, {"order": ("l_orderkey", self.orders), "part": ("l_partkey", self.part), "supplier": ("l_suppkey", self.supplier)})

    @property
    def events(self) -> Coll:
        return self.coll("events", "event_id")

    @property
    def documents(self) -> Coll:
        return self.coll("documents", "doc_id")

    @property
    def embeddings(self) -> Coll:
        return self.coll("embeddings", "vec_id")

    @property
    def pages(self) -> Coll:
        return self.coll("pages", "page_id")


def add(name: str, sql: str | None, f: Callable[[Tables], Coll | DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f(Tables(spark, sf_dir))
        return out.df() if isinstance(out, Coll) else out

    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


def mapped(name: str, table: str, closure: str, sql: str, where: str | None = None) -> None:
    """table.filter(where).map(closure), and its SQL."""
    add(name, sql, lambda t: (getattr(t, table).filter(where) if where else getattr(t, table)).map(closure))


# -- projections, filters, folds ---------------------------------------------------------------------------------------
mapped("op_filter", "lineitem", "|l| {ok: l.l_orderkey, line: l.l_linenumber, qty: l.l_quantity}", "SELECT l_orderkey AS ok, l_linenumber::BIGINT AS line, l_quantity AS qty FROM lineitem WHERE l_quantity > 45", "|l| l.l_quantity > 45")
mapped("op_map", "orders", "|o| {id: o.o_orderkey, half: o.o_totalprice / 2, big: o.o_totalprice > 100000, tag: o.o_orderstatus + '-' + o.o_orderpriority}", "SELECT o_orderkey AS id, o_totalprice / 2 AS half, o_totalprice > 100000 AS big, o_orderstatus || '-' || o_orderpriority AS tag FROM orders")
add("op_filter_map_sum", "SELECT round(sum(l_extendedprice), 2) AS value FROM lineitem WHERE l_quantity > 45", lambda t: t.lineitem.filter("|l| l.l_quantity > 45").map("|l| l.l_extendedprice").agg_sum().select(F.round("value", 2).alias("value")))
add("op_filter_index", "SELECT o_orderkey AS id FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i % 7 = 3", lambda t: t.orders.filter("|o, i| i % 7 == 3").map("|o| {id: o.o_orderkey}"))
add("op_map_index", "SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part", lambda t: t.part.map("|p, i| {id: p.p_partkey, i: i}"))
mapped("op_vmap", "customer", "|c| {id: c.c_custkey, v: {a: c.c_custkey, b: c.c_nationkey}.vmap(|x| x * 3).values().sum()}", "SELECT c_custkey AS id, c_custkey * 3 + c_nationkey::BIGINT * 3 AS v FROM customer")
mapped("op_thing_filter", "customer", "|c| {id: c.c_custkey, n: {a: c.c_custkey, b: c.c_nationkey, z: 0}.filter(|k, v| v > 10).len()}", "SELECT c_custkey AS id, (c_custkey > 10)::BIGINT + (c_nationkey > 10)::BIGINT AS n FROM customer")
add("op_reduce", "SELECT sum(o_orderkey * 2)::BIGINT + 10 AS value FROM orders", lambda t: t.orders.agg_reduce("|acc, o| acc + o.o_orderkey * 2", 10))
mapped("op_reduce_cell", "embeddings", "|e| {id: e.vec_id, r: round(e.embedding.reduce(|a, x| a * 0.5 + x, 0.0), 6)}", "SELECT vec_id AS id, round(list_reduce(list_prepend(0.0::DOUBLE, embedding::DOUBLE[]), lambda a, x: a * 0.5 + x), 6) AS r FROM embeddings")
add("op_find", "SELECT * FROM (SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderkey LIMIT 1)", lambda t: t.orders.filter("|o| o.o_totalprice > 100000").slice(0, 1).map("|o| {id: o.o_orderkey, price: o.o_totalprice}"))
add("op_find_index", "SELECT count(*) AS value FROM orders WHERE o_orderkey < (SELECT min(o_orderkey) FROM orders WHERE o_totalprice > 300000)", lambda t: t.orders.agg_find_index("|o| o.o_totalprice > 300000"))
add("op_index_of", "SELECT count(*) AS value FROM events WHERE event_id < (SELECT min(event_id) FROM events WHERE event_type = 'error')", lambda t: t.events.map("|e| e.event_type").agg_index_of("error"))
add("op_some", "SELECT bool_or(value > 99) AS value FROM events", lambda t: t.events.agg_some("|e| e.value > 99"))
add("op_every", "SELECT bool_and(value >= 0) AS value FROM events", lambda t: t.events.agg_every("|e| e.value >= 0"))
add("op_has", "SELECT bool_or(o_orderkey = 77) AS value FROM orders", lambda t: t.orders.agg_has(77))
mapped("op_cell_predicates", "embeddings", "|e| {id: e.vec_id, any: e.embedding.some(|x| x > 0.3), all: e.embedding.every(|x| x < 0.4), n: e.embedding.count(|x| x > 0), at: e.embedding.find_index(|x| x > 0.2)}", "SELECT vec_id AS id, list_bool_or(list_transform(embedding, lambda x: x > 0.3::DOUBLE)) AS any, list_bool_and(list_transform(embedding, lambda x: x < 0.4::DOUBLE)) AS \"all\", len(list_filter(embedding, lambda x: x > 0))::BIGINT AS n, list_position(list_transform(embedding, lambda x: x > 0.2::DOUBLE), true)::BIGINT - 1 AS at FROM embeddings")
mapped("op_contains", "documents", "|d| {id: d.doc_id, the: d.text.contains(' the '), und: d.text.contains('und')}", "SELECT doc_id AS id, contains(text, ' the ') AS the, contains(text, 'und') AS und FROM documents")
mapped("op_keys_values", "nation", "|n| {id: n.n_nationkey, keys: n.keys().join(','), vals: {a: n.n_nationkey, b: n.n_regionkey}.values().sum(), has: n.has('n_name'), no: n.has('x')}", "SELECT n_nationkey::BIGINT AS id, 'n_nationkey,n_name,n_regionkey' AS keys, (n_nationkey + n_regionkey)::BIGINT AS vals, true AS has, false AS no FROM nation")
mapped("op_get_default", "region", "|r| {name: r.get('r_name', 'x'), none: r.get('nothing', 7)}", "SELECT r_name AS name, 7::BIGINT AS none FROM region")
mapped("op_len", "documents", "|d| {id: d.doc_id, bytes: d.text.len(), words: d.text.split().len(), fields: d.len()}", "SELECT doc_id AS id, strlen(text)::BIGINT AS bytes, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'))::BIGINT AS words, 5::BIGINT AS fields FROM documents")
add("op_flat", "SELECT doc_id AS id, w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS w FROM documents)", lambda t: t.documents.rows.select("doc_id").join(_words(t), "doc_id").select(F.col("doc_id").alias("id"), "w"))
add("op_flat_list", "SELECT w AS _v, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS w FROM documents) GROUP BY w", lambda t: t.documents.map("|d| d.text.split()").flat().rows.groupBy("_v").agg(F.count(F.lit(1)).alias("n")))
add("op_map_id", "SELECT o_orderkey AS _v FROM orders", lambda t: t.orders.map_id())
add("op_copy", "SELECT * FROM region", lambda t: t.region.copy())
add("op_first_last", "SELECT * FROM (SELECT o_orderkey AS id FROM orders ORDER BY 1 LIMIT 1) UNION ALL SELECT * FROM (SELECT o_orderkey AS id FROM orders ORDER BY 1 DESC LIMIT 1)", lambda t: t.orders.slice(0, 1).map("|o| {id: o.o_orderkey}").df().unionByName(t.orders.reverse().slice(0, 1).map("|o| {id: o.o_orderkey}").df()))
mapped("op_cell_ends", "embeddings", "|e| {id: e.vec_id, first: e.embedding.first(), last: e.embedding.last(), third: e.embedding[2], end: e.embedding[-1], none: [].first(0)}", "SELECT vec_id AS id, embedding[1] AS first, embedding[len(embedding)] AS last, embedding[3] AS third, embedding[len(embedding)] AS end, 0::BIGINT AS none FROM embeddings")


def _words(t: Tables) -> DataFrame:
    from quillon.functions.semantics import of_field

    df = t.df("documents")
    v = t.documents.compiler.closure("|s| s.split()").apply(of_field(F.col("text"), df.schema["text"].dataType))
    return df.select("doc_id", F.explode(v.c).alias("w"))


# -- aggregates, order, lists --------------------------------------------------------------------------------------------
add("op_count", "SELECT count(*) AS value FROM events WHERE event_type = 'click'", lambda t: t.events.map("|e| e.event_type").agg_count("click"))
add("op_count_closure", "SELECT count(*) AS value FROM lineitem WHERE l_discount > 0.05 AND l_returnflag = 'R'", lambda t: t.lineitem.agg_count(t.lineitem.fn("|l| l.l_discount > 0.05 && l.l_returnflag == 'R'")))
add("op_sum_int", "SELECT sum(p_size)::BIGINT AS value FROM part", lambda t: t.part.agg_sum("|p| p.p_size"))
add("op_min_max", "SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders", lambda t: t.orders.agg_min("|o| o.o_totalprice").withColumnRenamed("value", "lo").crossJoin(t.orders.agg_max("|o| o.o_totalprice").withColumnRenamed("value", "hi")))
mapped("op_cell_aggregates", "embeddings", "|e| {id: e.vec_id, lo: e.embedding.min(), hi: e.embedding.max(), s: round(e.embedding.sum(), 4), u: e.embedding.is_unique()}", "SELECT vec_id AS id, list_min(embedding) AS lo, list_max(embedding) AS hi, round(list_reduce(list_prepend(0.0::DOUBLE, embedding::DOUBLE[]), lambda a, x: a + x), 4) AS s, len(list_distinct(embedding)) = len(embedding) AS u FROM embeddings")
add("op_unique", "SELECT DISTINCT o_orderpriority AS _v FROM orders", lambda t: t.orders.map("|o| o.o_orderpriority").unique())
add("op_is_unique", "SELECT count(*) = count(DISTINCT c_name) AS value FROM customer", lambda t: t.customer.map("|c| c.c_name").agg_is_unique())
add("op_sort_slice", "SELECT * FROM (SELECT o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)", lambda t: t.orders.sort("|o| o.o_totalprice", True).slice(0, 10).map("|o| {id: o.o_orderkey, price: o.o_totalprice}"))
add("op_sort_rank", "SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS i FROM supplier", lambda t: t.supplier.sort("|s| s.s_acctbal").map("|s, i| {id: s.s_suppkey, i: i}"))
mapped("op_sort_cell", "embeddings", "|e| {id: e.vec_id, second: e.embedding.sort()[1], top: e.embedding.sort(true)[0], far: e.embedding.sort(|x| abs(x))[-1]}", "SELECT vec_id AS id, list_sort(embedding)[2] AS second, list_max(embedding) AS top, list_last(list_sort(list_transform(embedding, lambda x: {'k': abs(x), 'v': x}))).v AS far FROM embeddings")
add("op_slice", "SELECT o_orderkey AS id FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i >= 100 AND i < 300", lambda t: t.orders.slice(100, 300).map("|o| {id: o.o_orderkey}"))
add("op_slice_step", "SELECT o_orderkey AS id FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) WHERE i >= 5 AND i < n - 5 AND (i - 5) % 3 = 0", lambda t: t.orders.slice(5, -5, 3).map("|o| {id: o.o_orderkey}"))
mapped("op_slice_cell", "events", "|e| {id: e.event_id, a: e.event_type[1:3], b: e.event_type[::-1], c: e.event_type[-2:], d: range(10)[1:8:3].sum(), f: range(10)[::-2][1]}", "SELECT event_id AS id, event_type[2:3] AS a, reverse(event_type) AS b, right(event_type, 2) AS c, 12::BIGINT AS d, 7::BIGINT AS f FROM events")
add("op_reverse", "SELECT * FROM (SELECT p_partkey AS id FROM part ORDER BY 1 DESC LIMIT 25)", lambda t: t.part.reverse().slice(0, 25).map("|p| {id: p.p_partkey}"))
mapped("op_range", "part", "|p| {id: p.p_partkey, s: range(p.p_size).sum(), n: range(2, p.p_size, 3).len(), d: range(p.p_size, 0, -2).len()}", "SELECT p_partkey AS id, coalesce(list_sum(range(p_size)), 0)::BIGINT AS s, len(range(2, p_size, 3))::BIGINT AS n, len(range(p_size, 0, -2))::BIGINT AS d FROM part")
mapped("op_list_edit", "part", "|p| {id: p.p_partkey, push: [1, 2].push(p.p_size).sum(), un: [1, 2].unshift(p.p_size)[0], ext: [1].extend([p.p_size, 4]).len(), eu: [1, 2].extend_unique([2, p.p_size, p.p_size]).len(), fill: [1, 2, 3].fill(p.p_size).sum(), rm: [1, p.p_size, 30].remove(|x| x > 20).len(), pop: [p.p_size, 9].pop(), shift: [p.p_size, 9].shift(), gone: range(p.p_size).splice(1, 2).sum()}", "SELECT p_partkey AS id, (3 + p_size)::BIGINT AS push, p_size::BIGINT AS un, 3::BIGINT AS ext, (CASE WHEN p_size IN (1, 2) THEN 2 ELSE 3 END)::BIGINT AS eu, (3 * p_size)::BIGINT AS fill, (1 + (p_size > 20)::INT)::BIGINT AS rm, 9::BIGINT AS pop, p_size::BIGINT AS shift, coalesce(list_sum(range(p_size)[2:3]), 0)::BIGINT AS gone FROM part")
add("op_splice", "SELECT p_partkey AS id FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part) WHERE i < 10 OR i >= 60", lambda t: t.part.splice(10, 50)[0].map("|p| {id: p.p_partkey}"))
add("op_extend", "SELECT r_name AS _v FROM region UNION ALL SELECT n_name FROM nation", lambda t: t.region.map("|r| r.r_name").extend(t.nation.map("|n| n.n_name")))
add("op_extend_unique", "SELECT o_custkey AS _v FROM orders UNION ALL SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", lambda t: t.orders.map("|o| o.o_custkey").extend_unique(t.customer.map("|c| c.c_custkey")))
add("op_remove", "SELECT o_orderkey AS id FROM orders WHERE NOT o_totalprice > 200000", lambda t: t.orders.remove("|o| o.o_totalprice > 200000")[0].map("|o| {id: o.o_orderkey}"))
add("op_remove_limit", "SELECT * FROM (SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 200000 ORDER BY o_orderkey DESC LIMIT 20)", lambda t: t.orders.remove("|o| o.o_totalprice > 200000", -20)[1].map("|o| {id: o.o_orderkey}"))
add("op_join_strings", "SELECT string_agg(n_name, '|' ORDER BY n_nationkey) AS value FROM nation", lambda t: t.nation.map("|n| n.n_name").agg_join("|"))

# -- sets, references -------------------------------------------------------------------------------------------------
_A, _B = "|o| o.o_totalprice > 150000", "|o| o.o_orderstatus == 'F'"
for _name, _op, _sql in (("union", "union", "a OR b"), ("intersect", "intersect", "a AND b"), ("difference", "difference", "a AND NOT b"), ("symdiff", "symmetric", "a <> b")):
    add(f"op_set_{_name}", f"SELECT o_orderkey AS id FROM (SELECT *, o_totalprice > 150000 AS a, o_orderstatus = 'F' AS b FROM orders) WHERE {_sql}", lambda t, op=_op: getattr(t.orders.filter(_A), op)(t.orders.filter(_B)).map("|o| {id: o.o_orderkey}"))
mapped("op_set_cell", "part", "|p| {id: p.p_partkey, a: (set([1, 2, p.p_size]) | set([p.p_size, 7])).len(), b: (set([1, p.p_size]) & set([p.p_size])).len(), c: (set([1, 2]) - set([p.p_size])).len(), d: (set([1, 2]) ^ set([2, p.p_size])).len(), s: set([p.p_size]) < set([p.p_size, 77])}", "SELECT p_partkey AS id, len(list_distinct([1, 2, 7, p_size]))::BIGINT AS a, 1::BIGINT AS b, (2 - (p_size IN (1, 2))::INT)::BIGINT AS c, (CASE p_size WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END)::BIGINT AS d, true AS s FROM part")
add("op_subset", "SELECT n_nationkey::BIGINT AS id, true AS a, false AS b, true AS c FROM nation", lambda t: _engine(t, "x = orders.filter(|o| o.o_totalprice > 200000); y = orders.filter(|o| o.o_totalprice > 100000); a = x <= y; b = y < x; c = y >= x; nation.map(|n| {id: n.n_nationkey, a: a, b: b, c: c})"))
mapped("op_deref", "orders", "|o| {id: o.o_orderkey, who: o.customer.c_name, where: o.customer.nation.n_name, region: o.customer.nation.region.r_name}", 'SELECT o_orderkey AS id, c_name AS who, n_name AS "where", r_name AS region FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey')
add("op_deref_sum", "SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'", lambda t: t.lineitem.filter("|l| l.supplier.nation.region.r_name == 'ASIA'").agg_sum("|l| l.l_extendedprice * (1 - l.l_discount)").select(F.round("value", 2).alias("value")))
add("op_has_semi", "SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", lambda t: t.customer.intersect(_buyers(t)).map("|c| {id: c.c_custkey}"))
add("op_has_anti", "SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", lambda t: t.customer.difference(_buyers(t)).map("|c| {id: c.c_custkey}"))
add("op_relation_inverse", 'SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1', lambda t: relations.inverse_counts(t.orders, "o_custkey"))
add("op_relation_broken", "SELECT l_orderkey AS id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)", lambda t: relations.broken(t.lineitem, "l_partkey", t.part.filter("|p| p.p_size > 10")).select(F.col("l_orderkey").alias("id")))
add(
    "op_search_graph",
    "SELECT DISTINCT c_nationkey::BIGINT AS parent, 'region' AS key, 1 AS depth FROM (SELECT c_nationkey FROM customer WHERE c_custkey = 1) JOIN nation ON c_nationkey = n_nationkey",
    lambda t: _search(t),
)


def _search(t: Tables) -> DataFrame:
    """From customer 1 (a thing of its own) to its region, along references."""
    edges = t.df("customer").select((F.col("c_custkey") + 1_000_000).alias("parent"), F.lit("nation").alias("key"), F.col("c_nationkey").cast("long").alias("child"))
    nations = t.df("nation").select(F.col("n_nationkey").cast("long").alias("parent"), F.lit("region").alias("key"), (F.col("n_regionkey") + 100).cast("long").alias("child"))
    edges = edges.unionByName(nations)
    goal = t.df("customer").where("c_custkey = 1").join(t.df("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey").first()[0]
    return relations.search(edges, 1_000_001, goal + 100, deep=3, limit=10)


# -- strings, expressions ---------------------------------------------------------------------------------------------
mapped("op_str_case", "documents", "|d| {id: d.doc_id, lo: d.text.lower(), up: d.source.upper()}", f"SELECT doc_id AS id, {LOWER.format('text')} AS lo, upper(source) AS up FROM documents")
mapped("op_str_trim", "documents", "|d| {id: d.doc_id, t: ('\t  ' + d.text + ' \n').trim(), l: (' ' + d.lang).trim_left(), r: (d.lang + '\n ').trim_right()}", "SELECT doc_id AS id, regexp_replace(text, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS t, lang AS l, lang AS r FROM documents")
mapped("op_str_ends", "documents", "|d| {id: d.doc_id, a: d.text.starts_with('The '), b: d.text.ends_with('.')}", "SELECT doc_id AS id, starts_with(text, 'The ') AS a, ends_with(text, '.') AS b FROM documents")
mapped("op_str_split", "orders", "|o| {id: o.o_orderkey, a: o.o_orderpriority.split('-')[0], n: o.o_orderpriority.split('-', 1).len(), r: o.o_orderpriority.split('-', -1).len(), x: o.o_orderpriority.split(/[-A]/).len()}", "SELECT o_orderkey AS id, string_split(o_orderpriority, '-')[1] AS a, least(len(string_split(o_orderpriority, '-')), 2)::BIGINT AS n, least(len(string_split(o_orderpriority, '-')), 2)::BIGINT AS r, len(regexp_split_to_array(o_orderpriority, '[-A]'))::BIGINT AS x FROM orders")
mapped("op_str_replace", "documents", "|d| {id: d.doc_id, a: d.text.replace('the', 'THE'), b: d.text.replace(/[aeiou]+/, '_'), c: d.source.replace('s', 'S', 1), e: 'a-b-c'.replace('-', '+', -1), f: 'ab1c22'.replace(/[0-9]/, |m| '<' + m + '>')}", "SELECT doc_id AS id, replace(text, 'the', 'THE') AS a, regexp_replace(text, '[aeiou]+', '_', 'g') AS b, regexp_replace(source, 's', 'S') AS c, 'a-b+c' AS e, 'ab<1>c<2><2>' AS f FROM documents")
mapped("op_regex_test", "documents", "|d| {id: d.doc_id, a: /^[A-Z]/.test(d.text), b: /THE/i.test(d.text)}", "SELECT doc_id AS id, regexp_matches(text, '^[A-Z]') AS a, regexp_matches(text, 'THE', 'i') AS b FROM documents")
mapped("op_regex_match", "events", "|e| {id: e.event_id, n: /\"(\\w+)\": ?([0-9]+)/.match(e.props)[2], k: /\"(\\w+)\": ?([0-9]+)/.match(e.props)[1], all: /[0-9]/g.match(e.props).len()}", "SELECT event_id AS id, regexp_extract(props, '\"(\\w+)\": ?([0-9]+)', 2) AS n, regexp_extract(props, '\"(\\w+)\": ?([0-9]+)', 1) AS k, len(regexp_extract_all(props, '[0-9]'))::BIGINT AS \"all\" FROM events")
mapped("op_is_url", "pages", "|p| {id: p.page_id, url: is_url(p.url), mail: is_email('a@' + p.url.split('/')[2]), tel: is_tel('+31 6 1234 5678')}", "SELECT page_id AS id, regexp_matches(url, '^(https?|ftp):\\/\\/[-a-zA-Z0-9@:%._\\+~#=]{1,256}\\b([-a-zA-Z0-9@:%_\\+.~#?&//=]*)$') AS url, regexp_matches('a@' || string_split(url, '/')[3], '^[a-zA-Z0-9.!#$%&’*+/=?^_`{|}~-]+@[a-zA-Z0-9-]+(?:\\.[a-zA-Z0-9-]+)*$') AS mail, true AS tel FROM pages")
mapped("op_bytes", "documents", "|d| {id: d.doc_id, b64: base64_encode(d.source), back: str(base64_decode(base64_encode(d.lang))), ascii: is_ascii(d.text), utf8: is_utf8(d.text), n: bytes(d.text).len()}", "SELECT doc_id AS id, base64(encode(source)) AS b64, lang AS back, regexp_matches(text, '^[\\x00-\\x7F]*$') AS ascii, true AS utf8, strlen(text)::BIGINT AS n FROM documents")
mapped("op_template", "orders", "|o| {id: o.o_orderkey, t: `order {o.o_orderkey} of {o.o_custkey}: {o.o_orderstatus == 'F'}`}", "SELECT o_orderkey AS id, 'order ' || o_orderkey || ' of ' || o_custkey || ': ' || (o_orderstatus = 'F')::VARCHAR AS t FROM orders")
mapped("op_truthy_and_or", "part", "|p| {id: p.p_partkey, a: p.p_size % 3 && p.p_size, b: p.p_size % 2 || 100, c: !(p.p_size % 5), d: '' || p.p_brand, e: bool(p.p_size - 1)}", "SELECT p_partkey AS id, (CASE WHEN p_size % 3 <> 0 THEN p_size ELSE 0 END)::BIGINT AS a, (CASE WHEN p_size % 2 <> 0 THEN p_size % 2 ELSE 100 END)::BIGINT AS b, p_size % 5 = 0 AS c, p_brand AS d, p_size <> 1 AS e FROM part")
mapped("op_ternary", "customer", "|c| {id: c.c_custkey, k: c.c_acctbal < 0 ? 'debt' : c.c_acctbal > 5000 ? 'rich' : 'ok', i: if (c.c_acctbal > 0) 1 else -1}", "SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'ok' END AS k, (CASE WHEN c_acctbal > 0 THEN 1 ELSE -1 END)::BIGINT AS i FROM customer")
mapped("op_eq_mixed", "part", "|p| {id: p.p_partkey, a: p.p_size == 7.0, b: p.p_size == '7', c: p.p_brand == bytes(p.p_brand), d: true == 1, e: nil == p.p_brand, f: p.p_size != 7}", "SELECT p_partkey AS id, p_size = 7 AS a, false AS b, true AS c, true AS d, false AS e, p_size <> 7 AS f FROM part")

# -- numbers ---------------------------------------------------------------------------------------------------------
mapped("op_int_div_mod", "lineitem", "|l| {k: l.l_orderkey, p: l.l_partkey, a: (0 - l.l_partkey) / 7, b: (0 - l.l_partkey) % 7, c: l.l_quantity / 4, d: l.l_quantity % 3}", "SELECT l_orderkey AS k, l_partkey AS p, (-l_partkey) // 7 AS a, (-l_partkey) % 7 AS b, l_quantity / 4 AS c, l_quantity::BIGINT % 3 AS d FROM lineitem")
mapped("op_bitwise", "part", "|p| {id: p.p_partkey, a: p.p_partkey & 12, b: p.p_partkey | 3, c: p.p_partkey ^ 5, d: ~p.p_partkey, e: p.p_partkey << 3, f: p.p_partkey >> 2, g: (0 - p.p_partkey).bit_count()}", "SELECT p_partkey AS id, p_partkey & 12 AS a, p_partkey | 3 AS b, xor(p_partkey, 5) AS c, -p_partkey - 1 AS d, p_partkey * 8 AS e, p_partkey // 4 AS f, bit_count(p_partkey)::BIGINT AS g FROM part")
mapped("op_math_round", "customer", "|c| {id: c.c_custkey, a: abs(c.c_acctbal), b: ceil(c.c_acctbal), c: floor(c.c_acctbal), e: round(c.c_custkey, -1), f: round(c.c_acctbal)}", "SELECT c_custkey AS id, abs(c_acctbal) AS a, ceil(c_acctbal)::BIGINT AS b, floor(c_acctbal)::BIGINT AS c, ((c_custkey + 5) // 10) * 10 AS e, (sign(c_acctbal) * floor(abs(c_acctbal) + 0.5))::BIGINT AS f FROM customer")
mapped("op_math_real", "part", "|p| {id: p.p_partkey, a: round(sqrt(p.p_retailprice), 6), b: round(loge(p.p_size), 6), c: round(log10(p.p_size), 6), d: round(log2(p.p_size), 6), e: round(pow(p.p_size, 2), 3), f: round(exp(p.p_size / 50.0), 6), g: round(sin(p.p_size), 6), h: round(cos(p.p_size), 6), i: round(tan(p.p_size), 4)}", "SELECT p_partkey AS id, round(sqrt(p_retailprice), 6) AS a, round(ln(p_size), 6) AS b, round(log10(p_size), 6) AS c, round(log2(p_size), 6) AS d, round(pow(p_size, 2), 3) AS e, round(exp(p_size / 50.0), 6) AS f, round(sin(p_size), 6) AS g, round(cos(p_size), 6) AS h, round(tan(p_size), 4) AS i FROM part")
mapped("op_casts", "orders", "|o| {id: o.o_orderkey, i: int(o.o_totalprice), s: str(o.o_orderkey), p: int('12ab'), h: int('0x1f'), f: float('3.5x'), b: bool(o.o_orderstatus), n: is_nan('x'), z: is_inf(o.o_totalprice)}", "SELECT o_orderkey AS id, trunc(o_totalprice)::BIGINT AS i, o_orderkey::VARCHAR AS s, 12::BIGINT AS p, 31::BIGINT AS h, 3.5::DOUBLE AS f, true AS b, true AS n, false AS z FROM orders")
mapped("op_kinds", "orders", "|o| {id: o.o_orderkey, a: is_int(o.o_orderkey), b: is_float(o.o_totalprice), c: is_str(o.o_orderstatus), d: is_datetime(o.o_orderdate), e: is_nil(nil), f: is_list([1]), g: is_thing({a: 1}), h: is_bool(true), i: is_bytes(bytes('x')), j: is_raw('x'), k: type(o.o_totalprice), l: is_set(1), m: is_array([1])}", "SELECT o_orderkey AS id, true AS a, true AS b, true AS c, true AS d, true AS e, true AS f, true AS g, true AS h, true AS i, true AS j, 'float' AS k, false AS l, true AS m FROM orders")

# -- date and time ------------------------------------------------------------------------------------------------------
mapped("op_dt_extract", "orders", "|o| {id: o.o_orderkey, y: o.o_orderdate.extract('year'), m: o.o_orderdate.extract().month, d: o.o_orderdate.extract('day'), w: o.o_orderdate.week(), wd: o.o_orderdate.weekday(), yd: o.o_orderdate.yday()}", "SELECT o_orderkey AS id, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, strftime(o_orderdate, '%U')::BIGINT AS w, dayofweek(o_orderdate) AS wd, dayofyear(o_orderdate) - 1 AS yd FROM orders")
mapped("op_dt_move", "events", "|e| {id: e.event_id, a: int(e.ts.move('days', 40)), b: int(e.ts.move('hours', -5)), c: int(e.ts.move('weeks', 2)), m: str(datetime(2023, 1, 31).move('months', 1))}", "SELECT event_id AS id, floor(epoch(ts))::BIGINT + 40 * 86400 AS a, floor(epoch(ts))::BIGINT - 5 * 3600 AS b, floor(epoch(ts))::BIGINT + 14 * 86400 AS c, '2023-03-03T00:00:00Z' AS m FROM events")
mapped("op_dt_months", "orders", "|o| {id: o.o_orderkey, t: o.o_orderdate.move('months', 1).format('%Y-%m-%d'), y: o.o_orderdate.move('years', -1).format('%d/%m/%Y')}", "SELECT o_orderkey AS id, strftime(make_date((year(o_orderdate) * 12 + month(o_orderdate)) // 12, (year(o_orderdate) * 12 + month(o_orderdate)) % 12 + 1, 1) + (day(o_orderdate) - 1)::INT, '%Y-%m-%d') AS t, strftime(make_date(year(o_orderdate) - 1, month(o_orderdate), 1) + (day(o_orderdate) - 1)::INT, '%d/%m/%Y') AS y FROM orders")
mapped("op_dt_format", "orders", "|o| {id: o.o_orderkey, a: o.o_orderdate.format('%Y/%m/%d %H:%M'), b: str(o.o_orderdate), r: str(o.o_orderdate.replace({day: 1}))}", "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS a, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS b, strftime(date_trunc('month', o_orderdate) + (o_orderdate - date_trunc('day', o_orderdate)), '%Y-%m-%dT%H:%M:%SZ') AS r FROM orders")
mapped("op_dt_parse", "orders", "|o| {id: o.o_orderkey, a: int(datetime(o.o_orderdate.format('%Y-%m-%d'))), b: int(datetime(o.o_orderkey)), c: str(datetime(2020, 2, 29, 13, 5, 6, 'Europe/Amsterdam')), z: datetime(2020, 1, 1).to('+0200').zone()}", "SELECT o_orderkey AS id, epoch(date_trunc('day', o_orderdate))::BIGINT AS a, o_orderkey AS b, '2020-02-29T13:05:06+0100' AS c, '+0200' AS z FROM orders")

# -- JSON, types, procedures, rooms ---------------------------------------------------------------------------------
mapped("op_json_dump", "nation", "|n| {id: n.n_nationkey, j: json_dump({k: n.n_nationkey, n: n.n_name, l: [1, 2]})}", "SELECT n_nationkey::BIGINT AS id, '{\"k\":' || n_nationkey || ',\"n\":\"' || n_name || '\",\"l\":[1,2]}' AS j FROM nation")
mapped("op_json_load", "events", "|e| {id: e.event_id, k: int(json_load(e.props).k)}", "SELECT event_id AS id, coalesce(json_extract_string(props, '$.k')::BIGINT, 0) AS k FROM events")
add("op_wrap_view", 'SELECT o_orderkey, o_totalprice FROM orders', lambda t: t.orders.wrap({"o_orderkey": "int", "o_totalprice": "float", "missing": "str"}))
add("op_type_count", "SELECT c_custkey AS id, (SELECT count(*) FROM customer)::BIGINT AS n FROM customer WHERE c_custkey <= 5", lambda t: _engine(t, "n = type_count('Buyer'); customer.filter(|c| c.c_custkey <= 5).map(|c| {id: c.c_custkey, n: n})"))
add("op_type_all", "SELECT c_custkey AS id, c_name AS name, 'new' AS state FROM customer", lambda t: _engine(t, "type_all('Buyer').map(|c| {id: c.c_custkey, name: c.c_name, state: c.state})"))
add("op_type_check", "SELECT c_custkey, c_name, 'none' AS note, 1::BIGINT AS n FROM customer", lambda t: _typed(t))
add("op_enum_map", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS state FROM orders", lambda t: _with(t, enums={"State": {"F": "done", "O": "open", "P": "part"}}).orders.map("|o| {id: o.o_orderkey, state: o.o_orderstatus == 'F' ? State{F} : o.o_orderstatus == 'O' ? State{O} : State{P}}"))
add("op_procedure", "SELECT l_orderkey AS k, l_partkey AS p, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem", lambda t: _with(t, procedures={"net": "|p, d| round(p * (1 - d), 4)"}).lineitem.map("|l| {k: l.l_orderkey, p: l.l_partkey, net: run('net', l.l_extendedprice, l.l_discount)}"))
add("op_closure_call", "SELECT p_partkey AS id, p_size::BIGINT * 2 + 1 AS v FROM part", lambda t: t.part.map("|p| { f = |x| x * 2 + 1; {id: p.p_partkey, v: f.call(p.p_size)} }"))
add("op_errors", "SELECT p_partkey AS id, -60::BIGINT AS code, 'bad' AS msg FROM part", lambda t: t.part.map("|p| {id: p.p_partkey, code: value_err('bad').code(), msg: err(-110, 'bad').msg()}"))
add("op_room_events", "SELECT event_id AS id, value FROM events WHERE event_type = 'purchase' AND value > 50", lambda t: _bought(t))
add("op_room_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL", lambda t: rooms.windowed(t.df("events"), every="1 hour", keys=("event_type",)))
add("op_room_sessions", "SELECT min(ts) AS start, user_id, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT ts, user_id, (coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true))::INT AS new FROM events)) GROUP BY user_id, s", lambda t: rooms.sessions(t.df("events"), keys=("user_id",)).select("start", "user_id", "n"))

# -- whole query texts through the engine
ENGINE_TEXT = {
    "op_slice_tail": ("orders[20:].filter(|o| o.o_totalprice > 100000).map(|o| {id: o.o_orderkey})", "SELECT o_orderkey AS id FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) WHERE r > 20 AND o_totalprice > 100000"),
    "op_set_closure_id": ("a = orders.filter(|o| o.o_orderstatus == 'F') | orders.filter(|o| o.o_totalprice > 200000); a.filter(|o, id| id % 3 == 0).map(|o, id| {id: id, price: o.o_totalprice})", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 200000) AND o_orderkey % 3 = 0"),
    "op_reduce_strings": ("t = nation.filter(|n| n.n_nationkey < 8).map(|n| n.n_name).reduce(|a, x| a + x, ''); nation.map(|n| {id: n.n_nationkey, t: t})", "SELECT n_nationkey::BIGINT AS id, (SELECT string_agg(n_name, '' ORDER BY n_nationkey) FROM nation WHERE n_nationkey < 8) AS t FROM nation"),
    "op_engine_equals": ("x = orders.filter(|o| o.o_totalprice > 200000); a = x.equals(orders.filter(|o| !(o.o_totalprice <= 200000))); b = x.equals(orders); c = x.is_unique(); d = x.len(); nation.map(|n| {id: n.n_nationkey, a: a, b: b, c: c, d: d})", "SELECT n_nationkey::BIGINT AS id, true AS a, false AS b, true AS c, (SELECT count(*) FROM orders WHERE o_totalprice > 200000)::BIGINT AS d FROM nation"),
    "op_engine_try": ("e = try(raise(type_err('bad'))); a = is_err(e); b = e.code(); c = try(1 / 0).code(); d = try(assert(1 > 2)).code(); f = try(raise(value_err('no'))).msg(); g = try([1, 2][5]).code(); nation.map(|n| {id: n.n_nationkey, a: a, b: b, c: c, d: d, f: f, g: g})", "SELECT n_nationkey::BIGINT AS id, true AS a, (-61)::BIGINT AS b, (-58)::BIGINT AS c, (-50)::BIGINT AS d, 'no' AS f, (-54)::BIGINT AS g FROM nation"),
    "op_engine_enum": ("set_enum('Mode', {low: 1, high: 2}); a = Mode{low}.value(); b = Mode(2).name(); c = has_enum('Mode'); d = enum_map('Mode').len(); mod_enum('Mode', 'add', 'mid', 3); e = enum_map('Mode').len(); rename_enum('Mode', 'Level'); f = has_enum('Mode'); g = is_enum(Level{mid}); del_enum('Level'); h = has_enum('Level'); nation.map(|n| {id: n.n_nationkey, a: a, b: b, c: c, d: d, e: e, f: f, g: g, h: h})", "SELECT n_nationkey::BIGINT AS id, 1::BIGINT AS a, 'high' AS b, true AS c, 2::BIGINT AS d, 3::BIGINT AS e, false AS f, true AS g, false AS h FROM nation"),
    "op_engine_types": ("set_type('Pet', {name: 'str', age: 'uint'}); p = Pet{name: 'Rex', age: 4}; a = p.name; b = type(p); c = has_type('Pet'); mod_type('Pet', 'add', 'kind', 'str<0:9:dog>'); q = Pet{name: 'Al', age: 2}; d = q.kind; mod_type('Pet', 'ren', 'kind', 'sort'); e = Pet{name: 'Cy', age: 3}.sort; mod_type('Pet', 'del', 'sort'); f = Pet{name: 'Di', age: 5}.has('sort'); g = new('Pet', {name: 'Bo', age: 1}).age; rename_type('Pet', 'Animal'); h = has_type('Pet'); i = is_thing(p); nation.map(|n| {id: n.n_nationkey, a: a, b: b, c: c, d: d, e: e, f: f, g: g, h: h, i: i})", "SELECT n_nationkey::BIGINT AS id, 'Rex' AS a, 'Pet' AS b, true AS c, 'dog' AS d, 'dog' AS e, false AS f, 1::BIGINT AS g, false AS h, true AS i FROM nation"),
    "op_engine_things": ("o = {x: 1, y: 2}; o.set('z', 3); a = o.len(); b = o.ren('x', 'w'); c = o.has('x'); o.del('y'); d = o.keys().len(); o.assign({y: 9, z: 8}); e = o.z; f = o.get('none', 7); g = o.values().sum(); s = set(o); s.add({k: 1}); h = s.len(); nation.map(|n| {id: n.n_nationkey, a: a, c: c, d: d, e: e, f: f, g: g, h: h})", "SELECT n_nationkey::BIGINT AS id, 3::BIGINT AS a, false AS c, 2::BIGINT AS d, 8::BIGINT AS e, 7::BIGINT AS f, 18::BIGINT AS g, 2::BIGINT AS h FROM nation"),
    "op_engine_lists": ("l = [3, 1, 2]; l.push(5); a = l.pop(); l.unshift(0); b = l.shift(); l[1] = 7; c = l.sum(); l[0:1] = [4, 4]; d = l.len(); l.extend([9]); l.remove(|x| x == 4); e = l.len(); f = 0; for (x, i in l) { if (x == 9) break; f += x * (i + 1); }; g = l.first(); l.clear(); h = l.len(); nation.map(|n| {id: n.n_nationkey, a: a, b: b, c: c, d: d, e: e, f: f, g: g, h: h})", "SELECT n_nationkey::BIGINT AS id, 5::BIGINT AS a, 0::BIGINT AS b, 12::BIGINT AS c, 4::BIGINT AS d, 3::BIGINT AS e, (7 * 1 + 2 * 2)::BIGINT AS f, 7::BIGINT AS g, 0::BIGINT AS h FROM nation"),
    "op_engine_procedures": ("new_procedure('twice', |x| x * 2); a = run('twice', 21); b = has_procedure('twice'); mod_procedure('twice', |x| x * 3); c = run('twice', 21); rename_procedure('twice', 'thrice'); d = has_procedure('twice'); e = procedure_info('thrice').arguments.len(); f = procedures_info().len(); del_procedure('thrice'); g = has_procedure('thrice'); h = is_closure(|x| x); i = |a, b| a - b; j = i.call(7, 2); nation.map(|n| {id: n.n_nationkey, a: a, b: b, c: c, d: d, e: e, g: g, h: h, j: j})", "SELECT n_nationkey::BIGINT AS id, 42::BIGINT AS a, true AS b, 63::BIGINT AS c, false AS d, 1::BIGINT AS e, false AS g, true AS h, 5::BIGINT AS j FROM nation"),
    "op_engine_tasks": ("t = task(datetime().move('days', 5), |t, x| x, [4]); a = is_task(t); b = t.args().len(); t.set_args([5, 6]); c = t.args()[0]; d = tasks().len(); e = is_datetime(t.at()); t.cancel(); t.del(); f = tasks().len(); r = room(); g = is_room(r); nation.map(|n| {id: n.n_nationkey, a: a, b: b, d: d, e: e, f: f, g: g})", "SELECT n_nationkey::BIGINT AS id, true AS a, 1::BIGINT AS b, 1::BIGINT AS d, true AS e, 0::BIGINT AS f, true AS g FROM nation"),
    "op_engine_kinds": ("a = is_nil(nil); b = is_regex(/x/); c = is_tuple([[1]][0]); d = is_future(future(nil)); e = is_timeval(timeval()); f = is_time_zone('Europe/Amsterdam'); g = is_module(1); h = is_mpdata(1); i = type_assert(1, 'int'); j = deep(); k = is_err(zero_div_err()); nation.map(|n| {id: n.n_nationkey, a: a, b: b, c: c, e: e, f: f, g: g, h: h, k: k})", "SELECT n_nationkey::BIGINT AS id, true AS a, true AS b, true AS c, true AS e, true AS f, false AS g, false AS h, true AS k FROM nation"),
    "op_engine_error_codes": ("c64 = cancelled_err('x').code(); c63 = operation_err('x').code(); c62 = num_arguments_err('x').code(); c61 = type_err('x').code(); c60 = value_err('x').code(); c59 = overflow_err('x').code(); c58 = zero_div_err('x').code(); c57 = max_quota_err('x').code(); c56 = auth_err('x').code(); c55 = forbidden_err('x').code(); c54 = lookup_err('x').code(); c53 = bad_data_err('x').code(); c52 = syntax_err('x').code(); c51 = node_err('x').code(); c50 = assert_err('x').code(); nation.map(|n| {id: n.n_nationkey, c64: c64, c63: c63, c62: c62, c61: c61, c60: c60, c59: c59, c58: c58, c57: c57, c56: c56, c55: c55, c54: c54, c53: c53, c52: c52, c51: c51, c50: c50})", "SELECT n_nationkey::BIGINT AS id, (-64)::BIGINT AS c64, (-63)::BIGINT AS c63, (-62)::BIGINT AS c62, (-61)::BIGINT AS c61, (-60)::BIGINT AS c60, (-59)::BIGINT AS c59, (-58)::BIGINT AS c58, (-57)::BIGINT AS c57, (-56)::BIGINT AS c56, (-55)::BIGINT AS c55, (-54)::BIGINT AS c54, (-53)::BIGINT AS c53, (-52)::BIGINT AS c52, (-51)::BIGINT AS c51, (-50)::BIGINT AS c50 FROM nation"),
    "op_engine_relations": ("new_type('A'); new_type('B'); set_type('A', {n: 'int', bs: '{B}'}); set_type('B', {n: 'int', a: 'A?'}); mod_type('B', 'rel', 'a', 'bs'); x = A{n: 1}; y = B{n: 2}; x.bs.add(y); a = y.a.n; z = A{n: 3}; z.bs.add(y); b = x.bs.len(); c = y.a.n; z.bs.remove(y); d = is_nil(y.a); y.a = x; e = x.bs.len(); x.bs.clear(); f = is_nil(y.a); nation.map(|n| {id: n.n_nationkey, a: a, b: b, c: c, d: d, e: e, f: f})", "SELECT n_nationkey::BIGINT AS id, 1::BIGINT AS a, 0::BIGINT AS b, 3::BIGINT AS c, true AS d, 1::BIGINT AS e, true AS f FROM nation"),
    "op_engine_users": ("new_user('ann'); a = has_user('ann'); grant('@admin', 'ann', QUERY); b = user_info('ann').access.len(); rename_user('ann', 'bea'); c = has_user('ann'); d = users_info().len(); k = new_token('bea', nil, 'x'); e = user_info('bea').tokens.len(); revoke('@admin', 'bea', QUERY); del_token(k); f = user_info('bea').tokens.len(); set_password('bea', 'secret1'); del_user('bea'); g = has_user('bea'); nation.map(|n| {id: n.n_nationkey, a: a, b: b, c: c, d: d, e: e, f: f, g: g})", "SELECT n_nationkey::BIGINT AS id, true AS a, 1::BIGINT AS b, false AS c, 2::BIGINT AS d, 1::BIGINT AS e, 0::BIGINT AS f, false AS g FROM nation"),
    "op_engine_collections": ("new_collection('box'); a = has_collection('box'); b = collections_info().len(); rename_collection('box', 'bin'); c = has_collection('bin'); d = collection_info('bin').name; del_collection('bin'); e = has_collection('bin'); f = nodes_info().len(); g = counters().len() > 0; h = has_backup(1); i = backups_info().len(); j = has_module('x'); k = modules_info().len(); nation.map(|n| {id: n.n_nationkey, a: a, b: b, c: c, d: d, e: e, f: f, g: g, h: h, i: i, j: j, k: k})", "SELECT n_nationkey::BIGINT AS id, true AS a, 2::BIGINT AS b, true AS c, 'bin' AS d, false AS e, 1::BIGINT AS f, true AS g, false AS h, 0::BIGINT AS i, false AS j, 0::BIGINT AS k FROM nation"),
    "op_engine_chain": ("orders.filter(|o| o.o_orderstatus == 'F' && o.customer.c_acctbal > least).map(|o| {id: o.o_orderkey, price: o.o_totalprice}).sort(|r| r.price, true)[:50]", "SELECT * FROM (SELECT o_orderkey AS id, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_acctbal > 500 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50)"),
    "op_engine_procedure": ("new_procedure('rich', |cs, x| cs.filter(|c| c.c_acctbal > x)); run('rich', customer, least).map(|c| {id: c.c_custkey, n: c.nation.n_name})", "SELECT c_custkey AS id, n_name AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 500"),
    "op_engine_sets": ("a = orders.filter(|o| o.o_totalprice > 200000); b = orders.filter(|o| o.o_orderstatus == 'O'); ((a | b) - (a & b)).map(|o| {id: o.o_orderkey})", "SELECT o_orderkey AS id FROM orders WHERE (o_totalprice > 200000) <> (o_orderstatus = 'O')"),
    "op_engine_scalar": ("most = orders.max(|o| o.o_totalprice); orders.filter(|o| o.o_totalprice == most).map(|o| {id: o.o_orderkey})", "SELECT o_orderkey AS id FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)"),
    "op_engine_wrap": ("set_type('Brief', {o_orderkey: 'int', o_orderdate: 'datetime', gone: 'str'}); orders.wrap('Brief')", "SELECT o_orderkey, o_orderdate FROM orders"),
}


def _engine(t: Tables, text: str) -> Coll:
    from quillon.runtime.engine import Engine

    engine = Engine()
    for name in ("orders", "customer", "nation", "lineitem", "part", "supplier", "events"):
        engine.bind("stuff", name, getattr(t, name))
    engine.query("set_type('Buyer', {c_custkey: 'int', c_name: 'str', state: 'str<1:9:new>'})")
    engine.bind_type("stuff", "Buyer", t.customer.made(t.customer.rows.withColumn("#", F.col("c_custkey"))))
    return engine.query(text, least=500)


for _name, (_text, _sql) in ENGINE_TEXT.items():
    add(_name, _sql, lambda t, x=_text: _engine(t, x))
# Chance and the clock: their properties.
add("op_random", "SELECT p_partkey AS id, true AS r, true AS i, 4::BIGINT AS s FROM part", lambda t: t.part.map("|p| { r = rand(); i = randint(1, 7); {id: p.p_partkey, r: r >= 0.0 && r < 1.0, i: i >= 1 && i < 7, s: randstr(4).len()} }"))
add("op_now", "SELECT r_regionkey::BIGINT AS id, true AS later, true AS today FROM region", lambda t: t.region.map("|r| {id: r.r_regionkey, later: now() > 0, today: datetime().extract('year') > 2000}"))
add("op_choice", "SELECT n_nationkey::BIGINT AS id, true AS found FROM nation", lambda t: _engine(t, "p = part.map(|p| p.p_size).choice(); found = part.some(|q| q.p_size == p); nation.map(|n| {id: n.n_nationkey, found: found})"))


def _buyers(t: Tables) -> Coll:
    """Customers that dear orders point at, as a set of things under the orders' name of their key."""
    dear = t.orders.filter("|o| o.o_totalprice > 300000").df().select("o_custkey").distinct()
    return Coll(dear, key="o_custkey", is_set=True)


def _bought(t: Tables) -> DataFrame:
    """Events emitted in two rooms, one of which is replayed."""
    path = f"{tables.shared_dir(t.spark)}/rooms-{uuid.uuid4().hex}"
    for room, closure in (("shop", "|e| e.event_type == 'purchase' && e.value > 50"), ("other", "|e| e.event_type == 'click'")):
        rooms.emit(t.events.filter(closure).df(), path, room, "seen", "event_id", "value")
    args = F.from_json("args", "event_id long, value double")
    return rooms.replay(t.spark, path, "shop").select(args.alias("a")).select(F.col("a.event_id").alias("id"), F.col("a.value").alias("value"))


def _with(t: Tables, **known) -> Tables:
    return Tables(t.spark, t.dir, Compiler(**known))


def _typed(t: Tables) -> DataFrame:
    """A table conformed to a type: checks, defaults, and no other columns."""
    types = Types()
    from quillon.runtime.types import Type

    types.types["Customer"] = Type("Customer", types)
    types.types["Customer"].define({"c_custkey": "uint", "c_name": "str<1:64>", "note": "str<0:10:none>", "n": "pint"})
    return types.types["Customer"].conform(t.df("customer"))
