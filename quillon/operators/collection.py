"""Collections in row form: lists and sets of things (or of values) as DataFrames.

Every step gives a new lazy Coll, so a chain of calls is one plan. Terminal calls (`len`, `sum`, `first`, ...) come in two forms: `x.agg_<name>()`
gives a one-row DataFrame, `x.<name>()` the Python value.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import LangError, LookupError_, OperationError, TypeError_, ValueError_, from_spark
from quillon.functions import semantics as S
from quillon.functions.semantics import LONG, V, lit
from quillon.lang.compile import Closure, Compiler
from quillon.lang.parser import Node, parse
from quillon.operators.position import with_position

VALUE = "_v"


class Key:
    """A column of a list order."""

    def __init__(self, c: str | Column, desc: bool = False):
        self.c, self.desc = F.col(c) if isinstance(c, str) else c, desc

    def sorted(self) -> Column:
        return self.c.desc() if self.desc else self.c.asc()

    def flipped(self) -> Key:
        return Key(self.c, not self.desc)


def refs_in(node: Any, names: set[str], refs: dict, found: dict) -> None:
    """Chains a.b where a is one of names and b a reference; `found` nests what lies behind."""
    if isinstance(node, Node):
        path, x = [], node
        while isinstance(x, Node) and x.kind == "prop":
            path.append(x.name)
            x = x.value
        if path and isinstance(x, Node) and x.kind == "var" and x.name in names:
            here, level = refs, found
            for p in reversed(path):
                if p not in here:
                    break
                level = level.setdefault(p, {})
                here = here[p][1].refs
        for v in node.f.values():
            refs_in(v, names, refs, found)
    elif isinstance(node, (list, tuple)):
        for v in node:
            refs_in(v, names, refs, found)


#: Slices up to this end are a top-k; others number the rows by range partitions.
TOP = 100_000


class Coll:
    """rows: a DataFrame. order: columns that define the list order (none: a set). key: the identity column of things.

    refs: name -> (foreign key column, Coll of the things it points at): `x.name` follows it.
    """

    def __init__(self, rows: DataFrame, order: list[str | Column | Key] | None = None, key: str | None = None, refs: dict[str, tuple[str, Coll]] | None = None, compiler: Compiler | None = None, is_set: bool = False):
        self.rows, self.key, self.refs, self.compiler, self.is_set = rows, key, refs or {}, compiler or Compiler(), is_set
        self.order = [o if isinstance(o, Key) else Key(o) for o in order or []]

    def made(self, rows: DataFrame, **change) -> Coll:
        kept = {"order": self.order, "key": self.key, "refs": self.refs, "compiler": self.compiler, "is_set": self.is_set}
        return Coll(rows, **(kept | change))

    @property
    def values(self) -> bool:
        return VALUE in self.rows.columns

    def shown(self) -> list[str]:
        return [c for c in self.rows.columns if not c.startswith("_o")]

    def df(self) -> DataFrame:
        """The rows without hidden columns."""
        return self.rows.select(*(f"`{c}`" for c in self.shown()))

    def item(self) -> V:
        """An item as the closure sees it."""
        if self.values:
            return S.of_field(F.col(VALUE), self.rows.schema[VALUE].dataType)
        return Row({f.name: (F.col(f"`{f.name}`"), f.dataType) for f in self.rows.schema.fields})

    def hidden(self) -> tuple[list[Column], list[Key]]:
        """The order as hidden columns of a new row, and the order by them."""
        return [o.c.alias(f"_o{i}") for i, o in enumerate(self.order)], [Key(f"_o{i}", o.desc) for i, o in enumerate(self.order)]

    def by(self) -> list[Column]:
        return [o.sorted() for o in self.order]

    def ascending(self) -> Coll:
        """The same with an order whose columns can be compared as one struct."""
        return self.numbered() if any(o.desc for o in self.order) else self

    def place(self) -> Column:
        """The order as one struct (ascending() first)."""
        return F.struct(*(o.c.alias(f"k{i}") for i, o in enumerate(self.order)))

    # -- closures
    def fn(self, f: Any) -> Closure:
        return f if isinstance(f, Closure) else self.compiler.closure(f)

    def opened(self, f: Closure) -> Coll:
        """With the things joined that a closure reads through references."""
        found: dict = {}
        if self.refs and f.names:
            refs_in(f.body, {f.names[0]}, self.refs, found)
        out = self
        for name, deeper in found.items():
            out = out.follow(name, deeper)
        return out

    def follow(self, name: str, deeper: dict) -> Coll:
        if name in self.rows.columns:
            return self
        column, other = self.refs[name]
        for inner, rest in deeper.items():
            other = other.follow(inner, rest)
        side = other.rows.select(F.col(other.key).alias("_ok"), F.struct(*(F.col(f"`{c}`") for c in other.shown())).alias(name))
        return self.made(self.rows.join(side, F.col(column) == F.col("_ok"), "left").drop("_ok"))

    def _closed(self, out: Coll) -> Coll:
        """Without columns that only a closure needed."""
        return out.made(out.rows.drop(*(c for c in out.rows.columns if c not in self.rows.columns and not c.startswith("_o"))))

    def value_of(self, f: Closure, here: Coll, *more: V) -> V:
        v = f.apply(here.item(), *more)
        return v.struct() if isinstance(v, Row) else v

    # -- items to items
    def filter(self, f: Any) -> Coll:
        f = self.fn(f)
        if f.arity > 1:
            here, second = self.with_second(f)
            return self._closed(here.made(here.rows.where(S.truthy(f.apply(here.item(), second)))))
        here = self.opened(f)
        return self._closed(here.made(here.rows.where(S.truthy(self.value_of(f, here)))))

    def map(self, f: Any) -> Coll:
        f = self.fn(f)
        here, *second = self.with_second(f) if f.arity > 1 else (self.opened(f),)
        v = self.value_of(f, here, *second)
        hidden, order = here.hidden()
        if isinstance(v.t, T.StructType) and v.t not in (S.DATETIME, S.ERROR):
            return self.made(here.rows.select(*(v.c[x].alias(x) for x in v.t.names), *hidden), order=order, refs={}, key="#" if "#" in v.t.names else None, is_set=False)
        return self.made(here.rows.select(v.c.alias(VALUE), *hidden), order=order, refs={}, key=None, is_set=False)

    def with_second(self, f: Closure) -> tuple[Coll, V]:
        """Opened for a closure of two arguments, and the second one: the index in a list; in a set the id of the thing, or nil."""
        if self.is_set or not self.order:
            return self.opened(f), V(F.col(f"`{self.key}`").cast("long"), LONG) if self.key and self.key != "#" else lit(None)
        return self.numbered().opened(f), V(F.col("_o_pos"), LONG)

    def numbered(self) -> Coll:
        if not self.order:
            raise OperationError("this collection has no order; sort it first")
        return self.made(with_position(self.rows, self.by(), "_o_pos"), order=["_o_pos"])

    def each(self, f: Any) -> None:
        """A closure without side effects has nothing to do; it is compiled so that errors show."""
        f = self.fn(f)
        here = self.opened(f)
        self.value_of(f, here)

    def sort(self, f: Any = None, reverse: bool = False) -> Coll:
        here, keys = self, None
        if f is not None:
            f = self.fn(f)
            if f.arity > 1:
                raise OperationError("rows are sorted by a key; comparators of two arguments serve lists in a cell")
            here = self.opened(f)
            v = self.value_of(f, here)
        else:
            v = self.item()
        a, _ = S.comparable(v, v, "<")
        keys = S.guard(a.isNull(), "type_err", "`<` not supported for `nil`", a)
        rows = here.rows.withColumn("_o_key", keys)
        name = f"_o_key{sum(c.startswith('_o_key') for c in self.rows.columns)}"
        rows = rows.withColumnRenamed("_o_key", name)
        return self.made(rows.select(*(f"`{c}`" for c in self.rows.columns), name), order=[Key(name, reverse), *self.order], is_set=False)

    def reverse(self) -> Coll:
        return self.made(self.rows, order=[o.flipped() for o in self.order])

    def slice(self, start: int | None = None, stop: int | None = None, step: int | None = None) -> Coll:
        step = 1 if step is None else step
        if step == 0:
            raise ValueError_("slice step cannot be zero")
        if not self.order:
            raise OperationError("this collection has no order; sort it first")
        if step == 1 and (start or 0) >= 0 and stop is None:
            if not start:
                return self
            here = self.numbered()
            return here.made(here.rows.where(F.col("_o_pos") >= start))
        if step == 1 and (start or 0) >= 0 and stop is not None and 0 <= stop <= TOP:
            rows = self.rows.orderBy(*self.by())
            rows = rows.offset(start) if start else rows
            return self.made(rows.limit(max(0, stop - (start or 0))))
        n = self.rows.count()
        at = range(*slice(start, stop, step).indices(n))
        here = self.numbered()
        p = F.col("_o_pos")
        lo, hi = (at[0], at[-1]) if step > 0 and len(at) else (at[-1], at[0]) if len(at) else (1, 0)
        keep = (p >= lo) & (p <= hi) & (F.pmod(p - lo, F.lit(abs(step))) == 0)
        return here.made(here.rows.where(keep), order=[Key("_o_pos", step < 0)])

    def unique(self) -> Coll:
        """First occurrences, in order."""
        names = self.shown()
        if not self.order:
            return self.made(self.rows.dropDuplicates(names))
        here = self.ascending()
        rows = here.rows.groupBy(*names).agg(F.min(here.place()).alias("_o_min"))
        return self.made(rows, order=[F.col(f"_o_min.k{i}") for i in range(len(here.order))])

    def flat(self, deep: int = 1) -> Coll:
        out = self
        for _ in range(deep):
            if not (out.values and isinstance(out.rows.schema[VALUE].dataType, T.ArrayType)):
                break
            rows = out.rows.select(*(f"`{c}`" for c in out.rows.columns if c != VALUE), F.posexplode(VALUE).alias("_o_in", VALUE))
            name = f"_of{len(out.order)}"
            out = out.made(rows.withColumnRenamed("_o_in", name), order=[*out.order, Key(name)])
        return out

    def map_id(self) -> Coll:
        hidden, order = self.hidden()
        ids = F.col(self.key) if self.key else F.lit(None)
        return self.made(self.rows.select(ids.cast("bigint").alias(VALUE), *hidden), order=order, refs={}, key=None)

    def wrap(self, view: dict[str, Any]) -> Coll:
        """Only the fields of a view that the things have; a nested dict is a view of what a reference points at."""
        cols, out = [], self
        for name, inner in view.items():
            if isinstance(inner, dict) and name in self.refs:
                out = out.follow(name, {})
                have = out.rows.schema[name].dataType.names
                cols.append(F.when(F.col(name).isNotNull(), F.struct(*(F.col(f"{name}.{x}") for x in inner if x in have))).alias(name))
            elif name in self.rows.columns:
                cols.append(F.col(f"`{name}`"))
        hidden, order = self.hidden()
        return self.made(out.rows.select(*cols, *hidden), order=order, refs={})

    map_wrap = wrap

    def copy(self) -> Coll:
        return self

    dup = copy

    # -- sets, lists
    def _ident(self, other: Coll) -> list[str]:
        if self.key and other.key:
            return [self.key]
        return self.shown()

    def _named_as(self, other: Coll) -> Coll:
        """The other side with its identity named as here."""
        if not self.key or not other.key or self.key == other.key:
            return other
        return other.made(other.df().drop(self.key).withColumnRenamed(other.key, self.key), order=[], key=self.key)

    def union(self, other: Coll) -> Coll:
        other = self._named_as(other)
        return self.made(self.df().unionByName(other.df(), allowMissingColumns=bool(self.key)).dropDuplicates(self._ident(other)), order=[], is_set=True)

    def intersect(self, other: Coll) -> Coll:
        other = self._named_as(other)
        on = self._ident(other)
        return self.made(self.df().join(other.df().select(*on).distinct(), _null_safe(self, other, on), "left_semi") if len(on) > 1 else self.df().join(other.df().select(*on), on, "left_semi"), order=[], is_set=True)

    def difference(self, other: Coll) -> Coll:
        other = self._named_as(other)
        on = self._ident(other)
        return self.made(self.df().exceptAll(other.df()) if len(on) > 1 else self.df().join(other.df().select(*on), on, "left_anti"), order=[], is_set=True)

    def symmetric(self, other: Coll) -> Coll:
        other = self._named_as(other)
        a, b = self.difference(other), other.difference(self)
        return self.made(a.df().unionByName(b.df(), allowMissingColumns=bool(self.key)), order=[], is_set=True)

    def subset_of(self, other: Coll, proper: bool = False) -> bool:
        if self.difference(other).rows.limit(1).count():
            return False
        return not proper or bool(other.difference(self).rows.limit(1).count())

    def equals(self, other: Any) -> bool:
        """Equal items as often; in lists at equal places, too."""
        if not isinstance(other, Coll) or sorted(self.shown()) != sorted(other.shown()):
            return False
        a, b = (x.numbered() if self.order and other.order else x for x in (self, other))
        names = [*self.shown(), *(["_o_pos"] if self.order and other.order else [])]
        a, b = (x.rows.select(*(F.col(f"`{c}`") for c in names)) for x in (a, b))
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    def clear(self) -> Coll:
        return self.made(self.rows.limit(0))

    def extend(self, other: Coll) -> Coll:
        """Other's items behind these."""
        a, b = (x.numbered().rows.select(*(f"`{c}`" for c in x.shown()), F.lit(i).alias("_o_side"), F.col("_o_pos").alias("_o_row")) for i, x in enumerate((self, other)))
        return self.made(a.unionByName(b), order=["_o_side", "_o_row"])

    def extend_unique(self, other: Coll) -> Coll:
        names = self.shown()
        new = other.unique()
        return self.extend(new.made(new.rows.join(self.df().distinct(), names, "left_anti")))

    def remove(self, f: Any, limit: int | None = None) -> tuple[Coll, Coll]:
        """(what stays, what was removed); the limit counts from the front, a negative one from the end."""
        f = self.fn(f)
        if limit is None:
            here = self.opened(f)
            yes = S.truthy(self.value_of(f, here))
            return self._closed(here.made(here.rows.where(~yes))), self._closed(here.made(here.rows.where(yes)))
        here = self.numbered()
        hits = here.filter(f)
        gone = hits.made(hits.rows.orderBy(F.col("_o_pos").asc() if limit >= 0 else F.col("_o_pos").desc()).limit(abs(limit)), order=["_o_pos"])
        return here.made(here.rows.join(gone.rows.select("_o_pos"), "_o_pos", "left_anti"), order=["_o_pos"]), gone

    def splice(self, at: int, n: int, new: Coll | None = None) -> tuple[Coll, Coll]:
        """(what is left, with new items in place; what was removed)."""
        size = self.rows.count()
        at = max(0, min(size, at + size if at < 0 else at))
        here = self.numbered()
        p = F.col("_o_pos")
        gone = here.made(here.rows.where((p >= at) & (p < at + n)), order=["_o_pos"])
        head, tail = (here.made(here.rows.where(w), order=["_o_pos"]) for w in (p < at, p >= at + n))
        parts = [head, *([new] if new else []), tail]
        out = parts[0]
        for x in parts[1:]:
            out = out.extend(x)
        return out, gone

    def fill(self, value: Any) -> Coll:
        v = lit(value)
        hidden, order = self.hidden()
        return self.made(self.rows.select(v.c.alias(VALUE), *hidden), order=order, refs={}, key=None)

    # -- to one value: one-row frames
    def _agg(self, c: Column) -> DataFrame:
        return self.rows.agg(c.alias("value"))

    def _body(self, f: Any) -> tuple[Coll, V]:
        if f is None:
            return self, self.item()
        f = self.fn(f)
        here = self.opened(f)
        return here, self.value_of(f, here)

    def agg_len(self) -> DataFrame:
        return self._agg(F.count(F.lit(1)))

    def agg_count(self, f: Any) -> DataFrame:
        if isinstance(f, Closure):
            here, v = self._body(f)
            return here._agg(F.count_if(S.truthy(v)))
        return self._agg(F.count_if(S.eq(self.item(), lit(f))))

    def agg_sum(self, f: Any = None) -> DataFrame:
        here, v = self._body(f)
        n = S.number(v, "+")
        zero = F.lit(0).cast(n.t)
        return here._agg(F.coalesce(F.sum(S.guard(n.c.isNull(), "type_err", "`+` not supported for `nil`", n.c)), zero))

    def _best(self, f: Any, best) -> DataFrame:
        here, v = self._body(f)
        a, _ = S.comparable(v, v, "<")
        got = best(S.guard(a.isNull(), "type_err", "`<` not supported for `nil`", a))
        return here._agg(S.guard(F.count(F.lit(1)) == 0, "lookup_err", "list is empty", got))

    def agg_min(self, f: Any = None) -> DataFrame:
        return self._best(f, F.min)

    def agg_max(self, f: Any = None) -> DataFrame:
        return self._best(f, F.max)

    def agg_some(self, f: Any) -> DataFrame:
        here, v = self._body(f)
        return here._agg(F.coalesce(F.bool_or(S.truthy(v)), F.lit(False)))

    def agg_every(self, f: Any) -> DataFrame:
        here, v = self._body(f)
        return here._agg(F.coalesce(F.bool_and(S.truthy(v)), F.lit(True)))

    def agg_has(self, x: Any) -> DataFrame:
        v = V(F.col(self.key), LONG) if self.key and not self.values else self.item()
        return self._agg(F.coalesce(F.bool_or(S.eq(v, lit(x))), F.lit(False)))

    def agg_is_unique(self) -> DataFrame:
        groups = self.df().groupBy(*self.shown()).count()
        return groups.agg((F.coalesce(F.max("count"), F.lit(0)) <= 1).alias("value"))

    def agg_find_index(self, f: Any) -> DataFrame:
        """Rows before the first hit: two aggregates, no global numbering."""
        f = self.fn(f)
        here = self.ascending().opened(f)
        yes = S.truthy(self.value_of(f, here))
        rows = here.rows.select(here.place().alias("k"), yes.alias("yes"))
        first = rows.where("yes").agg(F.min("k").alias("first"))
        return rows.crossJoin(F.broadcast(first)).agg(F.when(F.max("first").isNotNull(), F.count_if(F.col("k") < F.col("first"))).alias("value"))

    def agg_index_of(self, x: Any) -> DataFrame:
        return self.agg_find_index(Constant(self.compiler, lambda v: V(S.eq(v, lit(x)), S.BOOL)))

    def agg_reduce(self, f: Any, init: Any = None) -> DataFrame:
        """Left fold. Where the closure adds, multiplies or combines bits or truths of its items, the fold is an aggregate
        with partial results in every task; other folds need the order, and run in one place over the items."""
        f = self.fn(f)
        if f.arity >= 2 and init is not None and (quick := self._associative(f, init)) is not None:
            return quick
        here = self.ascending()
        item = here.item()
        item = item.struct() if isinstance(item, Row) else item
        keys = F.struct(here.place().alias("k"), item.c.alias("v"))
        packed = here.rows.agg(F.transform(F.sort_array(F.collect_list(keys)), lambda x: x["v"]).alias("items"))
        from quillon.functions.columns import CHAIN

        v = CHAIN["reduce"](V(F.col("items"), T.ArrayType(item.t)), [f, *([lit(init)] if init is not None else [])], self.compiler)
        return packed.select(v.c.alias("value"))

    def _associative(self, f: Closure, init: Any) -> DataFrame | None:
        b = f.body
        while b.kind in ("paren",) or (b.kind == "block" and len(b.body) == 1):
            b = b.value if b.kind == "paren" else b.body[0]
        if b.kind != "binary" or b.op not in "+*&|^" or b.left.kind != "var" or b.left.name != f.names[0]:
            return None
        one = Closure([f.names[1]], b.right, f.env, f.compiler)
        if _mentions(b.right, f.names[0]) or len(f.names) > 2:
            return None
        here = self.opened(one)
        v, start = self.value_of(one, here), lit(init)
        if not {v.kind, start.kind} <= {"int", "float", "bool"}:
            return None  # strings and lists are added in order
        v = S.number(v, b.op)
        agg = {"+": F.sum, "&": F.bit_and, "|": F.bit_or, "^": F.bit_xor, "*": F.product}[b.op](v.c)
        if b.op == "*" and (v.kind == "int" or start.kind == "int"):
            return None
        total = S.arith(b.op, start, V(agg, v.t))
        return here._agg(F.when(F.count(F.lit(1)) == 0, start.c.cast(total.t)).otherwise(total.c))

    def agg_join(self, sep: str = "") -> DataFrame:
        """Strings in order; a text as long as the whole list is one cell."""
        if S.kind_of(self.rows.schema[VALUE].dataType) != "str":
            raise TypeError_("expecting a list of strings")
        here = self.ascending()
        keys = F.struct(here.place().alias("k"), F.col(VALUE).alias("v"))
        return here._agg(F.array_join(F.transform(F.sort_array(F.collect_list(keys)), lambda x: x["v"]), sep))

    # -- to one value: Python
    def _one(self, df: DataFrame) -> Any:
        try:
            return df.first()["value"]
        except LangError:
            raise
        except Exception as e:
            if (x := from_spark(e)) is not None:
                raise x from e
            raise

    def __getattr__(self, name: str) -> Any:
        if not name.startswith("_") and hasattr(type(self), "agg_" + name):
            return lambda *a, **b: self._one(getattr(self, "agg_" + name)(*a, **b))
        raise AttributeError(name)

    def list(self) -> list:
        rows = (self.rows.orderBy(*self.by()) if self.order else self.rows).select(*(f"`{c}`" for c in self.shown())).collect()
        return [r[VALUE] for r in rows] if self.values else [r.asDict(recursive=True) for r in rows]

    def find(self, f: Any, default: Any = None) -> Any:
        hits = self.filter(f)
        got = (hits.slice(0, 1) if self.order else hits.made(hits.rows.limit(1))).list()
        return got[0] if got else default

    def first(self, *default: Any) -> Any:
        got = self.slice(0, 1).list()
        return got[0] if got else self._default(default)

    def last(self, *default: Any) -> Any:
        got = self.reverse().slice(0, 1).list()
        return got[0] if got else self._default(default)

    def one(self) -> Any:
        got = self.made(self.rows.limit(1), order=[]).list()
        return got[0] if got else self._default(())

    def choice(self) -> Any:
        got = self.made(self.rows.orderBy(F.rand()).limit(1), order=[]).list()
        return got[0] if got else self._default(())

    def _default(self, default: tuple) -> Any:
        if default:
            return default[0]
        raise LookupError_("list is empty")


class Row(V):
    """A thing of a table: its fields are the columns themselves, so that pruning works."""

    def __init__(self, columns: dict[str, tuple[Column, T.DataType]]):
        self.columns = {k: v for k, v in columns.items() if not k.startswith("_o")}
        super().__init__(_Fields(self.columns), T.StructType([T.StructField(k, t) for k, (_, t) in self.columns.items()]))

    def struct(self) -> V:
        return V(F.struct(*(c.alias(k) for k, (c, _) in self.columns.items())), self.t)


class _Fields:
    """Stands for the struct of a row; indexing gives the column."""

    def __init__(self, columns: dict[str, tuple[Column, T.DataType]]):
        self.columns = columns

    def __getitem__(self, name: str) -> Column:
        return self.columns[name][0]

    def __getattr__(self, name: str) -> Any:
        return getattr(F.struct(*(c.alias(k) for k, (c, _) in self.columns.items())), name)


class Constant(Closure):
    """A Python function in a closure's place."""

    def __init__(self, compiler: Compiler, f):
        super().__init__(["x"], parse("nil").body[0], {}, compiler)
        self.f = f

    def apply(self, *values: V) -> V:
        return self.f(values[0])


def _mentions(node: Any, name: str) -> bool:
    if isinstance(node, Node):
        return (node.kind == "var" and node.name == name) or any(_mentions(v, name) for v in node.f.values())
    return any(_mentions(v, name) for v in node) if isinstance(node, (list, tuple)) else False


def _null_safe(a: Coll, b: Coll, on: list[str]) -> Column:
    cond = F.lit(True)
    for c in on:
        cond = cond & a.rows[c].eqNullSafe(b.rows[c])
    return cond
