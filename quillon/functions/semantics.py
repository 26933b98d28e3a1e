"""Value rules of the language as Column expressions: kinds, truth, equality, order, arithmetic, guards.

A value inside a plan is a `V`: a Column with its static Spark type. Static types decide
what the language decides by kind at run time, so every rule below is chosen when the plan is built and
stays inside whole-stage code generation. NULL stands for nil.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import BY_NAME, TypeError_

LONG, DOUBLE, BOOL, STR, BIN, NIL, TS = T.LongType(), T.DoubleType(), T.BooleanType(), T.StringType(), T.BinaryType(), T.NullType(), T.TimestampType()
#: A date/time is an instant and, optionally, the name or offset of its zone.
DATETIME = T.StructType([T.StructField("ts", TS), T.StructField("zone", STR)])
ERROR = T.StructType([T.StructField("code", LONG), T.StructField("msg", STR)])
_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType, T.DecimalType)


_UNKNOWN = object()


@dataclass
class V:
    c: Column
    t: T.DataType
    #: The value itself, of literals.
    value: Any = _UNKNOWN

    @property
    def constant(self) -> bool:
        return self.value is not _UNKNOWN

    @property
    def kind(self) -> str:
        return kind_of(self.t)


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NullType):
        return "nil"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, _INTS):
        return "int"
    if isinstance(t, _FLOATS):
        return "float"
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return "str"
    if isinstance(t, T.BinaryType):
        return "bytes"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) or t == DATETIME:
        return "datetime"
    if isinstance(t, T.ArrayType):
        return "list"
    if isinstance(t, T.MapType):
        return "thing"
    if isinstance(t, T.StructType):
        return "error" if t == ERROR else "thing"
    if isinstance(t, T.VariantType):
        return "any"
    return "any"


def fail(name: str, msg: str) -> Column:
    """Raises the named error where it is evaluated."""
    return F.raise_error(F.lit(f"[{BY_NAME[name].code}] {msg}"))


def guard(bad: Column, name: str, msg: str, value: Column) -> Column:
    """value, or the named error where bad holds."""
    return F.when(bad, fail(name, msg)).otherwise(value)


def lit(x: Any) -> V:
    """A literal of the language."""
    out = _lit(x)
    out.value = x
    return out


def _lit(x: Any) -> V:
    if x is None:
        return V(F.lit(None), NIL)
    if isinstance(x, bool):
        return V(F.lit(x), BOOL)
    if isinstance(x, int):
        return V(F.lit(x).cast("bigint"), LONG)
    if isinstance(x, float):
        return V(F.lit(x).cast("double"), DOUBLE)
    if isinstance(x, str):
        return V(F.lit(x), STR)
    if isinstance(x, (bytes, bytearray)):
        return V(F.lit(bytes(x)), BIN)
    if isinstance(x, dt.datetime):
        return V(F.lit(x), TS)
    if isinstance(x, (list, tuple)):
        return list_of([lit(y) for y in x])
    if isinstance(x, dict):
        return thing_of({k: lit(v) for k, v in x.items()})
    raise TypeError_(f"no literal of type {type(x).__name__} inside a table query")


def of_field(c: Column, t: T.DataType) -> V:
    """A table's column, widened to the language's kinds."""
    if isinstance(t, _INTS) and not isinstance(t, T.LongType):
        return V(c.cast("bigint"), LONG)
    if isinstance(t, _FLOATS) and not isinstance(t, T.DoubleType):
        return V(c.cast("double"), DOUBLE)
    if isinstance(t, (T.TimestampNTZType, T.DateType)):
        return V(c.cast("timestamp"), TS)
    return V(c, t)


def common(vs: list[V]) -> T.DataType:
    """The one type that a list of these may have; mixed numbers become float, other mixes are refused."""
    kinds = [v for v in vs if v.kind != "nil"]
    if not kinds:
        return NIL
    if all(v.t == kinds[0].t for v in kinds):
        return kinds[0].t
    names = {v.kind for v in kinds}
    if names <= {"int", "float", "bool"}:
        return DOUBLE if "float" in names else LONG
    if len(names) == 1 and names & {"list", "str"}:
        return kinds[0].t
    raise TypeError_("a list in a table query must have items of one kind")


def as_type(v: V, t: T.DataType) -> Column:
    return v.c if v.t == t else v.c.cast(t)


def list_of(vs: list[V]) -> V:
    t = common(vs)
    return V(F.array(*(as_type(v, t) for v in vs)) if vs else F.array().cast(T.ArrayType(t)), T.ArrayType(t))


def thing_of(fields: dict[str, V]) -> V:
    t = T.StructType([T.StructField(k, v.t) for k, v in fields.items()])
    return V(F.struct(*(v.c.alias(k) for k, v in fields.items())) if fields else F.struct(), t)


def truthy(v: V) -> Column:
    """nil, 0, 0.0, false and empty strings, bytes, lists and things are false; all else is true."""
    k = v.kind
    if k == "nil":
        return F.lit(False)
    if k == "bool":
        return F.coalesce(v.c, F.lit(False))
    if k in ("int", "float"):
        return F.coalesce(v.c != 0, F.lit(False))
    if k in ("str", "bytes"):
        return F.coalesce(F.octet_length(v.c) > 0, F.lit(False))
    if k == "list" or isinstance(v.t, T.MapType):
        return F.coalesce(F.size(v.c) > 0, F.lit(False))
    if isinstance(v.t, T.StructType) and v.t not in (DATETIME, ERROR):
        return v.c.isNotNull() & F.lit(bool(v.t.fields))
    return v.c.isNotNull()


def number(v: V, what: str) -> V:
    if v.kind == "bool":
        return V(v.c.cast("bigint"), LONG)
    if v.kind not in ("int", "float"):
        raise TypeError_(f"`{what}` not supported for a value of type `{v.kind}`")
    return v


def instant(v: V) -> Column:
    return v.c["ts"] if v.t == DATETIME else v.c


def eq(a: V, b: V) -> Column:
    """Never an error, never NULL: numbers across kinds, strings with bytes, instants; other kinds differ."""
    num = {"int", "float", "bool"}
    if a.kind == "nil" or b.kind == "nil":
        return (a.c.isNull() if a.kind != "nil" else F.lit(True)) & (b.c.isNull() if b.kind != "nil" else F.lit(True))
    both_nil = a.c.isNull() & b.c.isNull()
    if a.kind in num and b.kind in num:
        x, y = number(a, "=="), number(b, "==")
        same = x.c.eqNullSafe(y.c)
        nan = F.lit(False)
        for v in (x, y):
            if v.kind == "float":
                nan = nan | F.coalesce(F.isnan(v.c), F.lit(False))
        return same & ~nan
    if {a.kind, b.kind} == {"str", "bytes"}:
        return a.c.cast("binary").eqNullSafe(b.c.cast("binary"))
    if a.kind == b.kind == "datetime":
        return instant(a).eqNullSafe(instant(b))
    if a.kind == b.kind == "error":
        return a.c["code"].eqNullSafe(b.c["code"])
    if a.kind == b.kind == "list" and a.t != b.t and {kind_of(a.t.elementType), kind_of(b.t.elementType)} <= num | {"nil"}:
        return a.c.cast(T.ArrayType(DOUBLE)).eqNullSafe(b.c.cast(T.ArrayType(DOUBLE)))
    if a.kind == b.kind and a.t.simpleString() == b.t.simpleString() and not isinstance(a.t, T.MapType):
        return a.c.eqNullSafe(b.c)
    return both_nil


def comparable(a: V, b: V, op: str) -> tuple[Column, Column]:
    num = {"int", "float", "bool"}
    if a.kind in num and b.kind in num:
        return number(a, op).c, number(b, op).c
    if a.kind == b.kind == "datetime":
        return instant(a), instant(b)
    if a.kind in ("str", "bytes") and b.kind in ("str", "bytes"):
        return (a.c, b.c) if a.kind == b.kind == "str" else (a.c.cast("binary"), b.c.cast("binary"))
    raise TypeError_(f"`{op}` not supported between `{a.kind}` and `{b.kind}`")


def compare(op: str, a: V, b: V) -> V:
    if op == "==":
        return V(eq(a, b), BOOL)
    if op == "!=":
        return V(~eq(a, b), BOOL)
    x, y = comparable(a, b, op)
    out = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    for v in (a, b):  # NaN compares false; Spark puts it last
        if v.kind == "float":
            out = out & ~F.isnan(v.c)
    return V(guard(x.isNull() | y.isNull(), "type_err", f"`{op}` not supported between `nil` and another value", out), BOOL)


def present(op: str, *vs: V) -> Column:
    """Where an operand is nil."""
    bad = F.lit(False)
    for v in vs:
        bad = bad | v.c.isNull()
    return bad


def arith(op: str, a: V, b: V) -> V:
    """ANSI mode raises overflow and division by zero; bool counts as 0 and 1."""
    if op == "+" and a.kind in ("str", "bytes") and a.kind == b.kind:
        return V(F.concat(a.c, b.c), a.t)
    if op in "-&|^" and a.kind == b.kind == "list":
        return set_op(op, a, b)
    x, y = number(a, op), number(b, op)
    if op in ("&", "|", "^", "<<", ">>"):
        if "float" in (x.kind, y.kind):
            raise TypeError_(f"bitwise `{op}` is for integers")
        if op in ("<<", ">>"):
            return V(F.call_function("shiftleft" if op == "<<" else "shiftright", x.c, y.c.cast("int")), LONG)
        return V({"&": x.c.bitwiseAND, "|": x.c.bitwiseOR, "^": x.c.bitwiseXOR}[op](y.c), LONG)
    if op == "%":
        n, d = (v.c if v.kind == "int" else v.c.cast("bigint") for v in (x, y))
        return V(guard(d == 0, "zero_div_err", "division or modulo by zero", F.call_function("mod", n, F.nullif(d, F.lit(0)))), LONG)
    if "float" in (x.kind, y.kind):
        n, d = x.c.cast("double"), y.c.cast("double")
        if op == "/":
            return V(guard(d == 0, "zero_div_err", "division or modulo by zero", n / F.nullif(d, F.lit(0.0))), DOUBLE)
        return V({"+": n + d, "-": n - d, "*": n * d}[op], DOUBLE)
    if op == "/":
        return V(guard(y.c == 0, "zero_div_err", "division or modulo by zero", F.call_function("div", x.c, F.nullif(y.c, F.lit(0)))), LONG)
    return V({"+": x.c + y.c, "-": x.c - y.c, "*": x.c * y.c}[op], LONG)


def set_op(op: str, a: V, b: V) -> V:
    """In-cell sets are arrays without repeats."""
    d = lambda x, y: F.array_except(x, y)
    t = T.ArrayType(common([V(a.c, a.t.elementType), V(b.c, b.t.elementType)]))
    x, y = as_type(a, t), as_type(b, t)
    return V({"-": d(x, y), "&": F.array_intersect(x, y), "|": F.array_union(x, y), "^": F.array_union(d(x, y), d(y, x))}[op], t)


def subset(op: str, a: V, b: V) -> V:
    small, large = (a, b) if op in ("<", "<=") else (b, a)
    inside = F.size(F.array_except(small.c, large.c)) == 0
    return V(inside & (F.size(F.array_distinct(small.c)) < F.size(F.array_distinct(large.c))) if op in ("<", ">") else inside, BOOL)


def either(cond: Column, a: V, b: V) -> V:
    """a where cond holds, else b, in their common type."""
    t = common([a, b])
    return V(F.when(cond, as_type(a, t)).otherwise(as_type(b, t)), t)


def logic(op: str, a: V, b: V) -> V:
    """`&&` and `||` give an operand, not a bool."""
    return either(truthy(a), b, a) if op == "&&" else either(truthy(a), a, b)


def prefix(ops: str, v: V) -> V:
    for o in reversed(ops):
        if o == "!":
            v = V(~truthy(v), BOOL)
        elif o == "~":
            if v.kind not in ("int", "bool"):
                raise TypeError_("`~` is for integers")
            v = V(F.bitwise_not(number(v, "~").c), LONG)
        else:
            n = number(v, o)
            v = V(-n.c, n.t) if o == "-" else n
    return v
