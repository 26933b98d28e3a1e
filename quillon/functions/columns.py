"""The language's built-in functions as Column expressions over V (see semantics).

`CHAIN[name](receiver, args, compiler)` serve `x.name(...)`, `ROOT[name](args, compiler)` serve `name(...)`. Closures arrive as
Closure objects whose `apply(*V)` inlines their body.
"""

from __future__ import annotations

import math
import zoneinfo
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import CODES, LookupError_, NumArgumentsError, TypeError_, ValueError_
from quillon.functions.semantics import BIN, BOOL, DATETIME, DOUBLE, ERROR, LONG, NIL, STR, TS, V, as_type, comparable, common, either, eq, fail, guard, instant, kind_of, list_of, lit, number, truthy

CHAIN: dict[str, Callable] = {}
ROOT: dict[str, Callable] = {}

#: White space of the C locale, and the patterns that the address predicates accept.
SPACE = r"[ \t\n\x0B\f\r]"
EMAIL = r"^[a-zA-Z0-9.!#$%&’*+/=?^_`{|}~-]+@[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)*$"
URL = r"^(https?|ftp):\/\/[-a-zA-Z0-9@:%._\+~#=]{1,256}\b([-a-zA-Z0-9@:%_\+.~#?&//=]*)$"
TEL = r"^[\+]?(\([0-9]{1,4}\)[-\s\.]?){0,2}([0-9]{1,4}[-\s]?){3,5}$"


def chain(*names: str, args: tuple[int, int] | None = None):
    def put(f):
        for n in names:
            CHAIN[n] = _counted(n, f, args, 1)
        return f

    return put


def root(*names: str, args: tuple[int, int] | None = None):
    def put(f):
        for n in names:
            ROOT[n] = _counted(n, f, args, 0)
        return f

    return put


def _counted(name, f, args, at):
    def run(*a):
        given = len(a[at])
        if args and not args[0] <= given <= args[1]:
            raise NumArgumentsError(f"function `{name}` takes {args[0]} to {args[1]} arguments but {given} were given")
        return f(*a)

    return run


def need(v: V, *kinds: str) -> V:
    if v.kind not in kinds:
        raise TypeError_(f"expecting type `{'` or `'.join(kinds)}` but got type `{v.kind}` instead")
    return v


def elem(v: V, c: Column) -> V:
    return V(c, v.t.elementType)


def fits(f, *vs: V) -> V:
    """Applies a closure with as many of the values as it takes."""
    return f.apply(*vs)


def _kept(v: V, f) -> Callable:
    return lambda x, i: truthy(fits(f, elem(v, x), V(i.cast("bigint"), LONG)))


def _entries(v: V) -> V:
    """A thing as a map, if its values have one kind."""
    if isinstance(v.t, T.MapType):
        return v
    t = common([V(v.c[f.name], f.dataType) for f in v.t.fields])
    return V(F.create_map(*[x for f in v.t.fields for x in (F.lit(f.name), as_type(V(v.c[f.name], f.dataType), t))]), T.MapType(STR, t))


# -- collections ---------------------------------------------------------------------------------------------------------


@chain("filter", args=(1, 1))
def _filter(v, a, _):
    if v.kind == "list":
        return V(F.filter(v.c, _kept(v, a[0])), v.t)
    m = _entries(need(v, "thing"))
    return V(F.map_filter(m.c, lambda k, x: truthy(fits(a[0], V(k, STR), V(x, m.t.valueType)))), m.t)


def typed_transform(v: V, f) -> V:
    """array of f's results; their type is found while the plan is built."""
    seen = []

    def body(x, i):
        r = fits(f, elem(v, x), V(i.cast("bigint"), LONG))
        seen.append(r.t)
        return r.c

    out = F.transform(v.c, body)
    return V(out, T.ArrayType(seen[-1]))


@chain("map", args=(1, 1))
def _map(v, a, _):
    if v.kind == "list":
        return typed_transform(v, a[0])
    m = _entries(need(v, "thing"))
    seen = []

    def body(e):
        r = fits(a[0], V(e["key"], STR), V(e["value"], m.t.valueType))
        seen.append(r.t)
        return r.c

    return V(F.transform(F.map_entries(m.c), body), T.ArrayType(seen[-1]))


@chain("vmap", args=(1, 1))
def _vmap(v, a, _):
    m = _entries(need(v, "thing"))
    seen = []

    def body(k, x):
        r = fits(a[0], V(x, m.t.valueType))
        seen.append(r.t)
        return r.c

    return V(F.transform_values(m.c, body), T.MapType(STR, seen[-1]))


@chain("each", args=(1, 1))
def _each(v, a, _):
    return lit(None)


@chain("reduce", args=(1, 2))
def _reduce(v, a, _):
    need(v, "list")
    init = a[1] if len(a) > 1 else elem(v, F.get(v.c, F.lit(0)))
    t = fits(a[0], init, elem(v, F.get(v.c, F.lit(0))), lit(0)).t
    t = common([init, V(F.lit(None), t)])
    items = v.c if len(a) > 1 else F.slice(v.c, 2, F.greatest(F.size(v.c) - 1, F.lit(0)))
    shift = 0 if len(a) > 1 else 1
    pairs = F.transform(items, lambda x, i: F.struct(x.alias("x"), (i + shift).cast("bigint").alias("i")))
    out = F.aggregate(pairs, as_type(init, t), lambda acc, p: as_type(fits(a[0], V(acc, t), elem(v, p["x"]), V(p["i"], LONG)), t))
    return V(out if len(a) > 1 else guard(F.size(v.c) == 0, "lookup_err", "reduce on empty list with no initial value", out), t)


@chain("find", args=(1, 2))
def _find(v, a, _):
    hit = F.filter(need(v, "list").c, _kept(v, a[0]))
    found = elem(v, F.get(hit, F.lit(0)))
    return either(F.size(hit) > 0, found, a[1] if len(a) > 1 else lit(None))


@chain("find_index", args=(1, 1))
def _find_index(v, a, _):
    keep = _kept(need(v, "list"), a[0])
    return V(F.nullif(F.array_position(F.transform(v.c, keep), F.lit(True)) - 1, F.lit(-1).cast("bigint")), LONG)


@chain("index_of", args=(1, 1))
def _index_of(v, a, _):
    hits = F.transform(need(v, "list").c, lambda x: eq(elem(v, x), a[0]))
    return V(F.nullif(F.array_position(hits, F.lit(True)) - 1, F.lit(-1).cast("bigint")), LONG)


@chain("some", args=(1, 1))
def _some(v, a, _):
    return V(F.exists(need(v, "list").c, lambda x: truthy(fits(a[0], elem(v, x)))), BOOL)


@chain("every", args=(1, 1))
def _every(v, a, _):
    return V(F.forall(need(v, "list").c, lambda x: truthy(fits(a[0], elem(v, x)))), BOOL)


@chain("has", args=(1, 1))
def _has(v, a, _):
    if v.kind == "list":
        return V(F.exists(v.c, lambda x: eq(elem(v, x), a[0])), BOOL)
    if isinstance(v.t, T.MapType):
        return V(F.map_contains_key(v.c, a[0].c), BOOL)
    return V(F.array_contains(F.array(*(F.lit(f.name) for f in v.t.fields)), a[0].c), BOOL)


@chain("contains", args=(1, 1))
def _contains(v, a, _):
    return V(F.contains(need(v, "str").c, need(a[0], "str").c), BOOL)


@chain("keys", args=(0, 0))
def _keys(v, a, _):
    need(v, "thing")
    return V(F.map_keys(v.c) if isinstance(v.t, T.MapType) else F.array(*(F.lit(f.name) for f in v.t.fields)), T.ArrayType(STR))


@chain("values", args=(0, 0))
def _values(v, a, _):
    m = _entries(need(v, "thing"))
    return V(F.map_values(m.c), T.ArrayType(m.t.valueType))


@chain("get", args=(1, 2))
def _get(v, a, comp):
    other = a[1] if len(a) > 1 else lit(None)
    if isinstance(v.t, T.MapType):
        return either(F.map_contains_key(v.c, a[0].c), V(F.try_element_at(v.c, a[0].c), v.t.valueType), other)
    name = comp.constant(a[0])
    f = next((f for f in need(v, "thing").t.fields if f.name == name), None)
    return V(v.c[f.name], f.dataType) if f else other


@chain("len", args=(0, 0))
def _len(v, a, _):
    if v.kind in ("str", "bytes"):
        return V(F.octet_length(v.c).cast("bigint"), LONG)
    if v.kind == "list" or isinstance(v.t, T.MapType):
        return V(F.size(v.c).cast("bigint"), LONG)
    return lit(len(need(v, "thing").t.fields))


@chain("flat", args=(0, 1))
def _flat(v, a, comp):
    for _i in range(comp.constant(a[0]) if a else 1):
        if not isinstance(need(v, "list").t.elementType, T.ArrayType):
            break
        v = V(F.flatten(v.c), v.t.elementType)
    return v


@chain("copy", "dup", args=(0, 1))
def _copy(v, a, _):
    return v


@chain("map_id", args=(0, 0))
def _map_id(v, a, _):
    t = need(v, "list").t.elementType
    has = isinstance(t, T.StructType) and "#" in t.names
    return V(F.transform(v.c, lambda x: x["#"] if has else F.lit(None).cast("bigint")), T.ArrayType(LONG))


@chain("first", args=(0, 1))
def _first(v, a, _):
    return _end(v, a, F.get(need(v, "list").c, F.lit(0)))


@chain("last", args=(0, 1))
def _last(v, a, _):
    return _end(v, a, F.get(need(v, "list").c, F.size(v.c) - 1))


def _end(v, a, c):
    if a:
        return either(F.size(v.c) > 0, elem(v, c), a[0])
    return elem(v, guard(F.size(v.c) == 0, "lookup_err", "list is empty", c))


@chain("one", args=(0, 0))
def _one(v, a, _):
    return elem(v, guard(F.size(need(v, "list").c) == 0, "lookup_err", "set is empty", F.get(v.c, F.lit(0))))


@chain("choice", args=(0, 0))
def _choice(v, a, _):
    return elem(v, guard(F.size(need(v, "list").c) == 0, "lookup_err", "choice from empty list", F.get(F.shuffle(v.c), F.lit(0))))


@chain("equals", args=(1, 2))
def _equals(v, a, _):
    return V(eq(v, a[0]), BOOL)


@chain("count", args=(1, 1))
def _count(v, a, _):
    test = (lambda x: truthy(fits(a[0], elem(v, x)))) if not isinstance(a[0], V) else (lambda x: eq(elem(v, x), a[0]))
    return V(F.size(F.filter(need(v, "list").c, test)).cast("bigint"), LONG)


@chain("sum", args=(0, 1))
def _sum(v, a, _):
    items = typed_transform(need(v, "list"), a[0]) if a else v
    if kind_of(items.t.elementType) == "nil":
        return lit(0)
    zero = number(V(F.lit(0), items.t.elementType), "+")
    t = DOUBLE if zero.kind == "float" else LONG
    return V(F.aggregate(items.c, F.lit(0).cast(t), lambda acc, x: acc + guard(x.isNull(), "type_err", "`+` not supported for `nil`", x.cast(t))), t)


def _extreme(v, best):
    """Scanned from the last item; on ties the last one stays."""
    t = need(v, "list").t.elementType
    comparable(V(F.lit(None), t), V(F.lit(None), t), "<")
    out = F.aggregate(F.reverse(v.c), elem(v, F.element_at(v.c, -1)).c, lambda acc, x: F.when(best(x, acc), x).otherwise(acc))
    return elem(v, F.when(F.size(v.c) == 0, fail("lookup_err", "list is empty")).when(F.exists(v.c, lambda x: x.isNull()), fail("type_err", "`<` not supported for `nil`")).otherwise(out))


@chain("min", args=(0, 0))
def _min(v, a, _):
    return _extreme(v, lambda x, y: x < y)


@chain("max", args=(0, 0))
def _max(v, a, _):
    return _extreme(v, lambda x, y: x > y)


@chain("unique", args=(0, 0))
def _unique(v, a, _):
    return V(F.array_distinct(need(v, "list").c), v.t)


@chain("is_unique", args=(0, 0))
def _is_unique(v, a, _):
    return V(F.size(need(v, "list").c) == F.size(F.array_distinct(v.c)), BOOL)


@chain("sort", args=(0, 2))
def _sort(v, a, comp):
    """Stable; a closure of one argument is a key, of two a comparator."""
    need(v, "list")
    f = a[0] if a and not isinstance(a[0], V) else None
    rev = comp.constant(a[-1]) if a and isinstance(a[-1], V) else False
    t = v.t.elementType
    if f is not None and f.arity == 2:
        order = lambda x, y: number(fits(f, elem(v, x["v"]), elem(v, y["v"])), "sort").c.cast("int")
    else:
        key = (lambda x: fits(f, elem(v, x))) if f else (lambda x: elem(v, x))

        def order(x, y):
            p, q = comparable(key(x["v"]), key(y["v"]), "<")
            return F.when(p.isNull() | q.isNull(), fail("type_err", "`<` not supported for `nil`").cast("int")).when(p < q, -1).when(p > q, 1).otherwise(0)

    sign = -1 if rev else 1
    rows = F.transform(v.c, lambda x, i: F.struct(x.alias("v"), i.alias("i")))
    done = F.array_sort(rows, lambda x, y: F.when(order(x, y) != 0, order(x, y) * sign).otherwise(F.when(x["i"] < y["i"], -1).when(x["i"] > y["i"], 1).otherwise(0)))
    return V(F.transform(done, lambda x: x["v"]), T.ArrayType(t))


@chain("reverse", args=(0, 0))
def _reverse(v, a, _):
    return V(F.reverse(need(v, "list").c), v.t)


@root("range", args=(1, 3))
def _range(a, comp):
    start, stop, step = (lit(0).c, a[0].c, F.lit(1).cast("bigint")) if len(a) == 1 else (a[0].c, a[1].c, a[2].c if len(a) > 2 else F.lit(1).cast("bigint"))
    n = F.ceil((stop - start).cast("double") / step).cast("bigint")
    many = guard(n > 100_000, "operation_err", "maximum range length exceeded", n)
    out = F.when(many <= 0, F.array().cast("array<bigint>")).otherwise(F.sequence(start, start + (n - 1) * step, step))
    return V(guard(step == 0, "value_err", "step value must not be zero", out), T.ArrayType(LONG))


def _joined(v: V, *parts: V) -> V:
    t = T.ArrayType(common([V(F.lit(None), p.t.elementType) for p in (v, *parts)]))
    return V(F.concat(*(as_type(p, t) for p in (v, *parts))), t)


@chain("push")
def _push(v, a, _):
    return _joined(need(v, "list"), list_of(list(a)))


@chain("unshift")
def _unshift(v, a, _):
    return _joined(list_of(list(a)), need(v, "list"))


@chain("pop", args=(0, 0))
def _pop(v, a, _):
    return elem(v, guard(F.size(need(v, "list").c) == 0, "lookup_err", "pop from empty list", F.get(v.c, F.size(v.c) - 1)))


@chain("shift", args=(0, 0))
def _shift(v, a, _):
    return elem(v, guard(F.size(need(v, "list").c) == 0, "lookup_err", "shift from empty list", F.get(v.c, F.lit(0))))


def spliced(v: V, idx: Column, n: Column, new: list[V]) -> tuple[V, V]:
    """(the removed items, the list that is left)."""
    size = F.size(v.c)
    at = F.greatest(F.least(F.when(idx < 0, size + idx).otherwise(idx), size), F.lit(0)).cast("int")
    count = F.greatest(F.least(n, size - at), F.lit(0)).cast("int")
    head, tail = F.slice(v.c, F.lit(1), at), F.slice(v.c, at + count + 1, F.greatest(size - at - count, F.lit(0)))
    return V(F.slice(v.c, at + 1, count), v.t), _joined(V(head, v.t), *([list_of(new)] if new else []), V(tail, v.t))


@chain("splice")
def _splice(v, a, _):
    return spliced(need(v, "list"), a[0].c, a[1].c, list(a[2:]))[0]


@chain("extend", args=(1, 1))
def _extend(v, a, _):
    return _joined(need(v, "list"), need(a[0], "list"))


@chain("extend_unique", args=(1, 1))
def _extend_unique(v, a, _):
    new = F.array_distinct(F.filter(need(a[0], "list").c, lambda x: ~F.exists(v.c, lambda y: eq(elem(v, y), elem(a[0], x)))))
    return _joined(need(v, "list"), V(new, a[0].t))


@chain("fill", args=(1, 1))
def _fill(v, a, _):
    return V(F.transform(need(v, "list").c, lambda _x: a[0].c), T.ArrayType(a[0].t))


@chain("remove", args=(1, 2))
def _remove(v, a, _):
    hit = F.filter(need(v, "list").c, _kept(v, a[0]))
    if len(a) < 2:
        return V(hit, v.t)
    n = a[1].c.cast("int")
    return V(F.when(n >= 0, F.slice(hit, F.lit(1), F.greatest(n, F.lit(0)))).otherwise(F.reverse(F.slice(F.reverse(hit), F.lit(1), F.greatest(-n, F.lit(0))))), v.t)


@chain("clear", args=(0, 0))
def _clear(v, a, _):
    return V(F.array().cast(v.t), v.t) if v.kind == "list" else lit(None)


@chain("join", args=(0, 1))
def _join(v, a, _):
    if kind_of(need(v, "list").t.elementType) not in ("str", "nil"):
        raise TypeError_("expecting a list of strings")
    sep = a[0].c if a else F.lit("")
    parts = F.transform(v.c, lambda x: guard(x.isNull(), "type_err", "expecting a list of strings", x))
    return V(F.aggregate(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(sep, x))), F.lit(""), lambda acc, x: F.concat(acc, x)), STR)


@root("set")
def _set(a, comp):
    if not a:
        return list_of([])
    v = a[0] if a[0].kind == "list" else list_of(list(a))
    return V(F.array_distinct(v.c), v.t)


@chain("add")
def _add(v, a, _):
    return V(F.array_union(need(v, "list").c, list_of(list(a)).c), v.t)


@root("list", args=(0, 1))
def _list(a, comp):
    return need(a[0], "list") if a else list_of([])


# -- things ------------------------------------------------------------------------------------------------------------


@root("thing", args=(0, 1))
def _thing(a, comp):
    return a[0] if a else V(F.create_map().cast(T.MapType(STR, STR)), T.MapType(STR, STR))


@chain("assign", args=(1, 1))
def _assign(v, a, _):
    if isinstance(v.t, T.StructType) and isinstance(a[0].t, T.StructType):
        fields = {f.name: V(v.c[f.name], f.dataType) for f in v.t.fields} | {f.name: V(a[0].c[f.name], f.dataType) for f in a[0].t.fields}
        return V(F.struct(*(x.c.alias(k) for k, x in fields.items())), T.StructType([T.StructField(k, x.t) for k, x in fields.items()]))
    m, n = _entries(v), _entries(a[0])
    old = F.map_filter(m.c, lambda k, _x: ~F.map_contains_key(n.c, k))
    return V(F.map_concat(old, n.c), m.t)


@chain("del", args=(1, 1))
def _del(v, a, comp):
    return _get(v, a, comp)


@chain("ren", args=(2, 2))
def _ren(v, a, comp):
    if isinstance(v.t, T.MapType):
        return V(F.transform_keys(v.c, lambda k, _x: F.when(k == a[0].c, a[1].c).otherwise(k)), v.t)
    old, new = comp.constant(a[0]), comp.constant(a[1])
    if old not in need(v, "thing").t.names:
        raise LookupError_(f"no property `{old}`")
    t = T.StructType([T.StructField(new if f.name == old else f.name, f.dataType) for f in v.t.fields])
    return V(F.struct(*(v.c[f.name].alias(new if f.name == old else f.name) for f in v.t.fields)), t)


@chain("set", args=(2, 2))
def _set_prop(v, a, comp):
    if isinstance(v.t, T.MapType):
        return _assign(v, [V(F.create_map(a[0].c, a[1].c), T.MapType(STR, a[1].t))], comp)
    return _assign(v, [V(F.struct(a[1].c.alias(comp.constant(a[0]))), T.StructType([T.StructField(comp.constant(a[0]), a[1].t)]))], comp)


@chain("id", args=(0, 0))
def _id(v, a, _):
    return V(v.c["#"], LONG) if isinstance(v.t, T.StructType) and "#" in v.t.names else V(F.lit(None).cast("bigint"), LONG)


@chain("to_thing", args=(0, 0))
def _to_thing(v, a, _):
    return need(v, "thing")


# -- strings and bytes -----------------------------------------------------------------------------------------------------


def _ascii(c: Column, a: str, b: str) -> Column:
    return F.translate(c, "".join(map(chr, range(ord(a), ord(a) + 26))), "".join(map(chr, range(ord(b), ord(b) + 26))))


@chain("lower", args=(0, 0))
def _lower(v, a, _):
    return V(_ascii(need(v, "str").c, "A", "a"), STR)


@chain("upper", args=(0, 0))
def _upper(v, a, _):
    return V(_ascii(need(v, "str").c, "a", "A"), STR)


@chain("trim", args=(0, 0))
def _trim(v, a, _):
    return V(F.regexp_replace(need(v, "str").c, f"^{SPACE}+|{SPACE}+$", ""), STR)


@chain("trim_left", args=(0, 0))
def _trim_left(v, a, _):
    return V(F.regexp_replace(need(v, "str").c, f"^{SPACE}+", ""), STR)


@chain("trim_right", args=(0, 0))
def _trim_right(v, a, _):
    return V(F.regexp_replace(need(v, "str").c, f"{SPACE}+$", ""), STR)


@chain("starts_with", args=(1, 1))
def _starts_with(v, a, _):
    return V(F.startswith(need(v, "str").c, need(a[0], "str").c), BOOL)


@chain("ends_with", args=(1, 1))
def _ends_with(v, a, _):
    return V(F.endswith(need(v, "str").c, need(a[0], "str").c), BOOL)


def quoted(s: str) -> str:
    return "".join("\\" + c if c in r"\^$.|?*+()[]{}-/" else c for c in s)


@chain("split", args=(0, 2))
def _split(v, a, comp):
    need(v, "str")
    strs = T.ArrayType(STR)
    if not a or (isinstance(a[0], V) and a[0].kind == "int"):
        n = comp.constant(a[0]) if a else None
        if n is None:
            return V(F.filter(F.split(v.c, f"{SPACE}+"), lambda x: F.length(x) > 0), strs)
        if n >= 0:
            return V(F.split(_trim_left(v, [], comp).c, f"{SPACE}+", n + 1), strs)
        parts = F.split(_trim_right(v, [], comp).c, f"{SPACE}+")
        return V(_right(parts, -n, " "), strs)
    n = comp.constant(a[1]) if len(a) > 1 else None
    if comp.is_regex(a[0]):
        return V(F.split(v.c, comp.regex(a[0]), -1 if n is None else n + 1), strs)
    sep = comp.constant(a[0])
    if sep == "":
        raise ValueError_("empty separator")
    if n is None or n >= 0:
        return V(F.split(v.c, quoted(sep), -1 if n is None else n + 1), strs)
    return V(_right(F.split(v.c, quoted(sep), -1), -n, sep), strs)


def _right(parts: Column, n: int, sep: str) -> Column:
    """At most n cuts, counted from the right."""
    keep = F.greatest(F.size(parts) - n, F.lit(1))
    return F.concat(F.array(F.array_join(F.slice(parts, F.lit(1), keep), sep)), F.slice(parts, keep + 1, F.greatest(F.size(parts) - keep, F.lit(0))))


@chain("replace", args=(1, 3))
def _replace(v, a, comp):
    if v.kind == "datetime":
        return _dt_replace(v, a, comp)
    need(v, "str")
    n = comp.constant(a[2]) if len(a) > 2 else None
    if comp.is_regex(a[0]):
        if isinstance(a[1], V) and n is None:
            return V(F.regexp_replace(v.c, F.lit(comp.regex(a[0])), F.replace(F.replace(a[1].c, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))), STR)
        rx = comp.regex(a[0])
        found, rest = F.regexp_extract_all(v.c, F.lit(rx), F.lit(0)), F.split(v.c, rx, -1)
    elif n is None and isinstance(a[1], V):
        return V(F.replace(v.c, need(a[0], "str").c, need(a[1], "str").c), STR)
    else:
        sep = comp.constant(a[0])
        rest = F.split(v.c, quoted(sep), -1)
        found = F.array_repeat(F.lit(sep), F.size(rest) - 1)
    # Parts and what stood between them, with the first (or, if negative, the last) n exchanged.
    lo, hi = (F.lit(0), F.lit(1 << 30)) if n is None else (F.lit(0), F.lit(n)) if n >= 0 else (F.size(found) + n, F.lit(1 << 30))
    new = F.transform(found, lambda m, i: F.when((i >= lo) & (i < hi), a[1].c if isinstance(a[1], V) else fits(a[1], V(m, STR)).c).otherwise(m))
    return V(F.concat(F.get(rest, F.lit(0)), F.array_join(F.zip_with(new, F.slice(rest, F.lit(2), F.greatest(F.size(rest) - 1, F.lit(0))), lambda x, y: F.concat(x, y)), "")), STR)


@chain("test", args=(1, 1))
def _test(v, a, comp):
    return V(F.regexp_like(need(a[0], "str").c, F.lit(comp.regex(v))), BOOL)


@chain("match", args=(1, 1))
def _match(v, a, comp):
    import re

    rx, text = comp.regex(v), need(a[0], "str").c
    hit = F.regexp_like(text, F.lit(rx))
    if "g" in comp.regex_flags(v):
        got = F.regexp_extract_all(text, F.lit(rx), F.lit(0))
    else:
        got = F.array(*(F.regexp_extract(text, rx, i) for i in range(re.compile(rx).groups + 1)))
    return V(F.when(hit, got), T.ArrayType(STR))


@chain("format", args=(1, 1))
def _format(v, a, comp):
    """strftime codes, translated to date patterns."""
    codes = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a", "I": "hh", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "%": "%", "z": "xx", "Z": "zzz"}
    fmt, out, i = comp.constant(a[0]), "", 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            if fmt[i + 1] not in codes:
                raise ValueError_(f"unsupported format code %{fmt[i + 1]}")
            out += codes[fmt[i + 1]]
            i += 2
        else:
            out += f"'{fmt[i]}'" if fmt[i].isalpha() else "''" if fmt[i] == "'" else fmt[i]
            i += 1
    return V(F.date_format(local(v), out), STR)


@root("base64_encode", args=(1, 1))
def _b64e(a, comp):
    return V(F.replace(F.replace(F.base64(need(a[0], "str", "bytes").c.cast("binary")), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("")), STR)


@root("base64_decode", args=(1, 1))
def _b64d(a, comp):
    return V(F.unbase64(need(a[0], "str", "bytes").c.cast("string")), BIN)


@root("bytes", args=(0, 1))
def _bytes(a, comp):
    return V(_str(a, comp).c.cast("binary") if a and a[0].kind != "bytes" else a[0].c, BIN) if a else lit(b"")


@root("str", args=(0, 1))
def _str(a, comp):
    if not a:
        return lit("")
    v = a[0]
    if v.kind == "float":
        whole = (F.abs(v.c) < 1e15) & (v.c == F.floor(v.c))
        return V(F.when(F.isnan(v.c), F.lit("nan")).when(v.c == math.inf, "inf").when(v.c == -math.inf, "-inf").when(whole, F.concat(v.c.cast("bigint").cast("string"), F.lit(".0"))).otherwise(v.c.cast("string")), STR)
    if v.kind == "datetime":
        return V(iso(v), STR)
    if v.kind == "nil":
        return lit("nil")
    if v.kind in ("list", "thing"):
        return V(F.to_json(v.c), STR)
    return V(F.coalesce(v.c.cast("string"), F.lit("nil")), STR)


@root("is_ascii", args=(1, 1))
def _is_ascii(a, comp):
    return V(F.regexp_like(need(a[0], "str").c, F.lit(r"^[\x00-\x7F]*$")), BOOL)


@root("is_utf8", args=(1, 1))
def _is_utf8(a, comp):
    v = a[0]
    return V(F.try_validate_utf8(v.c.cast("string")).isNotNull() if v.kind in ("str", "bytes") else F.lit(False), BOOL)


def _shape(pattern):
    return lambda a, comp: V(F.regexp_like(a[0].c, F.lit(pattern)), BOOL) if a[0].kind == "str" else lit(False)


ROOT["is_email"], ROOT["is_url"], ROOT["is_tel"] = (_counted(n, _shape(p), (1, 1), 0) for n, p in (("is_email", EMAIL), ("is_url", URL), ("is_tel", TEL)))

# -- numbers -----------------------------------------------------------------------------------------------------------


@root("abs", args=(1, 1))
def _abs(a, comp):
    n = number(a[0], "abs")
    return V(F.abs(n.c), n.t)


def _to_int(f):
    def run(a, comp):
        n = number(a[0], "ceil")
        return n if n.kind == "int" else V(f(n.c).cast("bigint"), LONG)

    return run


ROOT["ceil"], ROOT["floor"] = (_counted(x, _to_int(f), (1, 1), 0) for x, f in (("ceil", F.ceil), ("floor", F.floor)))


@root("round", args=(1, 2))
def _round(a, comp):
    n, d = number(a[0], "round"), comp.constant(a[1]) if len(a) > 1 else 0
    if n.kind == "int":
        return n if d >= 0 else V(F.round(n.c, d).cast("bigint"), LONG)
    out = F.round(n.c, d)
    return V(out, DOUBLE) if len(a) > 1 else V(out.cast("bigint"), LONG)


def _real(f, bad=None, msg="math domain error"):
    def run(a, comp):
        x = number(a[0], "math").c.cast("double")
        return V(guard(bad(x), "value_err", msg, f(x)) if bad else f(x), DOUBLE)

    return run


for _n, _f, _bad in (
    ("exp", F.exp, None),
    ("log10", F.log10, lambda x: x <= 0),
    ("log2", F.log2, lambda x: x <= 0),
    ("loge", F.ln, lambda x: x <= 0),
    ("sqrt", F.sqrt, lambda x: x < 0),
    ("sin", F.sin, None),
    ("cos", F.cos, None),
    ("tan", F.tan, None),
):
    ROOT[_n] = _counted(_n, _real(_f, _bad), (1, 1), 0)


@root("pow", args=(2, 2))
def _pow(a, comp):
    return V(F.pow(number(a[0], "pow").c.cast("double"), number(a[1], "pow").c.cast("double")), DOUBLE)


@chain("bit_count", args=(0, 0))
def _bit_count(v, a, _):
    """Of the absolute value."""
    return V(F.bit_count(F.when(need(v, "int").c == -(1 << 63), F.lit(1).cast("bigint")).otherwise(F.abs(v.c))).cast("bigint"), LONG)


@root("rand", args=(0, 0))
def _rand(a, comp):
    return V(F.rand(), DOUBLE)


@root("randint", args=(2, 2))
def _randint(a, comp):
    lo, hi = a[0].c, a[1].c
    return V(guard(hi <= lo, "value_err", "empty range", lo + F.floor(F.rand() * (hi - lo)).cast("bigint")), LONG)


@root("randstr", args=(1, 2))
def _randstr(a, comp):
    n, letters = comp.constant(a[0]), comp.constant(a[1]) if len(a) > 1 else "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    if not 0 <= n <= 1024:
        raise ValueError_("length must be between 0 and 1024")
    return V(F.concat(F.lit(""), *(F.substring(F.lit(letters), F.floor(F.rand() * len(letters)).cast("int") + 1, F.lit(1)) for _ in range(n))), STR)


@root("int", args=(0, 1))
def _int(a, comp):
    if not a:
        return lit(0)
    v = a[0]
    if v.kind in ("int", "float", "bool"):
        return V(v.c.cast("bigint"), LONG)
    if v.kind == "datetime":
        return V(F.unix_seconds(instant(v)), LONG)
    if v.kind == "error":
        return V(v.c["code"], LONG)
    s = need(v, "str").c
    # The longest prefix that is a number, in base 16 (0x), 8 (0) or 10; junk is 0.
    sign = F.when(F.regexp_like(s, F.lit(rf"^{SPACE}*-")), F.lit(-1)).otherwise(F.lit(1)).cast("bigint")
    body = F.regexp_replace(s, rf"^{SPACE}*[+-]?", "")
    hexa, octal, dec = F.regexp_extract(body, r"^0[xX]([0-9a-fA-F]+)", 1), F.regexp_extract(body, r"^0([0-7]+)", 1), F.regexp_extract(body, r"^([0-9]+)", 1)
    value = F.when(hexa != "", F.conv(hexa, 16, 10)).when((octal != "") & ~F.regexp_like(body, F.lit("^0[xX]")), F.conv(octal, 8, 10)).when(dec != "", dec).otherwise("0")
    return V((value.cast("decimal(38,0)") * sign).cast("bigint"), LONG)


@root("float", args=(0, 1))
def _float(a, comp):
    if not a:
        return lit(0.0)
    v = a[0]
    if v.kind in ("int", "float", "bool"):
        return V(v.c.cast("double"), DOUBLE)
    if v.kind == "datetime":
        return V(F.unix_micros(instant(v)) / 1e6, DOUBLE)
    got = F.regexp_extract(need(v, "str").c, rf"^{SPACE}*([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?(?i:inf|nan))", 1)
    return V(F.when(got == "", F.lit(0.0)).otherwise(F.nullif(got, F.lit("")).cast("double")), DOUBLE)


@root("bool", args=(0, 1))
def _bool(a, comp):
    return V(truthy(a[0]), BOOL) if a else lit(False)


@root("is_nan", args=(1, 1))
def _is_nan(a, comp):
    return V(F.isnan(a[0].c), BOOL) if a[0].kind == "float" else lit(a[0].kind not in ("int", "bool"))


@root("is_inf", args=(1, 1))
def _is_inf(a, comp):
    n = number(a[0], "is_inf")
    return V(F.abs(n.c) == math.inf, BOOL) if n.kind == "float" else lit(False)


# -- date and time -----------------------------------------------------------------------------------------------------


def zone(v: V) -> Column:
    return F.coalesce(v.c["zone"], F.lit("UTC")) if v.t == DATETIME else F.lit("UTC")


def local(v: V) -> Column:
    """Wall-clock time of the value's zone, as a timestamp of the (UTC) session."""
    return F.from_utc_timestamp(v.c["ts"], zone(v)) if v.t == DATETIME else v.c


def from_local(wall: Column, v: V) -> V:
    return V(F.struct(F.to_utc_timestamp(wall, zone(v)).alias("ts"), v.c["zone"].alias("zone")), DATETIME) if v.t == DATETIME else V(wall, TS)


def iso(v: V) -> Column:
    if v.t != DATETIME:
        return F.date_format(v.c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    minutes = ((F.unix_seconds(local(v)) - F.unix_seconds(v.c["ts"])) / 60).cast("int")
    off = F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad((F.abs(minutes) / 60).cast("int").cast("string"), 2, "0"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))
    return F.concat(F.date_format(local(v), "yyyy-MM-dd'T'HH:mm:ss"), F.when(minutes == 0, "Z").otherwise(off))


_LENGTHS = {4: "yyyy", 7: "yyyy-MM", 10: "yyyy-MM-dd", 13: "yyyy-MM-dd'T'HH", 16: "yyyy-MM-dd'T'HH:mm", 19: "yyyy-MM-dd'T'HH:mm:ss", 20: "yyyy-MM-dd'T'HH:mm:ssX", 22: "yyyy-MM-dd'T'HH:mm:ssx", 24: "yyyy-MM-dd'T'HH:mm:ssxx"}


@root("datetime", "timeval")
def _datetime(a, comp):
    if not a:
        return V(F.date_trunc("second", F.current_timestamp()), TS)
    v = a[0]
    if v.kind == "datetime":
        return v
    if v.kind == "str":
        s = F.regexp_replace(v.c, " ", "T") if len(a) == 1 else v.c
        if len(a) > 1:
            fmt = comp.constant(a[1])
            for k, p in {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%z": "xx", "%j": "DDD"}.items():
                fmt = fmt.replace(k, p)
            got = F.try_to_timestamp(s, F.lit(fmt.replace("T", "'T'")))
        else:
            got = F.lit(None).cast("timestamp")
            for n, p in _LENGTHS.items():
                got = F.when(F.length(s) == n, F.try_to_timestamp(s, F.lit(p))).otherwise(got)
        return V(F.when(v.c.isNotNull() & got.isNull(), fail("value_err", "invalid date/time string").cast("timestamp")).otherwise(got), TS)
    if len(a) == 1:
        return V(F.timestamp_seconds(number(v, "datetime").c.cast("bigint")), TS)
    parts = [x for x in a if x.kind == "int"]
    tz = [x for x in a if x.kind == "str"]
    y = [p.c.cast("int") for p in parts] + [F.lit(0)] * (6 - len(parts))
    if len(parts) < 3:
        raise NumArgumentsError("a date needs year, month and day")
    if not tz:
        return V(F.make_timestamp(*y[:5], y[5].cast("decimal(8,6)")), TS)
    return V(F.struct(F.make_timestamp(*y[:5], y[5].cast("decimal(8,6)"), tz[0].c).alias("ts"), tz[0].c.alias("zone")), DATETIME)


@root("now", args=(0, 0))
def _now(a, comp):
    return V(F.unix_micros(F.current_timestamp()) / 1e6, DOUBLE)


_PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}


@chain("extract", args=(0, 1))
def _extract(v, a, comp):
    w = local(need(v, "datetime"))
    part = lambda u: (((F.unix_seconds(w) - F.unix_seconds(instant(v))) / 60).cast("bigint") if u == "gmt_offset" else _PARTS[u](w).cast("bigint"))
    if a:
        u = comp.constant(a[0])
        if u not in (*_PARTS, "gmt_offset"):
            raise ValueError_("invalid unit")
        return V(part(u), LONG)
    names = [*_PARTS, "gmt_offset"]
    return V(F.struct(*(part(u).alias(u) for u in names)), T.StructType([T.StructField(u, LONG) for u in names]))


@chain("move", args=(2, 2))
def _move(v, a, comp):
    """Years to days move the wall clock and roll over (31 January and a month is 2 or 3 March); smaller units move the instant."""
    u, n = comp.constant(a[0]).rstrip("s"), a[1].c
    secs = {"hour": 3600, "minute": 60, "second": 1}
    need(v, "datetime")
    if u in secs:
        ts = F.timestamp_micros(F.unix_micros(instant(v)) + n * (secs[u] * 1_000_000))
        return V(F.struct(ts.alias("ts"), v.c["zone"].alias("zone")), DATETIME) if v.t == DATETIME else V(ts, TS)
    w = local(v)
    clock = F.unix_micros(w) - F.unix_micros(F.date_trunc("day", w))
    if u in ("week", "day"):
        day = F.date_add(w.cast("date"), (n * (7 if u == "week" else 1)).cast("int"))
    elif u in ("year", "month"):
        total = F.year(w).cast("bigint") * 12 + F.month(w) - 1 + n * (12 if u == "year" else 1)
        day = F.date_add(F.make_date(F.floor(total / 12).cast("int"), (F.pmod(total, F.lit(12)) + 1).cast("int"), F.lit(1)), F.dayofmonth(w) - 1)
    else:
        raise ValueError_("invalid unit")
    return from_local(F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + clock), v)


def _dt_replace(v, a, comp):
    new = a[0].t.names
    w = local(v)
    p = [as_type(V(a[0].c[u], LONG), LONG) if u in new else f(w).cast("bigint") for u, f in _PARTS.items()]
    return from_local(F.make_timestamp(*(x.cast("int") for x in p[:5]), p[5].cast("decimal(8,6)")), v)


@chain("to", args=(1, 1))
def _to(v, a, comp):
    return V(F.struct(instant(need(v, "datetime")).alias("ts"), a[0].c.alias("zone")), DATETIME)


@chain("zone", args=(0, 0))
def _zone(v, a, comp):
    return V(v.c["zone"], STR) if v.t == DATETIME else lit(None)


@chain("week", args=(0, 0))
def _week(v, a, _):
    """The first Sunday begins week 1; days before it are in week 0."""
    w = local(need(v, "datetime"))
    return V(F.floor((F.dayofyear(w) + 6 - (F.dayofweek(w) - 1)) / 7).cast("bigint"), LONG)


@chain("weekday", args=(0, 0))
def _weekday(v, a, _):
    return V((F.dayofweek(local(need(v, "datetime"))) - 1).cast("bigint"), LONG)


@chain("yday", args=(0, 0))
def _yday(v, a, _):
    return V((F.dayofyear(local(need(v, "datetime"))) - 1).cast("bigint"), LONG)


@root("is_time_zone", args=(1, 1))
def _is_tz(a, comp):
    return V(a[0].c.isin(sorted(zoneinfo.available_timezones())), BOOL) if a[0].kind == "str" else lit(False)


# -- JSON, kinds, errors ---------------------------------------------------------------------------------------------


@root("json_dump", args=(1, 2))
def _json_dump(a, comp):
    v = a[0]
    if v.kind in ("list", "thing"):
        return V(F.to_json(v.c, {"ignoreNullFields": "false"}), STR)
    return V(F.regexp_replace(F.to_json(F.array(v.c), {"ignoreNullFields": "false"}), r"^\[|\]$", ""), STR)


@root("json_load", args=(1, 1))
def _json_load(a, comp):
    """A JSON text whose type is not known when the plan is built: a VARIANT; properties of it are read as strings."""
    return V(F.try_parse_json(need(a[0], "str").c), T.VariantType())


_PREDICATES = {
    "is_array": ("list",),
    "is_bool": ("bool",),
    "is_bytes": ("bytes",),
    "is_datetime": ("datetime",),
    "is_err": ("error",),
    "is_float": ("float",),
    "is_int": ("int",),
    "is_list": ("list",),
    "is_raw": ("str", "bytes"),
    "is_str": ("str",),
    "is_thing": ("thing",),
    "is_set": (),
    "is_closure": (),
    "is_enum": (),
    "is_future": (),
    "is_module": (),
    "is_mpdata": (),
    "is_regex": (),
    "is_room": (),
    "is_task": (),
    "is_timeval": (),
    "is_tuple": (),
}


def _is_kind(kinds):
    return lambda a, comp: V(a[0].c.isNotNull(), BOOL) if isinstance(a[0], V) and a[0].kind in kinds else lit(False)


for _n, _k in _PREDICATES.items():
    ROOT[_n] = _counted(_n, _is_kind(_k), (1, 1), 0)


@root("is_nil", args=(1, 1))
def _is_nil(a, comp):
    return V(a[0].c.isNull(), BOOL)


@root("type", args=(1, 1))
def _type(a, comp):
    return V(F.when(a[0].c.isNull(), "nil").otherwise(a[0].kind), STR)


@root("type_assert", args=(2, 3))
def _type_assert(a, comp):
    names = comp.constant(a[1])
    names = [names] if isinstance(names, str) else names
    if a[0].kind not in names:
        raise TypeError_(comp.constant(a[2]) if len(a) > 2 else f"invalid type `{a[0].kind}`")
    return V(guard(a[0].c.isNull() & F.lit("nil" not in names), "type_err", "invalid type `nil`", a[0].c), a[0].t)


@root("assert", args=(1, 2))
def _assert(a, comp):
    msg = comp.constant(a[1]) if len(a) > 1 else "assertion statement has failed"
    return V(F.when(~truthy(a[0]), fail("assert_err", msg)), NIL)


@root("raise", args=(0, 1))
def _raise(a, comp):
    if a and a[0].kind == "error":
        return V(F.raise_error(F.concat(F.lit("["), a[0].c["code"].cast("string"), F.lit("] "), a[0].c["msg"])), NIL)
    return V(F.raise_error(F.concat(F.lit("[-100] "), a[0].c if a else F.lit("error"))), NIL)


@root("err", args=(0, 2))
def _err(a, comp):
    return V(F.struct((a[0].c if a else F.lit(-100)).cast("bigint").alias("code"), (a[1].c if len(a) > 1 else F.lit("error")).alias("msg")), ERROR)


for _n, _code in CODES.items():
    ROOT[_n] = lambda a, comp, _c=_code, _m=_n: V(F.struct(F.lit(_c).cast("bigint").alias("code"), (a[0].c if a else F.lit(_m)).alias("msg")), ERROR)


@chain("code", args=(0, 0))
def _code_of(v, a, _):
    return V(need(v, "error").c["code"], LONG)


@chain("msg", args=(0, 0))
def _msg_of(v, a, _):
    return V(need(v, "error").c["msg"], STR)


@chain("call")
def _call(v, a, comp):
    return v.apply(*a)


@root("nse", "wse", "log", args=(0, 1))
def _pass(a, comp):
    return a[0] if a else lit(None)

