"""The built-in functions of the driver's interpreter.

CHAIN serves x.name(...), ROOT name(...). LAZY and LAZY_CHAIN get their arguments unevaluated. Table receivers never come here.
"""

from __future__ import annotations

import base64
import datetime as dt
import json
import logging
import math
import random
import re
import time
import zoneinfo
from collections.abc import Callable
from typing import Any

from quillon.errors import CODES, LangError, LookupError_, OperationError, SyntaxError_, TypeError_, ValueError_, make
from quillon.functions.columns import EMAIL, TEL, URL
from quillon.lang.compile import Rx
from quillon.lang.parser import parse
from quillon.operators.collection import Coll
from quillon.runtime import values as X
from quillon.runtime.interp import Interp, count
from quillon.runtime.types import Enum, Spec, Type
from quillon.runtime.values import Ano, ClosureValue, DateTime, Err, Future, List, Member, Module, MpData, Room, Task, Thing, TSet, Wrap, checked, compare, eq, is_list, kind, nested, truthy
from quillon.sources import msgpack

log = logging.getLogger("quillon")
CHAIN: dict[str, Multi] = {}
ROOT: dict[str, Callable] = {}
LAZY: dict[str, Callable] = {}
LAZY_CHAIN: dict[str, Callable] = {}
MAX_RANGE, MAX_FUTURES, MAX_TASKS = 100_000, 2000, 500

LISTS, THINGS, SETS, RAW = (list, tuple), (Thing,), (TSet,), (str, bytes)


class Multi:
    """A chained function with a body for each receiver type."""

    def __init__(self, name: str):
        self.name, self.cases = name, []

    def takes(self, v: Any) -> bool:
        return self.find(v) is not None

    def find(self, v: Any):
        return next((c for c in self.cases if isinstance(v, c[0]) and not (isinstance(v, bool) and bool not in c[0])), None)

    def __call__(self, q: Interp, v: Any, args: list) -> Any:
        _, low, high, f, change = self.find(v)
        count(self.name, len(args), low, high)
        if change and (getattr(v, "id", None) is not None or change == 2):
            q.mutate()
        return f(q, v, *args)


def chain(name: str, types: tuple, low: int = 0, high: int | None = -1, change: int = 0):
    def put(f):
        for n in name.split():
            CHAIN.setdefault(n, Multi(n)).cases.append((types, low, low if high == -1 else high, f, change))
        return f

    return put


def root(name: str, low: int = 0, high: int | None = -1):
    def put(f):
        for n in name.split():

            def run(q, args, n=n):
                count(n, len(args), low, low if high == -1 else high)
                return f(q, *args)

            ROOT[n] = run
        return f

    return put


def want(v: Any, types: tuple, what: str) -> Any:
    if not isinstance(v, types) or (isinstance(v, bool) and bool not in types):
        raise TypeError_(f"expecting {what} but got type `{kind(v)}`")
    return v


def number(v: Any) -> Any:
    return want(v, (bool, int, float), "a number")


def mutable(v: Any) -> List:
    if not isinstance(v, List):
        raise TypeError_("a tuple is immutable")
    return v


# -- collections
@chain("filter", LISTS, 1)
def _(q, v, f):
    f = q.fn(f)
    return List(x for i, x in enumerate(list(v)) if truthy(f(x, i)))


@chain("filter", SETS, 1)
def _(q, v, f):
    f = q.fn(f)
    return TSet(x for x in v if truthy(f(x, x.id)))


@chain("filter", THINGS, 1)
def _(q, v, f):
    f = q.fn(f)
    return Thing({k: x for k, x in list(v.fields.items()) if truthy(f(k, x))})


@chain("map", (*LISTS, TSet, Thing), 1)
def _(q, v, f):
    f = q.fn(f)
    return List(nested(f(*p)) for p in q.pairs(v))


@chain("vmap", THINGS, 1)
def _(q, v, f):
    f = q.fn(f)
    return Thing({k: f(x) for k, x in list(v.fields.items())})


@chain("each", (*LISTS, TSet, Thing), 1)
def _(q, v, f):
    f = q.fn(f)
    for p in q.pairs(v):
        f(*p)


@chain("reduce", (*LISTS, TSet), 1, 2)
def _(q, v, f, *init):
    f, items = q.fn(f), list(v)
    if not items and not init:
        raise LookupError_("reduce on empty list with no initial value")
    acc, rest = (init[0], enumerate(items)) if init else (items[0], list(enumerate(items))[1:])
    for i, x in rest:
        acc = f(acc, x, i)
    return acc


def _find(q, v, args, env):
    count("find", len(args), 1, 2)
    f = q.fn(q.value(args[0], env))
    for x, i in q.pairs(v):
        if truthy(f(x, i)):
            return x
    return q.value(args[1], env) if len(args) > 1 else None


def _get(q, v, args, env):
    count("get", len(args), 1, 2)
    want(v, THINGS, "a thing")
    k = q.value(args[0], env)
    return v.fields[k] if k in v.fields else q.value(args[1], env) if len(args) > 1 else None


LAZY_CHAIN["find"], LAZY_CHAIN["get"] = _find, _get


@chain("find_index", LISTS, 1)
def _(q, v, f):
    f = q.fn(f)
    return next((i for i, x in enumerate(list(v)) if truthy(f(x, i))), None)


@chain("index_of", LISTS, 1)
def _(q, v, y):
    return next((i for i, x in enumerate(v) if eq(x, y)), None)


@chain("some", (*LISTS, TSet), 1)
def _(q, v, f):
    f = q.fn(f)
    return any(truthy(f(*p)) for p in q.pairs(v))


@chain("every", (*LISTS, TSet), 1)
def _(q, v, f):
    f = q.fn(f)
    return all(truthy(f(*p)) for p in q.pairs(v))


@chain("has", THINGS, 1)
def _(q, v, k):
    return want(k, (str,), "a name") in v.fields


@chain("has", SETS, 1)
def _(q, v, t):
    return want(t, THINGS, "a thing") in v


@chain("has", LISTS, 1)
def _(q, v, y):
    return any(eq(x, y) for x in v)


@chain("contains", (str,), 1)
def _(q, v, s):
    return want(s, (str,), "a string") in v


@chain("keys", THINGS)
def _(q, v):
    return List(v.fields)


@chain("values", THINGS)
def _(q, v):
    return List(nested(x) for x in v.fields.values())


@chain("len", (str,))
def _(q, v):
    return len(v.encode())


@chain("len", (bytes, list, tuple, TSet))
def _(q, v):
    return len(v)


@chain("len", THINGS)
def _(q, v):
    return len(v.fields)


@chain("len", (Member,))
def _(q, v):
    return CHAIN["len"](q, v.value, [])


@chain("flat", LISTS, 0, 1)
def _(q, v, deep=1):
    out = list(v)
    for _i in range(deep):
        out = [y for x in out for y in (x if is_list(x) else [x])]
    return List(out)


def _copied(v, deep, keep):
    if isinstance(v, Wrap):
        v = v.thing
    if isinstance(v, Thing):
        return Thing({k: _copied(x, deep - 1, keep) if deep > 1 else x for k, x in v.fields.items()}, v.type if keep else None)
    if is_list(v):
        return type(v)(_copied(x, deep, keep) if deep else x for x in v)
    if isinstance(v, TSet):
        return TSet(_copied(x, deep, keep) if deep else x for x in v)
    return v


@chain("copy", (Thing, Wrap, *LISTS, TSet), 0, 1)
def _(q, v, deep=None):
    return _copied(v, (1 if isinstance(v, (Thing, Wrap)) else 0) if deep is None else deep, False)


@chain("dup", (Thing, Wrap, *LISTS, TSet), 0, 1)
def _(q, v, deep=None):
    return _copied(v, (1 if isinstance(v, (Thing, Wrap)) else 0) if deep is None else deep, True)


@chain("map_id", (*LISTS, TSet))
def _(q, v):
    return List(want(x, THINGS, "a thing").id for x in v)


@chain("map_type", LISTS, 1)
def _(q, v, name):
    t = q.types().need(name)
    out = []
    for x in v:
        if isinstance(x, int) and not isinstance(x, bool):
            x = q.scope.by_id(x)
            if x.type is not t:
                raise TypeError_(f"the thing is not of type `{name}`")
        elif x.type is not t:
            x = t.new(dict(want(x, THINGS, "a thing").fields))
        out.append(x)
    return List(out)


def _view(q, spec):
    if isinstance(spec, Ano):
        t = Type("anonymous", q.types())
        t.define(spec.spec)
        return t, None
    return q.types().need(want(spec, (str,), "a type name")), spec


def _wrapped(q, t, spec):
    if spec is None:
        if want(t, THINGS, "a thing").type is None:
            raise make(-62, "wrap without a type needs a typed thing")
        return Wrap(t, t.type, t.type.name)
    view, name = _view(q, spec)
    return Wrap(want(t, THINGS, "a thing"), view, name)


@chain("wrap", THINGS, 0, 1)
def _(q, v, spec=None):
    return _wrapped(q, v, spec)


@chain("map_wrap", (*LISTS, TSet), 0, 1)
def _(q, v, spec=None):
    return List(_wrapped(q, x, spec) for x in v)


@chain("unwrap", (Wrap,))
def _(q, v):
    return v.thing


@chain("first", LISTS, 0, 1)
def _(q, v, *d):
    if v or d:
        return v[0] if v else d[0]
    raise LookupError_("list is empty")


@chain("last", LISTS, 0, 1)
def _(q, v, *d):
    if v or d:
        return v[-1] if v else d[0]
    raise LookupError_("list is empty")


@chain("one", SETS)
def _(q, v):
    for x in v:
        return x
    raise LookupError_("set is empty")


@chain("choice", LISTS)
def _(q, v):
    if not v:
        raise LookupError_("choice from empty list")
    return random.choice(v)


def _same(a, b, deep):
    if isinstance(a, Thing) and isinstance(b, Thing):
        return a is b or (deep > 0 and a.fields.keys() == b.fields.keys() and all(_same(x, b.fields[k], deep - 1) for k, x in a.fields.items()))
    if is_list(a) and is_list(b):
        return len(a) == len(b) and all(_same(x, y, deep) for x, y in zip(a, b, strict=True))
    if isinstance(a, TSet) and isinstance(b, TSet):
        return len(a) == len(b) and all(any(_same(x, y, deep) for y in b) for x in a)
    return eq(a, b)


@chain("equals", THINGS, 1, 2)
def _(q, v, other, deep=1):
    return _same(v, other, deep)


@chain("search", THINGS, 1, 2)
def _(q, v, needle, options=None):
    opt = options.fields if options else {}
    deep, limit = opt.get("deep", 1), opt.get("limit", 1)
    if not 0 <= deep <= 127 or not 0 <= limit <= 255:
        raise ValueError_("deep must be 0 to 127, limit 0 to 255")
    found, seen, level = [], {id(v)}, [v]
    while level and deep >= 0 and len(found) < limit:
        below = []
        for t in level:
            for k, x in t.fields.items():
                for y in [x] if isinstance(x, Thing) else [y for y in x if isinstance(y, Thing)] if is_list(x) or isinstance(x, TSet) else []:
                    if y is needle and len(found) < limit:
                        found.append(Thing({"parent": t, "parent_type": kind(t), "key": k, "key_type": kind(x)}))
                    if id(y) not in seen:
                        seen.add(id(y))
                        below.append(y)
        level, deep = below, deep - 1
    return List(found)


@chain("count", LISTS, 1)
def _(q, v, y):
    if isinstance(y, ClosureValue):
        f = q.fn(y)
        return sum(truthy(f(x, i)) for i, x in enumerate(list(v)))
    return sum(eq(x, y) for x in v)


@chain("sum", LISTS, 0, 1)
def _(q, v, f=None):
    f = q.fn(f) if f is not None else (lambda x: x)
    total = 0
    for x in list(v):
        total = X.arith("+", total, X.plain(f(x)))
    return total


def _extreme(v, sign):
    if not v:
        raise LookupError_("list is empty")
    best = v[-1]
    for x in reversed(v[:-1]):
        if compare(x, best) == sign:
            best = x
    return best


@chain("min", LISTS)
def _(q, v):
    return _extreme(v, -1)


@chain("max", LISTS)
def _(q, v):
    return _extreme(v, 1)


@chain("unique", LISTS)
def _(q, v):
    out = List()
    for x in v:
        if not any(eq(x, y) for y in out):
            out.append(x)
    return out


@chain("is_unique", LISTS)
def _(q, v):
    return len(CHAIN["unique"](q, v, [])) == len(v)


@root("type_count", 1)
def _(q, name):
    found = ROOT["type_all"](q, [name])
    return found.len() if isinstance(found, Coll) else len(found)


@chain("sort", LISTS, 0, 2)
def _(q, v, *a):
    from functools import cmp_to_key

    f = a[0] if a and isinstance(a[0], ClosureValue) else None
    rev = truthy(a[-1]) if a and not isinstance(a[-1], ClosureValue) else False
    if f is not None and len(f.names) == 2:
        call = q.fn(f)
        key = cmp_to_key(lambda x, y: int(want(call(x, y), (bool, int), "an integer")))
        return List(sorted(v, key=key, reverse=rev))
    call = q.fn(f) if f is not None else (lambda x: x)
    if len(v) == 1:
        return List(v)
    return List(x for _, x in sorted([(call(x), x) for x in v], key=cmp_to_key(lambda x, y: compare(x[0], y[0])), reverse=rev))


@chain("reverse", LISTS)
def _(q, v):
    return List(reversed(v))


@root("range", 1, 3)
def _(q, *a):
    if len(a) == 3 and a[2] == 0:
        raise ValueError_("step value must not be zero")
    r = range(*(want(x, (int,), "an integer") for x in a))
    if len(r) > MAX_RANGE:
        raise OperationError("maximum range length exceeded")
    return List(r)


@chain("push", LISTS, 1, None, 1)
def _(q, v, *new):
    mutable(v).extend(q.restricted(v, nested(x)) for x in new)
    return len(v)


@chain("unshift", LISTS, 1, None, 1)
def _(q, v, *new):
    mutable(v)[:0] = [q.restricted(v, nested(x)) for x in new]
    return len(v)


@chain("pop", LISTS)
def _(q, v):
    if not mutable(v):
        raise LookupError_("pop from empty list")
    return v.pop()


@chain("shift", LISTS)
def _(q, v):
    if not mutable(v):
        raise LookupError_("shift from empty list")
    return v.pop(0)


@chain("splice", LISTS, 2, None)
def _(q, v, at, n, *new):
    at = max(0, min(len(v), at + len(v) if at < 0 else at))
    n = max(0, n)
    gone = List(mutable(v)[at : at + n])
    v[at : at + n] = [q.restricted(v, nested(x)) for x in new]
    return gone


@chain("extend", LISTS, 1)
def _(q, v, other):
    mutable(v).extend(q.restricted(v, x) for x in want(other, LISTS, "a list"))
    return len(v)


@chain("extend_unique", LISTS, 1)
def _(q, v, other):
    for x in want(other, LISTS, "a list"):
        if not any(eq(x, y) for y in mutable(v)):
            v.append(q.restricted(v, x))
    return len(v)


@chain("fill", LISTS, 1)
def _(q, v, x):
    mutable(v)[:] = [q.restricted(v, nested(x))] * len(v)
    return v


@chain("remove", LISTS, 1, 2)
def _(q, v, f, limit=None):
    f = q.fn(f)
    at = [i for i, x in enumerate(list(mutable(v))) if truthy(f(x, i))]
    at = at if limit is None else at[:limit] if limit >= 0 else at[limit:][::-1]
    gone = List(v[i] for i in at)
    for i in sorted(at, reverse=True):
        del v[i]
    return gone


@chain("remove", SETS, 1, None)
def _(q, v, *a):
    hits = [x for x in v if truthy(q.call(a[0], [x, x.id]))] if isinstance(a[0], ClosureValue) else [want(x, THINGS, "a thing") for x in a]
    gone = List(x for x in hits if x in v)
    for x in gone:
        v.items.pop(id(x), None)
    if v.home:
        q.types().changed(v, gone, [])
    return gone


@chain("remove", THINGS, 1, 2, 1)
def _(q, v, f, limit=None):
    f = q.fn(f)
    keys = [k for k, x in list(v.fields.items()) if truthy(f(k, x))]
    keys = keys if limit is None else keys[:limit]
    return List(v.fields.pop(k) for k in keys)


@chain("clear", (list, TSet, Thing), 0, 0, 1)
def _(q, v):
    gone = list(v) if isinstance(v, TSet) and v.home else []
    (v.items if isinstance(v, TSet) else v.fields if isinstance(v, Thing) else mutable(v)).clear()
    if gone:
        q.types().changed(v, gone, [])


@chain("join", LISTS, 0, 1)
def _(q, v, sep=""):
    if not all(isinstance(x, str) for x in v):
        raise TypeError_("expecting a list of strings")
    return sep.join(v)


@root("set", 0, None)
def _(q, *a):
    flat = [y for x in a for y in (x if is_list(x) or isinstance(x, TSet) else [x])]
    return TSet(want(x, THINGS, "a thing") for x in flat)


@chain("set", THINGS, 2)
def _(q, v, k, x):
    q.set_prop(v, want(k, (str,), "a name"), x)
    return x


@chain("add", SETS, 1, None)
def _(q, v, *things):
    before = len(v)
    added = [t for t in things if t not in v]
    for t in things:
        q.restricted(v, want(t, THINGS, "a thing"))
        v.items[id(t)] = t
    if v.home:
        q.types().changed(v, [], added)
    return len(v) - before


@root("type_all", 1)
def _(q, name):
    t = q.types().need(name)
    table = q.engine.typed.get((q.scope.name, name))
    return table if table is not None else TSet(x for x in q.scope.all_things() if x.type is t)


# -- things
@root("thing", 0, 1)
def _(q, *a):
    if not a:
        return Thing()
    return q.scope.by_id(a[0]) if isinstance(a[0], int) and not isinstance(a[0], bool) else want(a[0], THINGS, "a thing")


@chain("assign", THINGS, 1)
def _(q, v, other):
    for k, x in want(other, THINGS, "a thing").fields.items():
        q.set_prop(v, k, x)
    return v


@chain("del", THINGS, 1, 1, 1)
def _(q, v, k):
    if v.type is not None:
        raise TypeError_("properties of typed things can't be deleted")
    if k not in v.fields:
        raise LookupError_(f"thing has no property `{k}`")
    return v.fields.pop(k)


@chain("ren", THINGS, 2, 2, 1)
def _(q, v, old, new):
    if old not in v.fields:
        raise LookupError_(f"thing has no property `{old}`")
    v.fields = {new if k == old else k: x for k, x in v.fields.items()}


@chain("restrict", THINGS, 1, 1, 1)
def _(q, v, spec):
    if spec is not None:
        s = Spec(spec, q.types())
        for k, x in v.fields.items():
            s.check(x, k)
    v.restriction = spec


@chain("restriction", (Thing, list, tuple, TSet))
def _(q, v):
    return getattr(v, "restriction", None)


@chain("to_type", THINGS, 1, 1, 1)
def _(q, v, name):
    made = q.types().need(name).new(dict(v.fields))
    v.fields, v.type = made.fields, made.type


@chain("to_thing", THINGS, 0, 0, 1)
def _(q, v):
    v.type = None


@chain("id", (Thing, Room, Task))
def _(q, v):
    return v.id


@chain("id", (Wrap,))
def _(q, v):
    return v.thing.id


@chain("id", (Ano,))
def _(q, v):
    return None


@root("refs", 1)
def _(q, v):
    """Values are shared by Python; the number has no meaning for a query."""
    import sys

    return sys.getrefcount(v)


@root("root")
def _(q):
    return q.root()


@root("list", 0, 1)
def _(q, *a):
    return List(a[0]) if a and (is_list(a[0]) or isinstance(a[0], TSet)) else List() if not a else want(a[0], LISTS, "a list")


# -- strings
def _ascii_case(s, up):
    return "".join(c.upper() if up and "a" <= c <= "z" else c.lower() if not up and "A" <= c <= "Z" else c for c in s)


WHITE = " \t\n\x0b\f\r"
for _name, _f in {"lower": lambda s: _ascii_case(s, False), "upper": lambda s: _ascii_case(s, True), "trim": lambda s: s.strip(WHITE), "trim_left": lambda s: s.lstrip(WHITE), "trim_right": lambda s: s.rstrip(WHITE)}.items():
    chain(_name, (str,))(lambda q, v, f=_f: f(v))


@chain("starts_with", (str,), 1)
def _(q, v, s):
    return v.startswith(want(s, (str,), "a string"))


@chain("ends_with", (str,), 1)
def _(q, v, s):
    return v.endswith(want(s, (str,), "a string"))


def _regex(r: Rx) -> re.Pattern:
    flags = 0
    for f in r.flags:
        flags |= {"i": re.I, "m": re.M, "s": re.S, "x": re.X}.get(f, 0)
    return re.compile(r.pattern, flags)


@chain("split", (str,), 0, 2)
def _(q, v, sep=None, n=None):
    if isinstance(sep, int) or sep is None:
        n = sep if sep is not None else n
        if n is None:
            return List(re.split(f"[{WHITE}]+", v.strip(WHITE))) if v.strip(WHITE) else List()
        if n >= 0:
            return List(re.split(f"[{WHITE}]+", v.lstrip(WHITE), maxsplit=n)) if n else List([v.lstrip(WHITE)])
        return List(v.rsplit(None, -n))
    if isinstance(sep, Rx):
        return List(x if x is not None else "" for x in _regex(sep).split(v, maxsplit=n or 0))
    if sep == "":
        raise ValueError_("empty separator")
    return List(v.split(sep) if n is None else v.split(sep, n) if n >= 0 else v.rsplit(sep, -n))


@chain("replace", (str,), 2, 3)
def _(q, v, old, new, n=None):
    make_ = (lambda *g: want(q.call(new, list(g)), (str,), "a string")) if isinstance(new, ClosureValue) else (lambda *g: new)
    if isinstance(old, Rx):
        if n is not None and n < 0:
            raise ValueError_("a regular expression replaces from the left")
        return _regex(old).sub(lambda m: make_(m[0], *m.groups()), v, count=n or 0) if n != 0 else v
    parts = v.split(old) if n is None else v.split(old, n) if n >= 0 else v.rsplit(old, -n)
    return "".join(p + (make_(old) if i < len(parts) - 1 else "") for i, p in enumerate(parts))


@chain("replace", (DateTime,), 1)
def _(q, v, t):
    return v.moved(v.local().replace(**{k: want(x, (int,), "an integer") for k, x in t.fields.items()}))


@chain("test", (Rx,), 1)
def _(q, v, s):
    return _regex(v).search(want(s, (str,), "a string")) is not None


@chain("match", (Rx,), 1)
def _(q, v, s):
    if "g" in v.flags:
        got = [m[0] for m in _regex(v).finditer(s)]
        return List(got) if got else None
    m = _regex(v).search(want(s, (str,), "a string"))
    return List([m[0], *m.groups()]) if m else None


@root("regex", 1, 2)
def _(q, pattern, flags=""):
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError_(f"cannot compile regular expression: {e}") from e
    return Rx(pattern, flags)


@chain("format", (DateTime,), 1)
def _(q, v, fmt):
    return v.local().strftime(fmt)


@root("base64_encode", 1)
def _(q, v):
    return base64.b64encode(v.encode() if isinstance(v, str) else want(v, RAW, "a string")).decode()


@root("base64_decode", 1)
def _(q, v):
    try:
        return base64.b64decode(want(v, RAW, "a string"))
    except ValueError as e:
        raise ValueError_("invalid base64 string") from e


@root("bytes", 0, 1)
def _(q, v=b""):
    return bytes(v) if isinstance(v, bytes) else X.text(v).encode()


@root("str", 0, 1)
def _(q, *a):
    return X.text(a[0]) if a else ""


@root("is_ascii", 1)
def _(q, v):
    return isinstance(v, str) and v.isascii()


@root("is_utf8", 1)
def _(q, v):
    try:
        return isinstance(v, str) or bool(isinstance(v, bytes) and v.decode() is not None)
    except UnicodeDecodeError:
        return False


for _name, _p in {"is_email": EMAIL, "is_url": URL, "is_tel": TEL}.items():
    root(_name, 1)(lambda q, v, p=_p: isinstance(v, str) and re.search(p, v) is not None)


@root("randstr", 1, 2)
def _(q, n, letters="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"):
    if not 0 <= n <= 1024:
        raise ValueError_("length must be between 0 and 1024")
    if not letters or not letters.isascii():
        raise ValueError_("character set must be ASCII and not empty")
    return "".join(random.choice(letters) for _ in range(n))


# -- numbers
@root("abs", 1)
def _(q, v):
    return abs(number(v)) if isinstance(v, float) else checked(abs(int(number(v))))


def _whole(f):
    def run(q, v):
        number(v)
        if isinstance(v, float) and not math.isfinite(v):
            raise make(-59, "float overflow")
        return checked(f(v)) if isinstance(v, float) else int(v)

    return run


root("ceil", 1)(_whole(math.ceil))
root("floor", 1)(_whole(math.floor))


@root("round", 1, 2)
def _(q, v, digits=0):
    """Half away from zero."""
    number(v)
    s = 10.0**digits
    r = math.copysign(math.floor(abs(v) * s + 0.5), v) / s
    return r if isinstance(v, float) and digits > 0 else checked(int(r)) if not isinstance(v, float) or digits == 0 else r


for _name, _f, _ok in (("exp", math.exp, None), ("log10", math.log10, lambda x: x > 0), ("log2", math.log2, lambda x: x > 0), ("loge", math.log, lambda x: x > 0), ("sqrt", math.sqrt, lambda x: x >= 0), ("sin", math.sin, None), ("cos", math.cos, None), ("tan", math.tan, None)):

    def _real(q, v, f=_f, ok=_ok):
        x = float(number(v))
        if ok and not (ok(x) or math.isnan(x)):
            raise ValueError_("math domain error")
        return x if math.isnan(x) else f(x)

    root(_name, 1)(_real)


@root("pow", 2)
def _(q, a, b):
    return float(number(a)) ** float(number(b))


@chain("bit_count", (int,))
def _(q, v):
    return abs(v).bit_count()


@root("rand")
def _(q):
    return random.random()


@root("randint", 2)
def _(q, a, b):
    if b <= a:
        raise ValueError_("empty range")
    return random.randrange(a, b)


@root("int", 0, 1)
def _(q, v=0):
    v = X.plain(v)
    if isinstance(v, (bool, int)):
        return int(v)
    if isinstance(v, float):
        if not math.isfinite(v):
            raise make(-59, "float overflow")
        return checked(int(v))
    if isinstance(v, DateTime):
        return v.ts
    if isinstance(v, Err):
        return v.code
    m = re.match(rf"[{WHITE}]*([+-]?)(0[xX][0-9a-fA-F]+|0[0-7]+|[0-9]+)", want(v, (str,), "a number or a string"))
    if not m:
        return 0
    n = int(m[2], 16) if m[2][:2] in ("0x", "0X") else int(m[2], 8) if m[2][0] == "0" and len(m[2]) > 1 else int(m[2])
    return checked(-n if m[1] == "-" else n)


@root("float", 0, 1)
def _(q, v=0.0):
    v = X.plain(v)
    if isinstance(v, (bool, int, float)):
        return float(v)
    if isinstance(v, DateTime):
        return float(v.ts)
    m = re.match(rf"[{WHITE}]*([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?(?:inf|nan))", want(v, (str,), "a number or a string"), re.I)
    return float(m[1]) if m else 0.0


@root("bool", 0, 1)
def _(q, v=None):
    return truthy(v)


@root("is_nan", 1)
def _(q, v):
    return not isinstance(v, (int, float)) or (isinstance(v, float) and math.isnan(v))


@root("is_inf", 1)
def _(q, v):
    return math.isinf(number(v))


# -- date and time
_FORMATS = {4: "%Y", 7: "%Y-%m", 10: "%Y-%m-%d", 13: "%Y-%m-%dT%H", 16: "%Y-%m-%dT%H:%M", 19: "%Y-%m-%dT%H:%M:%S", 20: "%Y-%m-%dT%H:%M:%SZ", 22: "%Y-%m-%dT%H:%M:%S%z", 24: "%Y-%m-%dT%H:%M:%S%z"}


def _datetime(timeval):
    def run(q, *a):
        zone = getattr(q.scope, "zone", None)
        if not a:
            return DateTime(int(time.time()), zone, timeval)
        v = a[0]
        if isinstance(v, DateTime):
            return DateTime(v.ts, v.zone, timeval)
        if isinstance(v, str):
            s = v.replace(" ", "T", 1) if len(a) == 1 else v
            fmt = a[1] if len(a) > 1 else _FORMATS.get(len(s))
            if fmt is None:
                raise ValueError_("invalid date/time string")
            if len(s) == 22 and len(a) == 1:
                s += "00"
            try:
                w = dt.datetime.strptime(s, fmt)
            except ValueError as e:
                raise ValueError_("invalid date/time string") from e
            here = DateTime(0, zone)
            z = zone
            if w.tzinfo is not None:
                z = w.strftime("%z")
            elif s.endswith("Z") and len(a) == 1:
                z, here = "UTC", DateTime(0, "UTC")
            return DateTime(int((w if w.tzinfo else w.replace(tzinfo=here.tz())).timestamp()), z, timeval)
        if len(a) == 1:
            return DateTime(int(number(v)), zone, timeval)
        nums = [x for x in a if isinstance(x, int)]
        zone = next((x for x in a if isinstance(x, str)), zone)
        if len(nums) < 3:
            raise make(-62, "a date needs year, month and day")
        d = DateTime(0, zone, timeval)
        try:
            return d.moved(dt.datetime(*nums, tzinfo=d.tz()))
        except (ValueError, TypeError) as e:
            raise ValueError_("invalid date") from e

    return run


root("datetime", 0, 7)(_datetime(False))
root("timeval", 0, 7)(_datetime(True))


@root("now")
def _(q):
    return time.time()


@chain("extract", (DateTime,), 0, 1)
def _(q, v, unit=None):
    w = v.local()
    got = {u: getattr(w, u) for u in ("year", "month", "day", "hour", "minute", "second")} | {"gmt_offset": int(w.utcoffset().total_seconds() // 60)}
    if unit is None:
        return Thing(got)
    if unit not in got:
        raise ValueError_("invalid unit")
    return got[unit]


def moved(v: DateTime, unit: str, n: int) -> DateTime:
    """Years to days move the wall clock and roll over; smaller units move the instant."""
    u = unit.rstrip("s")
    secs = {"hour": 3600, "minute": 60, "second": 1}
    if u in secs:
        return DateTime(v.ts + n * secs[u], v.zone, v.timeval)
    w = v.local()
    if u in ("day", "week"):
        return v.moved(w.replace(tzinfo=None) + dt.timedelta(days=n * (7 if u == "week" else 1)))
    if u not in ("year", "month"):
        raise ValueError_("invalid unit")
    total = w.year * 12 + w.month - 1 + n * (12 if u == "year" else 1)
    first = w.replace(year=total // 12, month=total % 12 + 1, day=1, tzinfo=None)
    return v.moved(first + dt.timedelta(days=w.day - 1))


@chain("move", (DateTime,), 2)
def _(q, v, unit, n):
    return moved(v, unit, want(n, (int,), "an integer"))


@chain("to", (DateTime,), 1)
def _(q, v, zone):
    out = DateTime(v.ts, zone, v.timeval)
    try:
        out.local()
    except Exception as e:
        raise ValueError_("unknown time zone") from e
    return out


@chain("zone", (DateTime,))
def _(q, v):
    return v.zone


@chain("week", (DateTime,))
def _(q, v):
    return int(v.local().strftime("%U"))


@chain("weekday", (DateTime,))
def _(q, v):
    return int(v.local().strftime("%w"))


@chain("yday", (DateTime,))
def _(q, v):
    return v.local().timetuple().tm_yday - 1


@root("time_zones_info")
def _(q):
    return List(sorted(zoneinfo.available_timezones()))


@root("is_time_zone", 1)
def _(q, v):
    return isinstance(v, str) and v in zoneinfo.available_timezones()


# -- JSON, MessagePack
@root("json_dump", 1, 2)
def _(q, v, opt=None):
    o = opt.fields if opt else {}
    return X.to_json(v, o.get("deep", q.deep if q.deep is not None else 1), o.get("flags") != 1, truthy(o.get("beautify")))


@root("json_load", 1)
def _(q, s):
    try:
        return X.from_python(json.loads(want(s, RAW, "a string")))
    except ValueError as e:
        raise ValueError_("invalid JSON") from e


@chain("load", (MpData,))
def _(q, v):
    return X.from_python(msgpack.unpack(v))


@root("export", 0, 1)
def _(q, opt=None):
    return q.scope.dump() if opt and truthy(opt.fields.get("dump")) else q.scope.script()


@root("import", 1, 2)
def _(q, data, opt=None):
    q.mutate()
    q.scope.load(want(data, (bytes,), "bytes"), bool(opt and truthy(opt.fields.get("import_tasks"))))


# -- kinds
for _name, _t in {"array": LISTS, "bool": (bool,), "closure": (ClosureValue,), "err": (Err,), "float": (float,), "future": (Future,), "list": (list,), "module": (Module,), "mpdata": (MpData,), "raw": RAW, "regex": (Rx,), "room": (Room,), "set": SETS, "str": (str,), "task": (Task,), "thing": THINGS, "tuple": (tuple,), "enum": (Member,)}.items():
    root("is_" + _name, 1)(lambda q, v, t=_t: isinstance(v, t))
root("is_int", 1)(lambda q, v: isinstance(v, int) and not isinstance(v, bool))
root("is_bytes", 1)(lambda q, v: isinstance(v, bytes) and not isinstance(v, MpData))
root("is_nil", 1)(lambda q, v: v is None)
root("is_datetime", 1)(lambda q, v: isinstance(v, DateTime) and not v.timeval)
root("is_timeval", 1)(lambda q, v: isinstance(v, DateTime) and v.timeval)
root("type", 1)(lambda q, v: kind(v))


@root("type_assert", 2, 3)
def _(q, v, names, msg=None):
    if kind(v) not in ([names] if isinstance(names, str) else names):
        raise TypeError_(msg or f"invalid type `{kind(v)}`")


# -- types and enums
@root("new_type", 1, 3)
def _(q, name, *flags):
    q.mutate()
    t = q.types()
    if name in t.types or name in t.enums or not re.fullmatch(r"[A-Za-z_]\w{0,254}", name):
        raise LookupError_(f"type or enum `{name}` already exists or the name is invalid")
    mask = flags[0] if flags and isinstance(flags[0], int) and not isinstance(flags[0], bool) else sum((1 << i) for i, f in enumerate(flags) if truthy(f))
    t.types[name] = Type(name, t, bool(mask & 1), bool(mask & 2), bool(mask & 4))
    return name


@root("set_type", 2, 4)
def _(q, name, fields, *flags):
    q.mutate()
    t = q.types()
    if name in t.types and t.types[name].fields:
        raise OperationError(f"type `{name}` already has fields")
    if name not in t.types:
        ROOT["new_type"](q, [name, *flags])
    t.types[name].define(fields.fields)


def _each(q, t):
    return [x for x in q.scope.all_things() if x.type is t]


@root("mod_type", 2, 6)
def _(q, name, action, *a):
    q.mutate()
    t = q.types().need(name)
    if action == "add":
        k, spec = a[:2]
        if k in t.fields or k in t.methods:
            raise LookupError_(f"property `{k}` already exists")
        t.define({k: spec})
        if k in t.fields:
            for x in _each(q, t):
                v = a[2] if len(a) > 2 else t.fields[k].start()
                x.fields[k] = t.fields[k].check(q.call(v, [x]) if isinstance(v, ClosureValue) else v, k)
    elif action == "del":
        if a[0] not in t.fields and a[0] not in t.methods:
            raise LookupError_(f"type `{name}` has no property `{a[0]}`")
        t.methods.pop(a[0], None)
        if t.fields.pop(a[0], None):
            for x in _each(q, t):
                x.fields.pop(a[0], None)
    elif action == "mod":
        k, spec = a[:2]
        if isinstance(spec, ClosureValue):
            t.methods[k] = spec
        else:
            new = Spec(spec, q.types())
            for x in _each(q, t):
                x.fields[k] = new.check(q.call(a[2], [x]) if len(a) > 2 else x.fields[k], k)
            t.fields[k] = new
    elif action == "ren":
        t.fields = {a[1] if k == a[0] else k: v for k, v in t.fields.items()}
        t.methods = {a[1] if k == a[0] else k: v for k, v in t.methods.items()}
        for x in _each(q, t):
            x.fields = {a[1] if k == a[0] else k: v for k, v in x.fields.items()}
    elif action == "rel":
        spec = t.fields[a[0]]
        if a[1] is None:
            other = t.relations.pop(a[0], None)
            if other:
                q.types().need(other[0]).relations.pop(other[1], None)
        else:
            q.types().relate(t, a[0], q.types().need((spec.inner or spec).base), a[1])
    elif action == "all":
        for x in _each(q, t):
            q.call(a[0], [x])
    elif action in ("wpo", "hid", "idx"):
        setattr(t, {"wpo": "wpo", "hid": "hide", "idx": "index"}[action], truthy(a[0]))
    else:
        raise ValueError_(f"unknown action `{action}`")


@root("del_type", 1)
def _(q, name):
    q.mutate()
    t = q.types().need(name)
    for x in _each(q, t):
        x.type = None
    del q.types().types[name]


@root("rename_type", 2)
def _(q, old, new):
    q.mutate()
    t = q.types().need(old)
    if new in q.types().types:
        raise LookupError_(f"type `{new}` already exists")
    t.name = new
    q.types().types = {new if k == old else k: v for k, v in q.types().types.items()}


root("has_type", 1)(lambda q, n: n in q.types().types)
root("type_info", 1)(lambda q, n: X.from_python(q.types().need(n).info()))
root("types_info")(lambda q: X.from_python([t.info() for t in q.types().types.values()]))


@root("new", 1, 2)
def _(q, name, t=None):
    return q.types().need(name).new(dict(t.fields) if t else {})


@root("ano", 1)
def _(q, t):
    return Ano(dict(t.fields))


@root("enum", 1, 2)
def _(q, name, *v):
    e = q.types().need_enum(name)
    return e.by_value(v[0]) if v else e.first()


@root("set_enum", 2)
def _(q, name, members):
    q.mutate()
    if name in q.types().types:
        raise LookupError_(f"type `{name}` already exists")
    e = Enum(name)
    for k, v in members.fields.items():
        e.add(k, v)
    if not e.members:
        raise ValueError_("an enum needs a member")
    q.types().enums[name] = e


@root("mod_enum", 3, 4)
def _(q, name, action, k, *v):
    q.mutate()
    e = q.types().need_enum(name)
    if action != "add" and k not in e.members and k not in e.methods:
        raise LookupError_(f"enum `{name}` has no member `{k}`")
    if action == "add":
        e.add(k, v[0])
    elif action == "def":
        e.default = k
    elif action == "del":
        if len(e.members) == 1 and k in e.members:
            raise LookupError_("an enum needs a member")
        e.members.pop(k, None)
        e.methods.pop(k, None)
    elif action == "mod":
        e.members[k].value = v[0]
    elif action == "ren":
        e.members = {v[0] if x == k else x: m for x, m in e.members.items()}
        e.members[v[0]].name = v[0]
    else:
        raise ValueError_(f"unknown action `{action}`")


@root("del_enum", 1)
def _(q, name):
    q.mutate()
    q.types().need_enum(name)
    del q.types().enums[name]


@root("rename_enum", 2)
def _(q, old, new):
    q.mutate()
    e = q.types().need_enum(old)
    e.name = new
    q.types().enums = {new if k == old else k: v for k, v in q.types().enums.items()}


root("has_enum", 1)(lambda q, n: n in q.types().enums)
root("enum_info", 1)(lambda q, n: X.from_python(q.types().need_enum(n).info()))
root("enum_map", 1)(lambda q, n: Thing(q.types().need_enum(n).table()))
root("enums_info")(lambda q: X.from_python([e.info() for e in q.types().enums.values()]))
chain("name", (Member, Room))(lambda q, v: v.name)
chain("value", (Member,))(lambda q, v: v.value)


# -- control, errors
@chain("call", (ClosureValue,), 0, None)
def _(q, v, *a):
    return q.call(v, list(a))


@root("closure", 0, 1)
def _(q, text="||nil"):
    if isinstance(text, ClosureValue):
        return text
    body = parse(want(text, (str,), "a string")).body
    if len(body) != 1 or body[0].kind != "closure":
        raise SyntaxError_("expecting a closure")
    return ClosureValue(body[0])


chain("closure", (Task,))(lambda q, v: v.closure)


def doc_of(c: ClosureValue) -> str:
    b = c.node.body
    first = b.body[0] if b.kind == "block" and b.body else b
    return first.value if first.kind == "lit" and isinstance(first.value, str) else ""


chain("doc", (ClosureValue,))(lambda q, v: doc_of(v))


@root("assert", 1, 2)
def _(q, c, msg="assertion statement has failed"):
    if not truthy(c):
        raise make(-50, msg)


@root("raise", 0, 1)
def _(q, e="error"):
    raise make(e.code, e.msg) if isinstance(e, Err) else make(-100, want(e, (str,), "a string"))


def _try(q, args, env):
    count("try", len(args), 1, None)
    try:
        return q.value(args[0], env)
    except LangError as e:
        if not -127 <= e.code <= -50:
            raise
        only = [q.value(a, env) for a in args[1:]]
        if only and not any(isinstance(x, Err) and x.code == e.code for x in only):
            raise
        return X.error_value(e)


def _alt_raise(q, args, env):
    count("alt_raise", len(args), 2, 3)
    try:
        return q.value(args[0], env)
    except LangError as e:
        code = q.value(args[1], env)
        raise make(code.code if isinstance(code, Err) else code, q.value(args[2], env) if len(args) > 2 else e.msg) from e


def _timeit(q, args, env):
    count("timeit", len(args), 1)
    start = time.perf_counter()
    v = q.value(args[0], env)
    return Thing({"data": v, "time": time.perf_counter() - start})


def _nse(q, args, env):
    count("nse", len(args), 0, 1)
    old, q.readonly = q.readonly, True
    if not args:
        return None
    try:
        return q.value(args[0], env)
    finally:
        q.readonly = old


def _wse(q, args, env):
    count("wse", len(args), 0, 1)
    q.mutate()
    return q.value(args[0], env) if args else None


LAZY |= {"try": _try, "alt_raise": _alt_raise, "timeit": _timeit, "nse": _nse, "wse": _wse}


@root("err", 0, 2)
def _(q, code=-100, msg=None):
    if not -127 <= code <= -50:
        raise ValueError_("error codes lie between -127 and -50")
    return Err(code, msg if msg is not None else f"error:{code}")


for _name, _code in CODES.items():
    root(_name, 0, 1)(lambda q, msg=None, c=_code, n=_name: Err(c, msg if msg is not None else n))
chain("code", (Err,))(lambda q, v: v.code)
chain("msg", (Err,))(lambda q, v: v.msg)
chain("err", (Task,))(lambda q, v: v.err)


@root("log", 1)
def _(q, v):
    log.warning("%s", X.text(v))


@root("deep", 0, 1)
def _(q, *d):
    if d:
        q.set_deep(d[0])
    return q.deep if q.deep is not None else getattr(q.scope, "deep", 1)


root("change_id")(lambda q: q.engine.changes + 1 if q.change else None)


# -- procedures, futures, modules
def _procs(q):
    if not hasattr(q.scope, "procedures"):
        raise LookupError_("this scope has no procedures")
    return q.scope.procedures


def _proc(q, name):
    if name not in _procs(q):
        raise LookupError_(f"procedure `{name}` not found")
    return _procs(q)[name]


@root("new_procedure", 2)
def _(q, name, c):
    q.mutate()
    if name in _procs(q):
        raise LookupError_(f"procedure `{name}` already exists")
    _procs(q)[name] = ClosureValue(want(c, (ClosureValue,), "a closure").node)
    return name


@root("mod_procedure", 2)
def _(q, name, c):
    q.mutate()
    _proc(q, name)
    _procs(q)[name] = ClosureValue(c.node)


@root("del_procedure", 1)
def _(q, name):
    q.mutate()
    _proc(q, name)
    del _procs(q)[name]


@root("rename_procedure", 2)
def _(q, old, new):
    q.mutate()
    _procs(q)[new] = _proc(q, old)
    del _procs(q)[old]


def _proc_info(q, name):
    from quillon.lang.parser import changes

    c = _proc(q, name)
    return Thing({"name": name, "arguments": List(c.names), "definition": c.node.text, "doc": doc_of(c), "with_side_effects": changes(c.node)})


root("has_procedure", 1)(lambda q, n: n in _procs(q))
root("procedure_doc", 1)(lambda q, n: doc_of(_proc(q, n)))
root("procedure_info", 1)(_proc_info)
root("procedures_info")(lambda q: List(_proc_info(q, n) for n in _procs(q)))


@root("run", 1, None)
def _(q, name, *a):
    q.engine.may(q.user, q.scope, 16)
    return q.call(_proc(q, name), list(a))


@root("future", 1, None)
def _(q, what, *a):
    if len(q.futures) >= MAX_FUTURES:
        raise make(-57, "too many futures")
    if isinstance(what, ClosureValue):
        f = Future(lambda: q.call(what, list(a)))
    elif what is None:
        f = Future(lambda: a[0] if len(a) == 1 else List(a) if a else None)
    else:
        f = Future(lambda: q.engine.call_module(q, want(what, THINGS, "a thing").fields.get("module"), [what, *a]))
    q.futures.append(f)
    return f


@chain("then", (Future,), 1)
def _(q, v, f):
    if v.then is not None:
        raise OperationError("a future has one then")
    v.then = f
    return v


@chain("else", (Future,), 1)
def _(q, v, f):
    if v.other is not None:
        raise OperationError("a future has one else")
    v.other = f
    return v


def _module(q, name):
    if name not in q.engine.modules:
        raise LookupError_(f"module `{name}` not found")
    return q.engine.modules[name]


@root("new_module", 2, 3)
def _(q, name, source, conf=None):
    if name in q.engine.modules:
        raise LookupError_(f"module `{name}` already exists")
    q.engine.modules[name] = Module(name, source, conf)


def _set_module(q, name, **change):
    m = _module(q, name)
    for k, v in change.items():
        setattr(m, k, v)


root("deploy_module", 2)(lambda q, n, data: q.engine.deploy(_module(q, n), data))
root("set_module_conf", 2)(lambda q, n, c: _set_module(q, n, conf=c))
root("set_module_scope", 2)(lambda q, n, s: _set_module(q, n, scope=s))
root("refresh_module restart_module", 1)(lambda q, n: q.engine.start_module(_module(q, n)))
root("del_module", 1)(lambda q, n: q.engine.modules.pop(_module(q, n).name) and None)
root("has_module", 1)(lambda q, n: n in q.engine.modules)


@root("rename_module", 2)
def _(q, old, new):
    m = _module(q, old)
    del q.engine.modules[old]
    m.name = new
    q.engine.modules[new] = m


def _module_info(q, n):
    m = _module(q, n)
    return Thing({"name": m.name, "source": m.source, "conf": m.conf, "scope": m.scope, "status": "running" if m.run else "not loaded"})


root("module_info", 1)(_module_info)
root("modules_info")(lambda q: List(_module_info(q, n) for n in q.engine.modules))


# -- rooms, tasks
@root("room", 0, 1)
def _(q, *a):
    return q.scope.room(*a)


@chain("emit", (Room,), 1, None)
def _(q, v, *a):
    a = list(a)
    deep, ids = 1, True
    if isinstance(a[0], int):
        deep = a.pop(0)
        if a and isinstance(a[0], int):
            ids = a.pop(0) != 1
    q.engine.emit(v, want(a[0], (str,), "an event name"), [X.output(x, deep, ids) for x in a[1:]])


@chain("set_name", (Room,), 1, 1, 2)
def _(q, v, name):
    q.scope.name_room(v, name)


@root("task", 0, 3)
def _(q, *a):
    if not a:
        return Task(None, None, None, [], q.user.name)
    if isinstance(a[0], int) and len(a) == 1:
        return q.scope.task(a[0])
    q.mutate()
    if len(q.scope.tasks) >= MAX_TASKS:
        raise make(-57, "too many tasks")
    at = a[0] if isinstance(a[0], DateTime) else DateTime(int(number(a[0])))
    if not 0 <= at.ts < 1 << 32:
        raise ValueError_("start time is out of range")
    return q.scope.new_task(at, want(a[1], (ClosureValue,), "a closure"), list(a[2]) if len(a) > 2 else [], q.user.name)


root("tasks")(lambda q: List(q.scope.tasks.values()))
chain("at", (Task,))(lambda q, v: v.at)
chain("args", (Task,))(lambda q, v: List(v.args))
chain("owner", (Task,))(lambda q, v: v.owner)


def _set_task(name):
    def run(q, v, x):
        q.mutate()
        setattr(v, name, list(x) if name == "args" else x)

    return run


chain("set_args", (Task,), 1)(_set_task("args"))
chain("set_closure", (Task,), 1)(_set_task("closure"))


@chain("set_owner", (Task,), 1, 1, 2)
def _(q, v, name):
    q.engine.need_user(name)
    v.owner = name


@chain("again_at", (Task,), 1, 1, 2)
def _(q, v, at):
    if q.task is not v:
        raise OperationError("again_at works inside the task")
    v.at = at if isinstance(at, DateTime) else DateTime(int(at))


@chain("again_in", (Task,), 2, 2, 2)
def _(q, v, unit, n):
    """The first slot behind now."""
    if q.task is not v:
        raise OperationError("again_in works inside the task")
    at, k = v.last, 1
    while True:
        at = moved(v.last, unit, n * k)
        if at.ts > q.engine.clock():
            break
        k += 1
    v.at = at


@chain("cancel", (Task,), 0, 0, 2)
def _(q, v):
    v.at = None


@chain("del", (Task,), 0, 0, 2)
def _(q, v):
    q.scope.tasks.pop(v.id, None)
    v.id = v.at = None


def admin(name: str, low: int, high: int | None = -1):
    """A function that the engine's registry has under the same name."""
    for n in name.split():
        root(n, low, high)(lambda q, *a, n=n: X.from_python(getattr(q.engine, "do_" + n.strip())(q, *a)))


admin("new_collection del_collection has_collection collection_info", 1)
admin("rename_collection set_default_deep set_time_zone", 2)
admin("collections_info backups_info backups_ok users_info del_expired node_info nodes_info counters reset_counters shutdown", 0)
admin("new_backup", 1, 4)
admin("del_backup", 1, 2)
admin("has_backup backup_info commit", 1)
admin("restore", 1, 2)
admin("history del_history", 0, 1)
admin("set_history", 2)
admin("new_user del_user has_user", 1)
admin("rename_user set_password", 2)
admin("user_info", 0, 1)
admin("new_token", 1, 3)
admin("del_token has_token has_node del_node set_log_level", 1)
admin("grant revoke", 3)
admin("whitelist_add whitelist_del", 2, 3)
admin("new_node", 2, 3)

