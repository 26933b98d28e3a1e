"""The driver's interpreter: statements, expressions and calls over values; tables stay lazy.

A method of a table (a Coll) compiles its closures and extends the plan; only scalars come back.
"""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import functions as F

from quillon.errors import LangError, LookupError_, NumArgumentsError, OperationError, TypeError_, ValueError_
from quillon.lang.compile import CONSTANTS, Closure, Rx
from quillon.lang.parser import Node
from quillon.operators.collection import Coll
from quillon.runtime import values as X
from quillon.runtime.values import Ano, ClosureValue, DateTime, Future, List, Member, Module, Room, Task, Thing, TSet, Wrap, arith, compare, eq, is_list, kind, nested, truthy

MAX_CALLS = 24


class Return(Exception):
    def __init__(self, value: Any):
        self.value = value


class Loop(Exception):
    def __init__(self, stop: bool):
        self.stop = stop


def count(name: str, given: int, low: int, high: int | None = None) -> None:
    if given < low or (high is not None and given > high):
        raise NumArgumentsError(f"function `{name}` takes {low}{f' to {high}' if high != low else ''} arguments but {given} were given")


class Interp:
    """One query. `scope` is a Collection, the admin scope or the node scope (see engine)."""

    def __init__(self, engine: Any, scope: Any, user: Any, args: dict[str, Any], readonly: bool = False, task: Task | None = None):
        self.engine, self.scope, self.user, self.readonly, self.task = engine, scope, user, readonly, task
        self.vars = dict(args)
        self.deep, self.ids, self.calls, self.change, self.futures = None, True, 0, False, []

    # -- trees
    def value(self, n: Node, env: dict[str, Any]) -> Any:
        return getattr(self, "_" + n.kind)(n, env)

    def program(self, node: Node) -> Any:
        try:
            out = self._block(node, self.vars, new=False)
        except Return as r:
            out = r.value
        return self.finish(out)

    def finish(self, out: Any) -> Any:
        """Futures run after the query's own code."""
        while self.futures:
            f = self.futures.pop(0)
            r = self.settle(f)
            if f is out:
                out = r
        return out

    def settle(self, f: Future) -> Any:
        try:
            r = f.run()
        except LangError as e:
            if f.other is None:
                raise
            return self.call(f.other, [X.error_value(e)])
        return r if f.then is None else self.call(f.then, [r])

    def mutate(self) -> None:
        if self.readonly:
            raise OperationError("this context allows no side effects")
        self.change = True

    def _lit(self, n, env):
        return n.value

    def _paren(self, n, env):
        return self.value(n.value, env)

    def _regex(self, n, env):
        return Rx(n.pattern, n.flags)

    def _template(self, n, env):
        return "".join(X.text(self.value(p, env)) for p in n.parts)

    def _list(self, n, env):
        return List(nested(self.value(x, env)) for x in n.items)

    def _thing(self, n, env):
        return Thing({k: self.value(x, env) for k, x in n.fields})

    def _ano(self, n, env):
        return Ano({k: self.value(x, env) for k, x in n.fields})

    def _instance(self, n, env):
        return self.types().need(n.name).new({k: self.value(x, env) for k, x in n.fields})

    def _enum(self, n, env):
        e = self.types().need_enum(n.name)
        if n.by is not None:
            return e.by_value(self.call(self._closure(n.by, env), []))
        if n.member not in e.members:
            raise LookupError_(f"enum `{n.name}` has no member `{n.member}`")
        return e.members[n.member]

    def _var(self, n, env):
        if n.name in env:
            return env[n.name]
        if n.name in CONSTANTS:
            return CONSTANTS[n.name]
        raise LookupError_(f"variable `{n.name}` is undefined")

    def _root(self, n, env):
        return self.root()

    def root(self) -> Thing:
        if not hasattr(self.scope, "root"):
            raise LookupError_("this scope has no root")
        return self.scope.root

    def types(self) -> Any:
        if not hasattr(self.scope, "types"):
            raise LookupError_("this scope has no types")
        return self.scope.types

    def _closure(self, n, env):
        return ClosureValue(n, env)

    def _block(self, n, env, new=True):
        out = None
        for x in n.body:
            out = self.value(x, env)
        return out

    def _return(self, n, env):
        v = [self.value(x, env) for x in n.values]
        if len(v) > 1:
            self.set_deep(v[1])
        if len(v) > 2 and v[2] == CONSTANTS["NO_IDS"]:
            self.ids = False
        raise Return(v[0] if v else None)

    def set_deep(self, d: Any) -> None:
        if not isinstance(d, int) or not 0 <= d <= 127:
            raise ValueError_("deep must be between 0 and 127")
        self.deep = d

    def _if(self, n, env):
        c = self.value(n.cond, env)
        if truthy(c):
            return self.value(n.then, env)
        return self.value(n.other, env) if n.other else c

    def _ternary(self, n, env):
        return self.value(n.then if truthy(self.value(n.cond, env)) else n.other, env)

    def _for(self, n, env):
        over = self.value(n.over, env)
        for pair in self.pairs(over):
            env.update(zip(n.names, pair, strict=False))
            try:
                self.value(n.body, env)
            except Loop as e:
                if e.stop:
                    break
        return None

    def pairs(self, v: Any) -> list[tuple]:
        if is_list(v):
            return [(x, i) for i, x in enumerate(list(v))]
        if isinstance(v, TSet):
            return [(x, x.id) for x in v]
        if isinstance(v, Thing):
            return list(v.fields.items())
        if isinstance(v, Coll):
            return [(X.from_python(x), i) for i, x in enumerate(v.list())]
        raise TypeError_(f"type `{kind(v)}` is not iterable")

    def _continue(self, n, env):
        raise Loop(False)

    def _break(self, n, env):
        raise Loop(True)

    def _prefix(self, n, env):
        v = self.value(n.value, env)
        for o in reversed(n.ops):
            if o == "!":
                v = not truthy(v)
            elif o == "~":
                if not isinstance(v, int):
                    raise TypeError_(f"`~` not supported for `{kind(v)}`")
                v = ~int(v)
            elif not isinstance(v, (bool, int, float)):
                raise TypeError_(f"`{o}` not supported for `{kind(v)}`")
            else:
                v = +v if o == "+" else -v if isinstance(v, float) else X.checked(-int(v))
        return v

    def _logic(self, n, env):
        a = self.value(n.left, env)
        return a if truthy(a) == (n.op == "||") else self.value(n.right, env)

    def _binary(self, n, env):
        return self.operate(n.op, self.value(n.left, env), self.value(n.right, env))

    def operate(self, op: str, a: Any, b: Any) -> Any:
        if isinstance(a, Coll) and isinstance(b, Coll):
            f = {"|": a.union, "&": a.intersect, "-": a.difference, "^": a.symmetric, "<=": a.subset_of, "<": lambda o: a.subset_of(o, True), ">=": lambda o: o.subset_of(a), ">": lambda o: o.subset_of(a, True)}.get(op)
            if f is None:
                raise TypeError_(f"`{op}` not supported between tables")
            return f(b)
        if op == "==":
            return eq(a, b)
        if op == "!=":
            return not eq(a, b)
        if op in ("<", "<=", ">", ">="):
            if isinstance(a, TSet) and isinstance(b, TSet):
                x, y = a.items.keys(), b.items.keys()
                return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
            c = compare(a, b, op)
            return {"<": c == -1, "<=": c in (-1, 0), ">": c == 1, ">=": c in (0, 1)}[op]
        return arith(op, X.plain(a), X.plain(b))

    def _assign(self, n, env):
        t = n.target
        if t.kind == "var":
            v = self.value(n.value, env)
            env[t.name] = v if n.op == "=" else self.operate(n.op[:-1], self._var(t, env), v)
            return env[t.name]
        if t.kind == "slice":
            items = self.value(t.value, env)
            part = slice(*(None if x is None else self.value(x, env) for x in (t.start, t.stop, t.step)))
            new = self.value(n.value, env)
            if not isinstance(items, List) or not is_list(new):
                raise TypeError_("slice assignments are for lists")
            items[part] = [nested(x) for x in new]
            return new
        holder = self.value(t.value, env)
        name = t.name if t.kind == "prop" else self.value(t.at, env)
        v = self.value(n.value, env)
        if n.op != "=":
            v = self.operate(n.op[:-1], self.item(holder, name) if t.kind == "index" else self.prop(holder, name), v)
        if isinstance(holder, List):
            if not isinstance(name, int) or not -len(holder) <= name < len(holder):
                raise LookupError_("index out of range")
            holder[name] = self.restricted(holder, nested(v))
            return v
        if not isinstance(holder, Thing):
            raise TypeError_(f"type `{kind(holder)}` does not support assignments")
        self.set_prop(holder, name, v)
        return v

    def restricted(self, holder: Any, v: Any) -> Any:
        if getattr(holder, "restriction", None):
            from quillon.runtime.types import Spec

            return Spec(holder.restriction, getattr(self.scope, "types", None)).check(v, "item")
        return v

    def set_prop(self, t: Thing, name: str, v: Any) -> None:
        if t.id is not None:
            self.mutate()
        if t.type is not None:
            t.type.types.set(t, name, v)
        else:
            t.fields[name] = self.restricted(t, List(v) if isinstance(v, tuple) else v)
        if t.id is not None and hasattr(self.scope, "store"):
            self.scope.store(t.fields[name])

    def _prop(self, n, env):
        return self.prop(self.value(n.value, env), n.name)

    def prop(self, v: Any, name: str) -> Any:
        if isinstance(v, Wrap):
            v = v.thing
        if isinstance(v, Thing):
            if name in v.fields:
                found = v.fields[name]
                if isinstance(found, TSet) and v.type is not None and name in v.type.relations:
                    found.home = (v, name)
                return found
            raise LookupError_(f"thing has no property `{name}`")
        raise LookupError_(f"type `{kind(v)}` has no property `{name}`")

    def _index(self, n, env):
        return self.item(self.value(n.value, env), self.value(n.at, env))

    def item(self, v: Any, i: Any) -> Any:
        if isinstance(v, Thing):
            return self.prop(v, i)
        if isinstance(v, Coll):
            got = v.slice(i, i + 1 if i != -1 else None).list()
            if not got:
                raise LookupError_("index out of range")
            return X.from_python(got[0])
        if not isinstance(i, int) or isinstance(i, bool):
            raise TypeError_("an index must be an integer")
        raw = v.encode() if isinstance(v, str) else v
        if not isinstance(raw, (bytes, list, tuple)):
            raise TypeError_(f"type `{kind(v)}` is not indexable")
        if not -len(raw) <= i < len(raw):
            raise LookupError_("index out of range")
        if isinstance(raw, bytes):
            i %= len(raw)
            b = raw[i : i + 1]
            return b.decode("utf-8", "replace") if isinstance(v, str) else b
        return raw[i]

    def _slice(self, n, env):
        v = self.value(n.value, env)
        part = [None if x is None else self.value(x, env) for x in (n.start, n.stop, n.step)]
        if part[2] == 0:
            raise ValueError_("slice step value cannot be zero")
        if isinstance(v, Coll):
            return v.slice(*part)
        if isinstance(v, str):
            return v.encode()[slice(*part)].decode("utf-8", "replace")
        if isinstance(v, bytes):
            return v[slice(*part)]
        if is_list(v):
            return List(v[slice(*part)])
        raise TypeError_(f"type `{kind(v)}` has no slices")

    # -- calls
    def call(self, f: Any, args: list[Any]) -> Any:
        if not isinstance(f, ClosureValue):
            raise TypeError_(f"type `{kind(f)}` is not callable")
        if self.calls >= MAX_CALLS:
            raise OperationError("maximum recursion depth exceeded")
        self.calls += 1
        env = Frame(f.env, dict(zip(f.names, args, strict=False)), f.names)
        try:
            return self.value(f.node.body, env)
        except Return as r:
            return r.value
        finally:
            self.calls -= 1

    def fn(self, f: Any):
        if not isinstance(f, ClosureValue):
            raise TypeError_(f"expecting a closure but got `{kind(f)}`")
        return lambda *a: self.call(f, list(a))

    def _call(self, n, env):
        from quillon.functions.builtins import LAZY, ROOT

        name = n.name
        if name in LAZY:
            return LAZY[name](self, n.args, env)
        if name in ROOT:
            return ROOT[name](self, [self.value(a, env) for a in n.args])
        args = [self.value(a, env) for a in n.args]
        if hasattr(self.scope, "types"):
            if name in self.scope.types.types:
                count(name, len(args), 0, 1)
                if args and isinstance(args[0], int):
                    table = self.engine.typed.get((self.scope.name, name))
                    if table is not None and table.key is not None:
                        got = table.made(table.rows.where(F.col("`#`") == args[0]), order=[]).list()
                        if not got:
                            raise LookupError_(f"thing {args[0]} not found")
                        return X.from_python(got[0])
                    t = self.scope.by_id(args[0])
                    if t.type is None or t.type.name != name:
                        raise TypeError_(f"the thing with this id is not of type `{name}`")
                    return t
                return self.scope.types.types[name].new(dict(args[0].fields) if args else {})
            if name in self.scope.types.enums:
                return self.scope.types.enums[name].by_value(args[0]) if args else self.scope.types.enums[name].first()
        if name in getattr(self.scope, "procedures", {}):
            return self.call(self.scope.procedures[name], args)
        if isinstance(env.get(name), ClosureValue):
            return self.call(env[name], args)
        if name in self.engine.modules:
            return self.engine.call_module(self, name, args)
        raise LookupError_(f"function `{name}` is undefined")

    def _method(self, n, env):
        from quillon.functions.builtins import CHAIN, LAZY_CHAIN

        v = self.value(n.value, env)
        if isinstance(v, Coll):
            return self.table_call(v, n.name, [self.value(a, env) for a in n.args])
        if n.name in LAZY_CHAIN:
            return LAZY_CHAIN[n.name](self, v, n.args, env)
        args = [self.value(a, env) for a in n.args]
        f = CHAIN.get(n.name)
        if f is not None and f.takes(v):
            return f(self, v, args)
        thing = v.thing if isinstance(v, Wrap) else v
        owner = v.view if isinstance(v, Wrap) and hasattr(v.view, "methods") else getattr(thing, "type", None) if isinstance(thing, Thing) else v.enum if isinstance(v, Member) else None
        if owner is not None and n.name in owner.methods:
            return self.call(owner.methods[n.name], [v, *args])
        if isinstance(thing, Thing) and isinstance(thing.fields.get(n.name), ClosureValue):
            return self.call(thing.fields[n.name], args)
        if isinstance(v, Module):
            return self.engine.call_module(self, v.name, [n.name, *args])
        raise LookupError_(f"type `{kind(v)}` has no function `{n.name}`")

    def table_call(self, t: Coll, name: str, args: list[Any]) -> Any:
        """Closures are compiled to Columns, with the driver's variables as literals."""
        args = [Closure(a.names, a.node.body, {k: X_lit(v) for k, v in Frame.flat(a.env).items() if literal(v)}, t.compiler, a.node.text) if isinstance(a, ClosureValue) else X.output(a, 8) if isinstance(a, (Thing, TSet, DateTime, Member)) else a for a in args]
        if name in ("wrap", "map_wrap"):
            view = args[0] if args else None
            spec = {k: s.text for k, s in self.types().need(view).fields.items()} if isinstance(view, str) else view.spec if isinstance(view, Ano) else {}
            return t.wrap(spec)
        if name == "remove":
            left, gone = t.remove(*args)
            t.rows, t.order = left.rows, left.order
            return gone
        if name == "find" and len(args) > 1 and isinstance(args[1], Closure):
            args[1] = None
        if name == "clear":
            t.rows = t.clear().rows
            return None
        f = getattr(t, name, None) if name in TABLE_FUNCTIONS else None
        if f is None:
            raise LookupError_(f"type `table` has no function `{name}`")
        out = f(*args)
        return out if isinstance(out, Coll) else X.from_python(out)


#: Functions of the language that tables have; other attributes of a collection are no functions of the language.
TABLE_FUNCTIONS = frozenset(
    "filter map vmap each reduce find find_index index_of some every has contains get len flat copy dup map_id first last one choice equals "
    "count sum min max unique is_unique sort reverse splice extend extend_unique fill remove join list".split()
)


class Frame(dict):
    """Variables of a call: parameters are its own, others are those of the place where the closure stands."""

    def __init__(self, outer: Any, own: dict[str, Any], names: list[str]):
        super().__init__(own)
        self.outer, self.own = outer, set(names)

    def __contains__(self, k):
        return dict.__contains__(self, k) or k in self.outer

    def __getitem__(self, k):
        return dict.__getitem__(self, k) if dict.__contains__(self, k) else self.outer[k]

    def __setitem__(self, k, v):
        if k in self.own or k not in self.outer:
            dict.__setitem__(self, k, v)
        else:
            self.outer[k] = v

    def get(self, k, default=None):
        return self[k] if k in self else default

    @staticmethod
    def flat(env: Any) -> dict[str, Any]:
        return {**(Frame.flat(env.outer) if isinstance(env, Frame) else {}), **env}


def literal(v: Any) -> bool:
    return v is None or isinstance(v, (bool, int, float, str, bytes, DateTime)) or (is_list(v) and all(map(literal, v)))


def X_lit(v: Any) -> Any:  # noqa: N802
    import datetime as dt

    from quillon.functions.semantics import lit

    return lit(dt.datetime.fromtimestamp(v.ts, dt.UTC) if isinstance(v, DateTime) else list(v) if is_list(v) else v)


