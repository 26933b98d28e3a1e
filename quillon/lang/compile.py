"""From syntax trees to Columns: closures are inlined, so Catalyst sees plain expressions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import LookupError_, OperationError, SyntaxError_, TypeError_
from quillon.functions import semantics as S
from quillon.functions.columns import CHAIN, ROOT
from quillon.functions.semantics import STR, V, lit
from quillon.lang.parser import Node, parse

#: Fixed values of the language.
CONSTANTS = {
    "QUERY": 1,
    "CHANGE": 2,
    "GRANT": 4,
    "JOIN": 8,
    "RUN": 16,
    "USER": 27,
    "FULL": 31,
    "DEBUG": 0,
    "INFO": 1,
    "WARNING": 2,
    "ERROR": 3,
    "CRITICAL": 4,
    "NO_IDS": 1,
    "INT_MIN": -(1 << 63),
    "INT_MAX": (1 << 63) - 1,
    "MATH_E": 2.718281828459045,
    "MATH_PI": 3.141592653589793,
    "WPO": 1,
    "HID": 2,
    "IDX": 4,
}
MAX_CALLS = 24


class Rx:
    """A regular expression; PCRE flags i, m, s and x are put in front of the pattern."""

    def __init__(self, pattern: str, flags: str = ""):
        self.pattern, self.flags = pattern, flags

    def java(self) -> str:
        on = "".join(f for f in self.flags if f in "imsx")
        return (f"(?{on})" if on else "") + self.pattern


class Closure:
    """Parameters, a body, and what the body sees. `apply` inlines it."""

    def __init__(self, names: list[str], body: Node, env: dict[str, Any], compiler: Compiler, text: str = ""):
        self.names, self.body, self.env, self.compiler, self.text = names, body, env, compiler, text

    @property
    def arity(self) -> int:
        return len(self.names)

    def apply(self, *values: V) -> V:
        if self.compiler.calls >= MAX_CALLS:
            raise OperationError("maximum recursion depth exceeded")
        self.compiler.calls += 1
        try:
            return self.compiler.value(self.body, dict(self.env) | dict(zip(self.names, values, strict=False)))
        finally:
            self.compiler.calls -= 1


class Compiler:
    """Compiles trees against an environment of V, closures, and functions (name -> closure text)."""

    def __init__(self, procedures: dict[str, str] | None = None, enums: dict[str, dict[str, Any]] | None = None, methods: dict[str, Closure] | None = None):
        self.procedures, self.enums, self.methods, self.calls = procedures or {}, enums or {}, methods or {}, 0

    # -- helpers that built-ins use
    def constant(self, v: Any) -> Any:
        if isinstance(v, V) and v.constant:
            return v.value
        raise TypeError_("this argument must be a literal in a table query")

    def is_regex(self, v: Any) -> bool:
        return isinstance(v, Rx)

    def regex(self, v: Any) -> str:
        if not isinstance(v, Rx):
            raise TypeError_("expecting a regular expression")
        return v.java()

    def regex_flags(self, v: Rx) -> str:
        return v.flags

    # -- trees
    def closure(self, text: str, env: dict[str, Any] | None = None) -> Closure:
        node = parse(text).body
        if len(node) != 1 or node[0].kind != "closure":
            raise SyntaxError_("expecting a closure")
        return self.value(node[0], env or {})

    def value(self, n: Node, env: dict[str, Any]) -> Any:
        return getattr(self, "_" + n.kind)(n, env)

    def _lit(self, n, env):
        return lit(n.value)

    def _paren(self, n, env):
        return self.value(n.value, env)

    def _regex(self, n, env):
        return Rx(n.pattern, n.flags)

    def _template(self, n, env):
        return V(F.concat(F.lit(""), *(ROOT["str"]([self.value(p, env)], self).c for p in n.parts)), STR)

    def _list(self, n, env):
        items = [self.value(x, env) for x in n.items]
        return lit([x.value for x in items]) if items and all(x.constant for x in items) else S.list_of(items)

    def _thing(self, n, env):
        return S.thing_of({k: self.value(x, env) for k, x in n.fields})

    _ano = _thing

    def _var(self, n, env):
        if n.name in env:
            return env[n.name]
        if n.name in CONSTANTS:
            return lit(CONSTANTS[n.name])
        raise LookupError_(f"variable `{n.name}` is undefined")

    def _root(self, n, env):
        if "" in env:
            return env[""]
        raise LookupError_("no root in a table query")

    def _closure(self, n, env):
        return Closure(n.names, n.body, env, self, n.text)

    def _block(self, n, env):
        env = dict(env)
        out = lit(None)
        for i, x in enumerate(n.body):
            if x.kind == "return" and i < len(n.body) - 1:
                raise SyntaxError_("return must be last in a table query")
            out = self.value(x, env)
        return out

    def _return(self, n, env):
        return self.value(n.values[0], env) if n.values else lit(None)

    def _assign(self, n, env):
        if n.target.kind != "var":
            raise OperationError("rows of a table query are immutable; build a new value instead")
        v = self.value(n.value, env)
        if n.op != "=":
            v = S.arith(n.op[:-1], env[n.target.name], v)
        env[n.target.name] = v
        return v

    def _if(self, n, env):
        cond = self.value(n.cond, env)
        return S.either(S.truthy(cond), self.value(n.then, env), self.value(n.other, env) if n.other else cond)

    def _ternary(self, n, env):
        return S.either(S.truthy(self.value(n.cond, env)), self.value(n.then, env), self.value(n.other, env))

    def _for(self, n, env):
        raise OperationError("a loop needs the driver; use reduce, map or filter in a table query")

    _continue = _break = _for

    def _prefix(self, n, env):
        return S.prefix(n.ops, self.value(n.value, env))

    def _logic(self, n, env):
        return S.logic(n.op, self.value(n.left, env), self.value(n.right, env))

    def _binary(self, n, env):
        a, b = self.value(n.left, env), self.value(n.right, env)
        if n.op in ("<", "<=", ">", ">=") and a.kind == b.kind == "list":
            return S.subset(n.op, a, b)
        if n.op in ("==", "!=", "<", "<=", ">", ">="):
            return S.compare(n.op, a, b)
        return S.arith(n.op, a, b)

    def _prop(self, n, env):
        return self.prop(self.value(n.value, env), n.name)

    def prop(self, v: V, name: str) -> Any:
        if isinstance(v.t, T.VariantType):
            return V(F.try_variant_get(v.c, f"$.{name}", "string"), STR)
        if isinstance(v.t, T.StructType) and v.t != S.ERROR:
            f = next((f for f in v.t.fields if f.name == name), None)
            if f is not None:
                return S.of_field(v.c[name], f.dataType)
        elif isinstance(v.t, T.MapType):
            return V(S.guard(~F.map_contains_key(v.c, F.lit(name)), "lookup_err", f"thing has no property `{name}`", F.try_element_at(v.c, F.lit(name))), v.t.valueType)
        raise LookupError_(f"type `{v.kind}` has no property `{name}`")

    def _index(self, n, env):
        v, i = self.value(n.value, env), self.value(n.at, env)
        if v.kind == "list":
            i = S.number(i, "index").c
            at = F.when(i < 0, F.size(v.c) + i).otherwise(i).cast("int")
            return V(S.guard((at < 0) | (at >= F.size(v.c)), "lookup_err", "index out of range", F.get(v.c, at)), v.t.elementType)
        if v.kind in ("str", "bytes"):
            b, k = v.c.cast("binary"), S.number(i, "index").c
            at = F.when(k < 0, F.octet_length(b) + k).otherwise(k).cast("int")
            out = F.substring(b, at + 1, F.lit(1))
            return V(S.guard((at < 0) | (at >= F.octet_length(b)), "lookup_err", "index out of range", out if v.kind == "bytes" else out.cast("string")), v.t)
        return self.prop(v, self.constant(i))

    def _slice(self, n, env):
        v = self.value(n.value, env)
        part = [None if x is None else self.value(x, env) for x in (n.start, n.stop, n.step)]
        step = 1 if part[2] is None else self.constant(part[2])
        size = (F.size(v.c) if v.kind == "list" else F.octet_length(v.c)).cast("bigint")
        if step == 0:
            return V(S.fail("value_err", "slice step cannot be zero").cast(v.t), v.t)

        def bound(p, default, low, high):
            if p is None or p.kind == "nil":
                return default
            c = S.number(p, "slice").c
            return F.greatest(F.least(F.when(c < 0, size + c).otherwise(c), high), low)

        if step > 0:
            lo, hi = bound(part[0], F.lit(0).cast("bigint"), F.lit(0), size), bound(part[1], size, F.lit(0), size)
        else:
            lo, hi = bound(part[0], size - 1, F.lit(-1), size - 1), bound(part[1], F.lit(-1).cast("bigint"), F.lit(-1), size - 1)
        count = F.greatest(F.ceil((hi - lo).cast("double") / step).cast("bigint"), F.lit(0))
        if v.kind == "list":
            if step == 1:
                return V(F.slice(v.c, lo.cast("int") + 1, count.cast("int")), v.t)
            at = F.when(count > 0, F.sequence(lo, lo + (count - 1) * step, F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
            return V(F.transform(at, lambda i: F.get(v.c, i.cast("int"))), v.t)
        b = v.c.cast("binary")
        if step == 1:
            out = F.substring(b, lo.cast("int") + 1, count.cast("int"))
        else:
            at = F.when(count > 0, F.sequence(lo, lo + (count - 1) * step, F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
            out = F.aggregate(F.transform(at, lambda i: F.substring(b, i.cast("int") + 1, F.lit(1))), F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x))
        return V(out if v.kind == "bytes" else out.cast("string"), v.t)

    def _enum(self, n, env):
        members = self.enums.get(n.name)
        if members is None or (n.member and n.member not in members):
            raise LookupError_(f"enum `{n.name}` has no member `{n.member}`")
        return lit(members[n.member])

    def _instance(self, n, env):
        return self._thing(n, env)

    def _call(self, n, env):
        if n.name in env and isinstance(env[n.name], Closure):
            return env[n.name].apply(*(self.value(a, env) for a in n.args))
        if n.name == "try":
            raise OperationError("try catches errors of a whole query, not of a row")
        if n.name == "regex":
            parts = [self.constant(self.value(a, env)) for a in n.args]
            return Rx(*parts)
        if n.name == "run":
            name = self.constant(self.value(n.args[0], env))
            return self.procedure(name).apply(*(self.value(a, env) for a in n.args[1:]))
        if n.name == "enum_map":
            return lit(dict(self.enums[self.constant(self.value(n.args[0], env))]))
        if n.name in ROOT:
            return ROOT[n.name]([self.value(a, env) for a in n.args], self)
        if n.name in self.procedures:
            return self.procedure(n.name).apply(*(self.value(a, env) for a in n.args))
        raise LookupError_(f"function `{n.name}` is undefined in a table query")

    def procedure(self, name: str) -> Closure:
        if name not in self.procedures:
            raise LookupError_(f"procedure `{name}` not found")
        return self.closure(self.procedures[name])

    def _method(self, n, env):
        v = self.value(n.value, env)
        args = [self.value(a, env) for a in n.args]
        if isinstance(v, Closure) and n.name == "call":
            return v.apply(*args)
        if n.name in self.methods and getattr(v, "kind", "") == "thing":
            return self.methods[n.name].apply(v, *args)
        if n.name in CHAIN:
            return CHAIN[n.name](v, args, self)
        raise LookupError_(f"type `{getattr(v, 'kind', 'regex')}` has no function `{n.name}`")



