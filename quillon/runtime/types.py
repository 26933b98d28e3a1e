"""Types, field specs, enums and relations of a collection."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.errors import LookupError_, TypeError_, ValueError_
from quillon.functions import semantics as S
from quillon.functions.columns import EMAIL, TEL, URL
from quillon.lang.compile import Rx
from quillon.runtime.values import ClosureValue, DateTime, Err, List, Member, Room, Thing, TSet, eq, is_list, kind, output, truthy

_NUMERIC = {"uint": (0, None), "pint": (1, None), "nint": (None, -1)}
_SHAPES = {"email": EMAIL, "url": URL, "tel": TEL}
_PLAIN = {"any", "thing", "raw", "str", "utf8", "bytes", "int", "uint", "pint", "nint", "float", "number", "bool", "datetime", "timeval", "regex", "closure", "error", "room", "task", "email", "url", "tel", "[]", "{}"}


class Spec:
    """A parsed field declaration: flags, base, what items must be, range, pattern, default, nillable."""

    def __init__(self, text: str, types: Types | None = None):
        self.text, self.types = text, types
        m = re.fullmatch(r"([&\-+^*?!]*)(.*?)(\??)", text.strip(), re.S)
        self.flags, body, self.nillable = m[1], m[2], bool(m[3]) and not m[2].endswith("/")
        self.low = self.high = self.default = self.pattern = self.inner = self.member = self.view = None
        self.has_default = False
        if body.startswith("/"):
            self.base = "pattern"
            end = body.rfind("/")
            if m := re.match(r"(.*)<(.*)>$", body, re.S):
                end, self.default, self.has_default = m[1].rfind("/"), m[2], True
            self.pattern = body[1:end]
        elif body.startswith("{") and ":" in body or body.startswith("[{"):
            self.base, self.view = ("list" if body[0] == "[" else "view"), body.strip("[]")
        elif body.startswith("[") and body.endswith("]"):
            self.base, self.inner = "list", Spec(body[1:-1], types) if body[1:-1] else None
        elif body.startswith("{") and body.endswith("}"):
            self.base, self.inner = "set", Spec(body[1:-1], types) if body[1:-1] else None
        elif m := re.fullmatch(r"thing<(.+)>", body):
            self.base, self.inner = "thing", Spec(m[1], types)
        elif m := re.fullmatch(r"(int|float|str|utf8)<(.*?):(.*?)(?::(.*))?>", body, re.S):
            self.base = m[1]
            cast = float if m[1] == "float" else int
            self.low, self.high = (cast(x) if x else None for x in m.group(2, 3))
            if self.low is not None and self.high is not None and self.high < self.low:
                raise ValueError_(f"invalid range in `{text}`")
            if m[4] is not None:
                self.default, self.has_default = (cast(m[4]) if m[1] in ("int", "float") else m[4]), True
        elif m := re.fullmatch(r"(bool|str|utf8|int|float|email|url|tel)<(.*)>", body, re.S):
            self.base, raw = m[1], m[2]
            self.default, self.has_default = {"bool": lambda: raw == "true", "int": lambda: int(raw), "float": lambda: float(raw)}.get(m[1], lambda: raw)(), True
        elif m := re.fullmatch(r"(\w+)\{(\w+)\}", body):
            self.base, self.member = m[1], m[2]
        else:
            self.base = body
        if self.base and self.base not in _PLAIN | {"pattern", "list", "set", "view"} and not re.fullmatch(r"[A-Za-z_]\w*", self.base):
            raise ValueError_(f"invalid declaration `{text}`")

    # -- driver values
    def start(self) -> Any:
        """The value of a field that is not given."""
        if self.nillable and not self.has_default:
            return None
        if self.has_default:
            return self.default
        b = self.base
        simple = {"any": None, "raw": "", "str": "", "utf8": "", "bytes": b"", "int": 0, "uint": 0, "pint": 1, "nint": -1, "float": 0.0, "number": 0, "bool": False, "email": "", "url": "", "tel": "", "task": None}
        if b in simple:
            return simple[b]
        if b == "pattern":
            return ""
        if b in ("list", "[]"):
            return List()
        if b in ("set", "{}"):
            return TSet()
        if b in ("thing", "view"):
            return Thing(restriction=self.inner.text if self.inner else None)
        if b in ("datetime", "timeval"):
            import time

            return DateTime(int(time.time()), None, b == "timeval")
        if b == "regex":
            return Rx(".*")
        if b == "error":
            return Err(-100, "")
        if b == "room":
            return Room()
        if b == "closure":
            from quillon.lang.parser import parse

            return ClosureValue(parse("||nil").body[0])
        if self.types and b in self.types.enums:
            e = self.types.enums[b]
            return e.members[self.member] if self.member else e.first()
        if self.types and b in self.types.types:
            return self.types.types[b].new({})
        raise LookupError_(f"unknown type `{b}`")

    def check(self, v: Any, where: str) -> Any:
        if v is None and (self.nillable or self.base == "any"):
            return v
        bad = TypeError_(f"mismatch in {where}: `{self.text}` does not accept `{kind(v)}`")
        b, k = self.base, kind(v)
        number = isinstance(v, (int, float)) and not isinstance(v, bool)
        ok = {
            "any": True,
            "raw": isinstance(v, (str, bytes)),
            "str": isinstance(v, str),
            "utf8": isinstance(v, str),
            "bytes": isinstance(v, bytes),
            "int": number and isinstance(v, int),
            "float": isinstance(v, float),
            "number": number,
            "bool": isinstance(v, bool),
            "thing": isinstance(v, Thing),
            "view": isinstance(v, Thing),
            "list": is_list(v),
            "[]": is_list(v),
            "set": isinstance(v, TSet) or (is_list(v) and not len(v)),
            "{}": isinstance(v, TSet) or (is_list(v) and not len(v)),
            "pattern": isinstance(v, str),
        }.get(b)
        if b in _NUMERIC:
            if not (number and isinstance(v, int)):
                raise bad
            lo, hi = _NUMERIC[b]
            if (lo is not None and v < lo) or (hi is not None and v > hi):
                raise ValueError_(f"{where}: value {v} is out of the range of `{b}`")
            return v
        if b in _SHAPES:
            if not isinstance(v, str):
                raise bad
            if v and not re.search(_SHAPES[b], v):
                raise ValueError_(f"{where}: not a valid {b}")
            return v
        if ok is None:
            if self.types and b in self.types.enums:
                e = self.types.enums[b]
                if isinstance(v, Member) and v.enum is e:
                    return v
                return e.by_value(v)
            ok = k == b or k == "datetime" == b or (isinstance(v, Thing) and v.type is not None and v.type.name == b)
        if not ok:
            raise bad
        size = len(v.encode()) if b in ("str", "utf8") else v if b in ("int", "float") else None
        if size is not None and ((self.low is not None and size < self.low) or (self.high is not None and size > self.high)):
            raise ValueError_(f"{where}: out of the range of `{self.text}`")
        if b == "pattern" and not re.search(self.pattern, v):
            raise ValueError_(f"{where}: does not match the pattern")
        if b in ("set", "{}") and is_list(v):
            v = TSet()
        if self.inner is not None and b in ("list", "set"):
            for x in v:
                self.inner.check(x, where)
            if isinstance(v, tuple):
                v = List(v)
            v.restriction = self.inner.text
        elif b in ("list", "[]") and isinstance(v, tuple):
            v = List(v)
        return v

    # -- tables
    def check_column(self, name: str) -> Column | None:
        """True where a table's value breaks the declaration; NULL counts as nil."""
        c = F.col(f"`{name}`")
        bad = F.lit(False) if self.nillable or self.base == "any" else c.isNull()
        b = self.base
        if b in _NUMERIC:
            lo, hi = _NUMERIC[b]
            bad = bad | (c < lo if lo is not None else c > hi)
        if b in _SHAPES:
            bad = bad | ((c != "") & ~F.regexp_like(c, F.lit(_SHAPES[b])))
        if b == "pattern":
            bad = bad | ~F.regexp_like(c, F.lit(self.pattern))
        size = F.octet_length(c) if b in ("str", "utf8") else c
        if self.low is not None:
            bad = bad | (size < self.low)
        if self.high is not None:
            bad = bad | (size > self.high)
        return F.coalesce(bad, F.lit(False))

    def default_column(self) -> Column:
        v = self.start()
        return S.lit(v.value if isinstance(v, Member) else v if not isinstance(v, (TSet, Thing, DateTime)) else None).c


class Type:
    def __init__(self, name: str, types: Types, wpo: bool = False, hide: bool = False, index: bool = False):
        self.name, self.types, self.wpo, self.hide, self.index = name, types, wpo, hide, index
        self.fields: dict[str, Spec] = {}
        self.methods: dict[str, ClosureValue] = {}
        self.relations: dict[str, tuple[str, str]] = {}

    def define(self, fields: dict[str, Any]) -> None:
        for k, v in fields.items():
            if isinstance(v, ClosureValue):
                self.methods[k] = v
            elif isinstance(v, str):
                self.fields[k] = Spec(v, self.types)
            else:
                raise TypeError_(f"a field of `{self.name}` must be a declaration or a closure")

    def new(self, given: dict[str, Any]) -> Thing:
        if self.wpo:
            raise TypeError_(f"type `{self.name}` is only for views")
        for k in given:
            if k not in self.fields:
                raise LookupError_(f"type `{self.name}` has no property `{k}`")
        out = Thing({}, self)
        for k, s in self.fields.items():
            out.fields[k] = s.check(given[k], f"{self.name}.{k}") if k in given else s.start()
        for k in self.relations:
            if k in given:
                self.types.link(out, k, None, out.fields[k])
        return out

    def show(self, thing: Thing, deep: int, ids: bool) -> dict:
        """Output of a thing through this view: its fields that the thing has and whose kind fits."""
        if deep <= 0:
            return {"#": thing.id} if thing.id is not None and ids else {}
        out = {"#": thing.id} if thing.id is not None and ids and not self.hide else {}
        for k, s in self.fields.items():
            if k not in thing.fields:
                if k in self.methods:
                    continue
                continue
            v = thing.fields[k]
            if "?" in s.flags and v is None or "!" in s.flags and not truthy(v):
                continue
            if s.base not in ("any", "view", "list", "set") and s.base not in self.types.types:
                try:
                    s.check(v, k)
                except (TypeError_, ValueError_):
                    continue
            d = deep - 1 + (1 if "&" in s.flags or "+" in s.flags else 0) + (1 if "+" in s.flags else 0) - (1 if "-" in s.flags else 0)
            show_ids = ids and "^" not in s.flags
            inner = s.inner.base if s.inner else s.base
            view = self.types.types.get(inner)
            if isinstance(v, Member):
                out[k] = v.name if "*" in s.flags else output(v, d, show_ids)
            elif view is not None and isinstance(v, Thing):
                out[k] = view.show(v, d, show_ids)
            elif view is not None and (is_list(v) or isinstance(v, TSet)):
                out[k] = [view.show(x, d, show_ids) if isinstance(x, Thing) else output(x, d, show_ids) for x in v]
            else:
                out[k] = output(v, d, show_ids)
        return out

    def info(self) -> dict:
        return {"name": self.name, "wrap_only": self.wpo, "hide_id": self.hide, "index": self.index, "fields": [[k, s.text] for k, s in self.fields.items()], "methods": {k: {"arguments": m.names, "definition": m.node.text} for k, m in self.methods.items()}, "relations": {k: {"type": t, "property": p} for k, (t, p) in self.relations.items()}}

    # -- tables of this type
    def conform(self, df: DataFrame) -> DataFrame:
        """A table as this type's: defaults for missing columns, other columns dropped, and an error where a value breaks its declaration."""
        cols = []
        for k, s in self.fields.items():
            if k not in df.columns:
                cols.append(s.default_column().alias(k))
                continue
            bad = s.check_column(k)
            cols.append(F.when(bad, S.fail("value_err", f"{self.name}.{k} breaks `{s.text}`")).otherwise(F.col(f"`{k}`")).alias(k))
        keep = [F.col("`#`")] if "#" in df.columns else []
        return df.select(*keep, *cols)


class Enum:
    def __init__(self, name: str):
        self.name, self.members, self.methods, self.default = name, {}, {}, None

    def first(self) -> Member:
        return self.members[self.default] if self.default else next(iter(self.members.values()))

    def by_value(self, v: Any) -> Member:
        for m in self.members.values():
            if eq(m.value, v):
                return m
        raise LookupError_(f"enum `{self.name}` has no member with this value")

    def add(self, name: str, value: Any) -> None:
        if isinstance(value, ClosureValue):
            self.methods[name] = value
            return
        if any(eq(m.value, value) for m in self.members.values()):
            raise ValueError_("enum values must be unique")
        if self.members and kind(next(iter(self.members.values())).value) != kind(value):
            raise TypeError_("enum values must have one type")
        self.members[name] = Member(self, name, value)

    def info(self) -> dict:
        return {"name": self.name, "default": self.first().name if self.members else None, "members": [[m.name, output(m.value)] for m in self.members.values()], "methods": {k: m.node.text for k, m in self.methods.items()}}

    def table(self) -> dict[str, Any]:
        return {m.name: m.value for m in self.members.values()}


class Types:
    """The types and enums of a collection, and the two-way references between them."""

    def __init__(self):
        self.types: dict[str, Type] = {}
        self.enums: dict[str, Enum] = {}

    def need(self, name: str) -> Type:
        if name not in self.types:
            raise LookupError_(f"type `{name}` not found")
        return self.types[name]

    def need_enum(self, name: str) -> Enum:
        if name not in self.enums:
            raise LookupError_(f"enum `{name}` not found")
        return self.enums[name]

    def relate(self, a: Type, prop: str, b: Type, other: str) -> None:
        a.relations[prop] = (b.name, other)
        b.relations[other] = (a.name, prop)

    def set(self, thing: Thing, prop: str, v: Any) -> None:
        """Assigns with checks, keeping the other side of a relation."""
        spec = thing.type.fields.get(prop)
        if spec is None:
            raise LookupError_(f"type `{thing.type.name}` has no property `{prop}`")
        v = spec.check(v, f"{thing.type.name}.{prop}")
        old, thing.fields[prop] = thing.fields.get(prop), v
        if prop in thing.type.relations:
            self.link(thing, prop, old, v)

    def link(self, thing: Thing, prop: str, old: Any, new: Any) -> None:
        other = thing.type.relations[prop][1]
        for gone in self._things(old):
            if gone not in self._things(new):
                self._drop(gone, other, thing)
        for t in self._things(new):
            back = t.fields.get(other)
            if isinstance(back, TSet):
                back.items[id(thing)] = thing
            elif back is not thing:
                t.fields[other] = thing
                if isinstance(back, Thing):
                    self._drop(back, prop, t)

    def changed(self, v: TSet, gone: list[Thing], added: list[Thing]) -> None:
        """Keeps the other side after a set of a relation has lost and got things."""
        thing, prop = v.home or (None, None)
        if thing is not None and thing.fields.get(prop) is v and prop in thing.type.relations:
            self.link(thing, prop, TSet(gone), TSet(added))

    def _things(self, v: Any) -> list[Thing]:
        return [v] if isinstance(v, Thing) else list(v) if isinstance(v, TSet) else []

    def _drop(self, t: Thing, prop: str, x: Thing) -> None:
        v = t.fields.get(prop)
        if isinstance(v, TSet):
            v.items.pop(id(x), None)
        elif v is x:
            t.fields[prop] = None
