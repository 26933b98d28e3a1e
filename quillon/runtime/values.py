"""Values of the driver's interpreter, their kinds, truth, equality, order and output."""

from __future__ import annotations

import datetime as dt
import json
import zoneinfo
from typing import Any

from quillon.errors import LangError, OverflowError_, TypeError_, ZeroDivError
from quillon.lang.compile import Rx
from quillon.lang.parser import INT_MAX, INT_MIN, Node


class Thing:
    """Properties by name, an id once stored, and a type or none."""

    __slots__ = ("fields", "id", "restriction", "type")

    def __init__(self, fields: dict[str, Any] | None = None, type_: Any = None, id_: int | None = None, restriction: str | None = None):
        self.fields, self.type, self.id, self.restriction = fields if fields is not None else {}, type_, id_, restriction


class TSet:
    """Things by identity. `home` is the thing and property of a relation that hold the set, once read from there."""

    __slots__ = ("home", "items", "restriction")

    def __init__(self, things=(), restriction: str | None = None):
        self.items = {id(t): t for t in things}
        self.restriction = restriction
        self.home = None

    def __iter__(self):
        return iter(list(self.items.values()))

    def __len__(self):
        return len(self.items)

    def __contains__(self, t):
        return id(t) in self.items


class List(list):
    """A mutable list; a tuple is an immutable one."""

    restriction: str | None = None


class DateTime:
    __slots__ = ("timeval", "ts", "zone")

    def __init__(self, ts: int, zone: str | None = None, timeval: bool = False):
        self.ts, self.zone, self.timeval = int(ts), zone, timeval

    def tz(self) -> dt.tzinfo:
        if self.zone is None or self.zone in ("Z", "UTC"):
            return dt.UTC
        if self.zone[0] in "+-":
            digits = self.zone[1:].replace(":", "")
            minutes = int(digits[:2]) * 60 + int(digits[2:4] or 0)
            return dt.timezone(dt.timedelta(minutes=minutes if self.zone[0] == "+" else -minutes))
        return zoneinfo.ZoneInfo(self.zone)

    def local(self) -> dt.datetime:
        return dt.datetime.fromtimestamp(self.ts, self.tz())

    def moved(self, wall: dt.datetime) -> DateTime:
        return DateTime(int(wall.replace(tzinfo=self.tz()).timestamp()), self.zone, self.timeval)

    def iso(self) -> str:
        w = self.local()
        off = w.utcoffset()
        return w.strftime("%Y-%m-%dT%H:%M:%S") + ("Z" if not off else w.strftime("%z"))


class MpData(bytes):
    """A packed value."""


class ClosureValue:
    def __init__(self, node: Node, env: dict[str, Any] | None = None):
        self.node, self.env = node, env if env is not None else {}

    @property
    def names(self) -> list[str]:
        return self.node.names


class Err:
    def __init__(self, code: int, msg: str):
        self.code, self.msg = code, msg


class Member:
    def __init__(self, enum: Any, name: str, value: Any):
        self.enum, self.name, self.value = enum, name, value


class Wrap:
    """A thing seen through a view: field name -> spec."""

    def __init__(self, thing: Thing, view: Any, name: str | None):
        self.thing, self.view, self.name = thing, view, name


class Ano:
    def __init__(self, spec: dict[str, str]):
        self.spec = spec


class Room:
    def __init__(self, id_: int | None = None, name: str | None = None):
        self.id, self.name, self.events, self.joined = id_, name, [], []


class Task:
    def __init__(self, id_: int, at: DateTime | None, closure: ClosureValue, args: list, owner: str):
        self.id, self.at, self.closure, self.args, self.owner, self.err = id_, at, closure, args, owner, None


class Future:
    def __init__(self, run):
        self.run, self.then, self.other = run, None, None


class Module:
    def __init__(self, name: str, source: str, conf: Any = None):
        self.name, self.source, self.conf, self.scope, self.run = name, source, conf, None, None


def kind(v: Any) -> str:
    if v is None:
        return "nil"
    if isinstance(v, bool):
        return "bool"
    for t, name in ((int, "int"), (float, "float"), (str, "str"), (MpData, "mpdata"), (bytes, "bytes"), (List, "list"), (list, "list"), (tuple, "tuple"), (TSet, "set"), (Rx, "regex"), (ClosureValue, "closure"), (Err, "error"), (Room, "room"), (Task, "task"), (Future, "future"), (Module, "module"), (Ano, "anonymous")):
        if isinstance(v, t):
            return name
    if isinstance(v, DateTime):
        return "timeval" if v.timeval else "datetime"
    if isinstance(v, Thing):
        return v.type.name if v.type else "thing"
    if isinstance(v, Member):
        return v.enum.name
    if isinstance(v, Wrap):
        return f"<{v.name or 'anonymous'}>"
    return "table"


def is_list(v: Any) -> bool:
    return isinstance(v, (list, tuple))


def truthy(v: Any) -> bool:
    if v is None or isinstance(v, (bool, int, float, str, bytes, list, tuple, TSet)):
        return bool(v) if not isinstance(v, TSet) else len(v) > 0
    if isinstance(v, Thing):
        return bool(v.fields)
    if isinstance(v, Room):
        return v.id is not None
    if isinstance(v, Task):
        return v.at is not None
    return True


def plain(v: Any) -> Any:
    return plain(v.value) if isinstance(v, Member) else v


def eq(a: Any, b: Any) -> bool:
    if a is b:
        return True
    num = (bool, int, float)
    if isinstance(a, num) and isinstance(b, num):
        return a == b
    if isinstance(a, (str, bytes)) and isinstance(b, (str, bytes)):
        return (a.encode() if isinstance(a, str) else bytes(a)) == (b.encode() if isinstance(b, str) else bytes(b))
    if isinstance(a, DateTime) and isinstance(b, DateTime):
        return a.ts == b.ts
    if is_list(a) and is_list(b):
        return len(a) == len(b) and all(map(eq, a, b))
    if isinstance(a, TSet) and isinstance(b, TSet):
        return a.items.keys() == b.items.keys()
    if isinstance(a, Err) and isinstance(b, Err):
        return a.code == b.code
    if isinstance(a, Wrap) and isinstance(b, Wrap):
        return a.thing is b.thing and a.name == b.name
    return False


def compare(a: Any, b: Any, op: str = "<") -> int:
    """-1, 0 or 1; NaN compares as 2 with anything."""
    a, b = plain(a), plain(b)
    num = (bool, int, float)
    if isinstance(a, num) and isinstance(b, num):
        return -1 if a < b else 1 if a > b else 0 if a == b else 2
    if isinstance(a, DateTime) and isinstance(b, DateTime):
        return (a.ts > b.ts) - (a.ts < b.ts)
    if isinstance(a, (str, bytes)) and isinstance(b, (str, bytes)):
        x, y = (v.encode() if isinstance(v, str) else bytes(v) for v in (a, b))
        return (x > y) - (x < y)
    raise TypeError_(f"`{op}` not supported between `{kind(a)}` and `{kind(b)}`")


def checked(n: int) -> int:
    if not INT_MIN <= n <= INT_MAX:
        raise OverflowError_("integer overflow")
    return n


def numbers(op: str, a: Any, b: Any) -> tuple[Any, Any]:
    if not (isinstance(a, (bool, int, float)) and isinstance(b, (bool, int, float))):
        raise TypeError_(f"`{op}` not supported between `{kind(a)}` and `{kind(b)}`")
    return (int(a) if isinstance(a, bool) else a), (int(b) if isinstance(b, bool) else b)


def arith(op: str, a: Any, b: Any) -> Any:
    if op == "+" and isinstance(a, (str, bytes)) and type(a) is type(b):
        return a + b
    if isinstance(a, TSet) and isinstance(b, TSet) and op in "-&|^":
        x, y = a.items, b.items
        keys = {"-": [k for k in x if k not in y], "&": [k for k in x if k in y], "|": [*x, *(k for k in y if k not in x)], "^": [*(k for k in x if k not in y), *(k for k in y if k not in x)]}[op]
        return TSet((x | y)[k] for k in keys)
    x, y = numbers(op, a, b)
    if op in ("&", "|", "^", "<<", ">>"):
        if isinstance(x, float) or isinstance(y, float):
            raise TypeError_(f"bitwise `{op}` not supported for floats")
        if op in ("<<", ">>"):  # the count is taken modulo 64, as in plans
            n = (x << (y & 63)) if op == "<<" else x >> (y & 63)
            return (n + (1 << 63)) % (1 << 64) - (1 << 63)
        return {"&": x & y, "|": x | y, "^": x ^ y}[op]
    if op == "%":
        x, y = int(x), int(y)
        if y == 0:
            raise ZeroDivError("division or modulo by zero")
        return abs(x) % abs(y) * (1 if x >= 0 else -1)
    if op == "/":
        if y == 0:
            raise ZeroDivError("division or modulo by zero")
        if isinstance(x, float) or isinstance(y, float):
            return x / y
        return checked(abs(x) // abs(y) * (1 if (x >= 0) == (y >= 0) else -1))
    r = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y}[op]()
    return r if isinstance(r, float) else checked(r)


def text(v: Any) -> str:
    if v is None:
        return "nil"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        if v != v or v in (float("inf"), float("-inf")):
            return "nan" if v != v else "inf" if v > 0 else "-inf"
        return repr(v)
    if isinstance(v, (int, str)):
        return str(v)
    if isinstance(v, bytes):
        try:
            return v.decode()
        except UnicodeDecodeError as e:
            raise TypeError_("bytes are not valid UTF-8") from e
    if isinstance(v, DateTime):
        return str(v.ts) if v.timeval else v.iso()
    if isinstance(v, Rx):
        return f"/{v.pattern}/{v.flags}"
    if isinstance(v, ClosureValue):
        return v.node.text
    if isinstance(v, Err):
        return v.msg
    if isinstance(v, Member):
        return text(v.value)
    if isinstance(v, Thing):
        return f"{v.type.name if v.type else 'thing'}:{v.id if v.id is not None else 'nil'}"
    if isinstance(v, Room):
        return f"room:{v.id}"
    if isinstance(v, Task):
        return f"task:{v.id}"
    return f"<{kind(v)}>"


def output(v: Any, deep: int = 1, ids: bool = True) -> Any:
    """What a client gets: plain Python data, things cut at depth deep (a stored one below it is its id)."""
    if v is None or isinstance(v, (bool, int, float, str)):
        return v
    if isinstance(v, bytes):
        return bytes(v)
    if isinstance(v, DateTime):
        return v.ts if v.timeval else v.iso()
    if isinstance(v, Thing):
        if deep <= 0:
            return {"#": v.id} if v.id is not None and ids else {}
        hide = not ids or (v.type is not None and v.type.hide)
        out = {"#": v.id} if v.id is not None and not hide else {}
        return out | {k: output(x, deep - 1, ids) for k, x in v.fields.items()}
    if is_list(v) or isinstance(v, TSet):
        return [output(x, deep, ids) for x in v]
    if isinstance(v, Wrap):
        return v.view.show(v.thing, deep, ids)
    if isinstance(v, Member):
        return output(v.value, deep, ids)
    if isinstance(v, Err):
        return {"error_code": v.code, "error_msg": v.msg}
    if isinstance(v, (ClosureValue, Rx, Room, Task)):
        return text(v)
    return v


def to_json(v: Any, deep: int, ids: bool, beautify: bool = False) -> str:
    out = output(v, deep, ids)
    return json.dumps(out, ensure_ascii=False, indent=2 if beautify else None, separators=None if beautify else (",", ":"), default=lambda x: x.decode("utf-8", "replace") if isinstance(x, bytes) else str(x))


def from_python(x: Any) -> Any:
    """Arguments and loaded data as values."""
    if isinstance(x, dict):
        return Thing({str(k): from_python(v) for k, v in x.items()})
    if isinstance(x, (list, tuple)):
        return List(nested(from_python(v)) for v in x)
    if isinstance(x, dt.datetime):
        return DateTime(int(x.timestamp()))
    if isinstance(x, int) and not isinstance(x, bool):
        return checked(x)
    return x


def nested(v: Any) -> Any:
    """A list inside a list is a tuple."""
    return tuple(v) if isinstance(v, list) else v


def error_value(e: LangError) -> Err:
    return Err(e.code, e.msg)
