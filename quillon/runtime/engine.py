"""The engine: scopes, catalog, users and the entry points for queries and procedures.

    engine = Engine(spark)
    engine.bind("stuff", "lineitem", Coll(df))
    engine.query("lineitem.filter(|l| l.l_quantity > 45).map(|l| l.l_extendedprice).sum()")

State is small and lives on the driver; tables stay lazy plans. Everything a cluster manager does (nodes) is a registry.
"""

from __future__ import annotations

import hashlib
import heapq
import logging
import secrets
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quillon.errors import AuthError, ForbiddenError, LangError, LookupError_, OperationError, SyntaxError_, TypeError_, ValueError_, from_spark
from quillon.lang.compile import Compiler
from quillon.lang.parser import changes, parse
from quillon.operators.collection import Coll
from quillon.runtime import values as X
from quillon.runtime.interp import Interp
from quillon.runtime.types import Types
from quillon.runtime.values import ClosureValue, DateTime, Member, Room, Task, Thing, TSet, is_list
from quillon.sources import msgpack

QUERY, CHANGE, GRANT, JOIN, RUN = 1, 2, 4, 8, 16


class Scope:
    deep = 1
    zone: str | None = None


class Admin(Scope):
    name = "@admin"

    def __init__(self):
        self.procedures: dict[str, ClosureValue] = {}
        self.tasks: dict[int, Task] = {}
        self.next_id = 1
        self.history_on = True

    def task(self, id_: int) -> Task:
        if id_ not in self.tasks:
            raise LookupError_("task not found")
        return self.tasks[id_]

    def new_task(self, at: DateTime, closure: ClosureValue, args: list, owner: str) -> Task:
        t = Task(self.next_id, at, closure, args, owner)
        self.next_id += 1
        self.tasks[t.id] = t
        return t


class Node(Scope):
    name = "@node"


class Collection(Admin):
    """A database: a root thing, types and enums, procedures, rooms, tasks, and bound tables."""

    def __init__(self, name: str):
        super().__init__()
        self.name = name
        self.root = Thing({}, None, self.take_id())
        self.things: dict[int, Thing] = {self.root.id: self.root}
        self.types = Types()
        self.rooms: dict[int, Room] = {}
        self.room_names: dict[str, Room] = {}
        self.created = int(time.time())

    def take_id(self) -> int:
        n, self.next_id = self.next_id, self.next_id + 1
        return n

    def store(self, v: Any) -> None:
        """Gives ids to what became reachable from the root."""
        if isinstance(v, Thing):
            if v.id is None:
                v.id = self.take_id()
                self.things[v.id] = v
                for x in v.fields.values():
                    self.store(x)
        elif is_list(v) or isinstance(v, TSet):
            for x in v:
                self.store(x)
        elif isinstance(v, Room) and v.id is None:
            v.id = self.take_id()
            self.rooms[v.id] = v

    def all_things(self) -> list[Thing]:
        """Things reachable from the root, and stored ones."""
        seen: dict[int, Thing] = {}
        todo = [self.root, *self.things.values()]
        while todo:
            t = todo.pop()
            if id(t) in seen:
                continue
            seen[id(t)] = t
            for v in t.fields.values():
                todo += [x for x in ([v] if isinstance(v, Thing) else v if is_list(v) or isinstance(v, TSet) else []) if isinstance(x, Thing)]
        return list(seen.values())

    def by_id(self, id_: int) -> Thing:
        if id_ not in self.things:
            raise LookupError_(f"thing {id_} not found")
        return self.things[id_]

    def room(self, *a: Any) -> Room:
        if not a:
            return Room()
        if isinstance(a[0], Room):
            return a[0]
        found = self.rooms.get(a[0]) if isinstance(a[0], int) else self.room_names.get(a[0])
        if found is None:
            raise LookupError_(f"room `{a[0]}` not found")
        return found

    def name_room(self, room: Room, name: str) -> None:
        if name in self.room_names:
            raise LookupError_(f"room `{name}` already exists")
        if room.id is None:
            self.store(room)
        room.name = name
        self.room_names[name] = room

    def script(self) -> str:
        """Statements that make the types, enums, procedures and root data again."""
        out = []
        for e in self.types.enums.values():
            out.append(f"set_enum('{e.name}', {{{', '.join(f'{m.name}: {code(m.value)}' for m in e.members.values())}}});")
        out += [f"new_type('{t.name}');" for t in self.types.types.values()]
        for t in self.types.types.values():
            body = [f"{k}: {code(s.text)}" for k, s in t.fields.items()] + [f"{k}: {m.node.text}" for k, m in t.methods.items()]
            out.append(f"set_type('{t.name}', {{{', '.join(body)}}});")
        out += [f".{k} = {code(v)};" for k, v in self.root.fields.items()]
        out += [f"new_procedure('{n}', {c.node.text});" for n, c in self.procedures.items()]
        return "\n".join(out)

    def dump(self) -> bytes:
        return msgpack.pack({"version": 1, "script": self.script(), "tasks": [[t.at.ts, t.closure.node.text, X.output(t.args), t.owner] for t in self.tasks.values() if t.at]})

    def load(self, data: bytes, tasks: bool) -> None:
        if self.root.fields or self.types.types or self.procedures:
            raise OperationError("a dump is imported into an empty collection")
        got = msgpack.unpack(data)
        q = Interp(Engine.current, self, Engine.current.users["admin"], {})
        q.program(parse(got["script"]))
        for ts, text, args, owner in got["tasks"] if tasks else []:
            self.new_task(DateTime(ts), ClosureValue(parse(text).body[0]), args, owner)


def code(v: Any) -> str:
    """A value as program text."""
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, Thing):
        return (v.type.name if v.type else "") + "{" + ", ".join(f"{k}: {code(x)}" for k, x in v.fields.items()) + "}"
    if isinstance(v, TSet):
        return "set(" + ", ".join(map(code, v)) + ")"
    if is_list(v):
        return "[" + ", ".join(map(code, v)) + "]"
    if isinstance(v, Member):
        return f"{v.enum.name}{{{v.name}}}"
    if isinstance(v, DateTime):
        return f"datetime({v.ts})"
    if isinstance(v, bytes):
        import base64

        return f"base64_decode('{base64.b64encode(v).decode()}')"
    return X.text(v)


class User:
    def __init__(self, name: str, password: str | None = None):
        self.name, self.access, self.tokens, self.white = name, {}, {}, {}
        self.created = int(time.time())
        self.set(password)

    def set(self, password: str | None) -> None:
        self.salt = secrets.token_bytes(8)
        self.hash = hashlib.scrypt(password.encode(), salt=self.salt, n=1024, r=8, p=1) if password is not None else None

    def fits(self, password: str) -> bool:
        return self.hash is not None and secrets.compare_digest(self.hash, hashlib.scrypt(password.encode(), salt=self.salt, n=1024, r=8, p=1))


_COUNTERS = ["queries_success", "queries_with_error", "changes_committed", "changes_failed", "tasks_success", "tasks_with_error", "events_emitted", "longest_query_duration", "total_query_duration", "largest_result_size", "started_at"]


class Engine:
    current: Engine

    def __init__(self, spark: SparkSession | None = None, clock: Callable[[], float] = time.time):
        self.spark, self.clock = spark, clock
        self.collections: dict[str, Collection] = {"stuff": Collection("stuff")}
        self.admin, self.node = Admin(), Node()
        self.users = {"admin": User("admin", "pass")}
        self.users["admin"].access = {"*": 31}
        self.modules: dict[str, Any] = {}
        self.providers: dict[str, Callable] = {}
        self.nodes: dict[int, dict] = {0: {"node_id": 0, "address": "driver", "port": 0, "status": "READY"}}
        self.backups: dict[int, dict] = {}
        self.commits: list[dict] = []
        self.changes, self.stopped = 0, False
        self.tables: dict[str, dict[str, Coll]] = {"stuff": {}}
        self.typed: dict[tuple[str, str], Coll] = {}
        self.listeners: list[Callable[[Room, str, list], None]] = []
        self.do_reset_counters(None)
        Engine.current = self

    # -- entry points
    def bind(self, collection: str, name: str, table: Coll | DataFrame) -> None:
        """Makes a table known to the queries of a collection as a variable."""
        self.tables[collection][name] = table if isinstance(table, Coll) else Coll(table)

    def bind_type(self, collection: str, type_name: str, table: Coll | DataFrame) -> Coll:
        """Makes a table the instances of a type: conformed to its fields (defaults, checks), found by type_all, type_count and Type(id)."""
        t = self.need_collection(collection).types.need(type_name)
        c = table if isinstance(table, Coll) else Coll(table, key="#" if "#" in table.columns else None)
        rows = t.conform(c.rows)
        out = c.made(rows, key="#" if "#" in rows.columns else None, order=["#"] if "#" in rows.columns else [], is_set=True)
        self.typed[collection, type_name] = out
        return out

    def dump_tables(self, collection: str, path: str) -> list[str]:
        """Snapshot of a collection: its bound tables as Parquet, and its script and tasks as one packed file."""
        names = list(self.tables[collection])
        for n in names:
            self.tables[collection][n].df().write.mode("overwrite").parquet(f"{path}/tables/{n}")
        state = self.spark.createDataFrame([(bytearray(self.need_collection(collection).dump()),)], "state binary")
        state.coalesce(1).write.mode("overwrite").parquet(f"{path}/state")
        return names

    def load_tables(self, collection: str, path: str, names: list[str], keys: dict[str, str] | None = None) -> None:
        """The other way: into an empty collection."""
        self.need_collection(collection).load(bytes(self.spark.read.parquet(f"{path}/state").first()["state"]), False)
        for n in names:
            key = (keys or {}).get(n)
            self.bind(collection, n, Coll(self.spark.read.parquet(f"{path}/tables/{n}"), [key] if key else None, key))

    def scope(self, name: str) -> Scope:
        if name in ("@admin", "/a"):
            return self.admin
        if name.startswith("@node") or name.startswith("/n"):
            return self.node
        key = name.removeprefix("@collection:").removeprefix("//").removeprefix("@")
        if key not in self.collections:
            raise LookupError_(f"collection `{key}` not found")
        return self.collections[key]

    def may(self, user: User, scope: Scope, bits: int) -> None:
        have = user.access.get("*", 0) | user.access.get(scope.name, 0)
        if have & bits != bits:
            raise ForbiddenError(f"user `{user.name}` has no such access to `{scope.name}`")

    def query(self, text: str, scope: str = "//stuff", user: str = "admin", **args: Any) -> Any:
        """Runs program text. The result is plain Python data, or a lazy Coll if the query ends in a table."""
        s, u = self.scope(scope), self.need_user(user)
        tree = parse(text)
        self.may(u, s, QUERY | (CHANGE if changes(tree) else 0))
        given = {**self.tables.get(s.name, {}), **{k: v if isinstance(v, Coll) else X.from_python(v) for k, v in args.items()}}
        return self._run(lambda q: q.program(tree), s, u, given, text)

    def run(self, procedure: str, *args: Any, scope: str = "//stuff", user: str = "admin", **named: Any) -> Any:
        """Calls a stored procedure with arguments by position or name."""
        s, u = self.scope(scope), self.need_user(user)
        self.may(u, s, RUN)
        if procedure not in s.procedures:
            raise LookupError_(f"procedure `{procedure}` not found")
        self.allowed(u, "procedures", procedure)
        c = s.procedures[procedure]
        values = [named[n] if n in named else None for n in c.names] if named else list(args)
        return self._run(lambda q: q.finish(q.call(c, [x if isinstance(x, Coll) else X.from_python(x) for x in values])), s, u, dict(self.tables.get(s.name, {})), procedure)

    def _run(self, f: Callable[[Interp], Any], s: Scope, u: User, args: dict, text: str, task: Task | None = None) -> Any:
        q = Interp(self, s, u, args, task=task)
        start = time.perf_counter()
        try:
            out = f(q)
        except RecursionError as e:
            raise SyntaxError_("nested too deep") from e
        except LangError:
            self.count["queries_with_error"] += 1
            raise
        except Exception as e:
            self.count["queries_with_error"] += 1
            if (x := from_spark(e)) is not None:
                raise x from e
            raise
        finally:
            took = time.perf_counter() - start
            self.count["total_query_duration"] += took
            self.count["longest_query_duration"] = max(self.count["longest_query_duration"], took)
        self.count["queries_success"] += 1
        if q.change:
            self.changes += 1
            self.count["changes_committed"] += 1
        return out if isinstance(out, Coll) else X.output(out, s.deep if q.deep is None else q.deep, q.ids)

    def compiler(self, collection: str = "stuff") -> Compiler:
        """For plans that use a collection's procedures and enums."""
        c = self.collections[collection]
        return Compiler({n: p.node.text for n, p in c.procedures.items()}, {n: e.table() for n, e in c.types.enums.items()})

    # -- rooms
    def emit(self, room: Room, event: str, args: list) -> None:
        room.events.append((self.clock(), event, args))
        self.count["events_emitted"] += 1
        for f in [*room.joined, *self.listeners]:
            f(room, event, args)

    def join(self, room: str | int, on_event: Callable, scope: str = "//stuff", user: str = "admin") -> Room:
        s, u = self.scope(scope), self.need_user(user)
        self.may(u, s, JOIN)
        r = s.room(room)
        self.allowed(u, "rooms", r.name or "")
        r.joined.append(on_event)
        return r

    def leave(self, room: str | int, on_event: Callable, scope: str = "//stuff") -> None:
        self.scope(scope).room(room).joined.remove(on_event)

    # -- tasks
    def run_due(self) -> int:
        """Runs the tasks whose time has come, in order of time; a task that isn't set again goes."""
        due = []
        for s in (self.admin, *self.collections.values()):
            for t in s.tasks.values():
                if t.at is not None and t.at.ts <= self.clock():
                    heapq.heappush(due, (t.at.ts, t.id, id(s), s, t))
        done = 0
        while due:
            _, _, _, s, t = heapq.heappop(due)
            t.last, t.at = t.at, None
            try:
                self._run(lambda q, t=t: q.finish(q.call(t.closure, [t, *t.args])), s, self.need_user(t.owner), {}, "task", task=t)
                t.err = None
                self.count["tasks_success"] += 1
            except LangError as e:
                t.err = X.error_value(e)
                self.count["tasks_with_error"] += 1
            if t.at is None and t.err is None:
                s.tasks.pop(t.id, None)
            done += 1
        return done

    # -- modules
    def provide(self, source: str, f: Callable[..., Any]) -> None:
        """What a module source stands for: f(conf, *arguments)."""
        self.providers[source] = f

    def start_module(self, m: Any) -> None:
        m.run = self.providers.get(m.source)

    def deploy(self, m: Any, data: Any) -> None:
        """Code of a module goes to the executors."""
        if self.spark is not None and isinstance(data, str):
            self.spark.sparkContext.addPyFile(data)
        self.start_module(m)

    def call_module(self, q: Interp, name: str, args: list) -> Any:
        if name not in self.modules:
            raise LookupError_(f"module `{name}` not found")
        m = self.modules[name]
        if m.scope is not None and m.scope not in (q.scope.name, f"//{q.scope.name}", f"@collection:{q.scope.name}"):
            raise ForbiddenError(f"module `{name}` is not for this scope")
        if m.run is None:
            self.start_module(m)
        if m.run is None:
            raise OperationError(f"module `{name}` is not loaded")
        return X.from_python(m.run(X.output(m.conf, 8), *(X.output(a, 8) for a in args)))

    # -- collections
    def need_collection(self, name: str) -> Collection:
        s = self.scope(name)
        if not isinstance(s, Collection):
            raise LookupError_(f"`{name}` is no collection")
        return s

    def do_new_collection(self, q, name):
        if name in self.collections:
            raise LookupError_(f"collection `{name}` already exists")
        if not name.isidentifier():
            raise ValueError_("a collection name follows the naming rules")
        self.collections[name], self.tables[name] = Collection(name), {}
        if self.spark is not None:
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")
        return name

    def do_del_collection(self, q, name):
        self.need_collection(name)
        del self.collections[name], self.tables[name]
        if self.spark is not None:
            self.spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")

    def do_rename_collection(self, q, old, new):
        c = self.need_collection(old)
        if new in self.collections:
            raise LookupError_(f"collection `{new}` already exists")
        del self.collections[old]
        self.tables[new] = self.tables.pop(old)
        c.name, self.collections[new] = new, c

    def do_has_collection(self, q, name):
        return name in self.collections

    def do_collection_info(self, q, name):
        c = self.need_collection(name)
        return {"name": c.name, "things": len(c.all_things()), "types": len(c.types.types), "procedures": len(c.procedures), "default_deep": c.deep, "time_zone": c.zone or "UTC", "created_at": c.created, "tables": list(self.tables[c.name])}

    def do_collections_info(self, q):
        return [self.do_collection_info(q, n) for n in self.collections]

    def do_set_default_deep(self, q, scope, n):
        if not 0 <= n <= 127:
            raise ValueError_("deep must be between 0 and 127")
        self.scope(scope).deep = n

    def do_set_time_zone(self, q, scope, zone):
        DateTime(0, zone).local()
        self.scope(scope).zone = zone

    # -- backups: a packed snapshot in a file
    def snapshot(self) -> bytes:
        return msgpack.pack({"collections": {n: c.dump() for n, c in self.collections.items()}, "users": {n: u.access for n, u in self.users.items()}})

    def do_new_backup(self, q, file, at=None, repeat=None, keep=7):
        i = max(self.backups, default=-1) + 1
        self.backups[i] = {"id": i, "file_template": file, "repeat": repeat, "max_files": keep, "files": [], "at": self.clock() if at is None else at.ts if isinstance(at, DateTime) else at, "result": "pending"}
        self.run_backups()
        return i

    def run_backups(self) -> None:
        for b in self.backups.values():
            if b["at"] is None or b["at"] > self.clock():
                continue
            stamp = time.strftime("%Y%m%d%H%M%S", time.gmtime(self.clock()))
            path = b["file_template"].replace("{DATETIME}", stamp)
            try:
                with open(path, "wb") as f:
                    f.write(self.snapshot())
                b["files"] = [*b["files"], path][-b["max_files"] :]
                b["result"] = "success"
            except OSError as e:
                b["result"] = str(e)
            b["at"] = b["at"] + b["repeat"] if b["repeat"] else None

    def need_backup(self, i):
        if i not in self.backups:
            raise LookupError_(f"backup {i} not found")
        return self.backups[i]

    def do_del_backup(self, q, i, files=False):
        import os

        for f in self.need_backup(i)["files"] if files else []:
            os.unlink(f)
        del self.backups[i]

    def do_has_backup(self, q, i):
        return i in self.backups

    def do_backup_info(self, q, i):
        return self.need_backup(i)

    def do_backups_info(self, q):
        return list(self.backups.values())

    def do_backups_ok(self, q):
        return all(b["result"] in ("success", "pending") for b in self.backups.values())

    def do_restore(self, q, file, opt=None):
        with open(file, "rb") as f:
            got = msgpack.unpack(f.read())
        o = opt.fields if opt else {}
        self.collections = {}
        for name, data in got["collections"].items():
            self.collections[name] = c = Collection(name)
            self.tables.setdefault(name, {})
            c.load(data, bool(o.get("restore_tasks")))
        if not o.get("take_access"):
            for n, access in got["users"].items():
                self.users.setdefault(n, User(n)).access = access

    # -- history
    def do_commit(self, q, msg):
        if not isinstance(msg, str) or not msg:
            raise ValueError_("a commit needs a message")
        q.mutate()
        self.commits.append({"id": len(self.commits) + 1, "scope": q.scope.name, "by": q.user.name, "message": msg, "created_on": int(self.clock()), "err_msg": None, "change": self.changes + 1}) if q.scope.history_on else None

    def _picked(self, opt):
        import re

        o = dict(opt.fields) if opt else {}
        for k in o:
            if k not in ("scope", "contains", "match", "id", "last", "first", "before", "after", "has_err", "detail"):
                raise ValueError_(f"unknown option `{k}`")
        name = self.scope(o["scope"]).name if "scope" in o else None
        when = lambda v: v.ts if isinstance(v, DateTime) else v
        keep = [c for c in self.commits if (name is None or c["scope"] == name) and o.get("contains", "") in c["message"] and ("match" not in o or re.search(o["match"].pattern, c["message"])) and ("id" not in o or c["id"] == o["id"]) and ("before" not in o or c["created_on"] < when(o["before"])) and ("after" not in o or c["created_on"] > when(o["after"])) and ("has_err" not in o or bool(c["err_msg"]) == o["has_err"])]
        if "first" in o:
            keep = keep[: o["first"]]
        return keep[-o["last"] :] if o.get("last") else keep

    def do_history(self, q, opt=None):
        return self._picked(opt)

    def do_del_history(self, q, opt=None):
        gone = self._picked(opt)
        self.commits = [c for c in self.commits if c not in gone]
        return len(gone)

    def do_set_history(self, q, scope, on):
        self.scope(scope).history_on = bool(on)

    # -- users
    def need_user(self, name):
        if name not in self.users:
            raise LookupError_(f"user `{name}` not found")
        return self.users[name]

    def authenticate(self, name_or_token: str, password: str | None = None) -> str:
        if password is None:
            for u in self.users.values():
                t = u.tokens.get(name_or_token)
                if t is not None and (t["expires"] is None or t["expires"] > self.clock()):
                    return u.name
        elif name_or_token in self.users and self.users[name_or_token].fits(password):
            return name_or_token
        raise AuthError("invalid credentials")

    def do_new_user(self, q, name):
        if name in self.users:
            raise LookupError_(f"user `{name}` already exists")
        self.users[name] = User(name)
        return name

    def do_del_user(self, q, name):
        if self.need_user(name) is q.user:
            raise OperationError("users can't delete themselves")
        del self.users[name]

    def do_rename_user(self, q, old, new):
        u = self.need_user(old)
        if new in self.users:
            raise LookupError_(f"user `{new}` already exists")
        del self.users[old]
        u.name, self.users[new] = new, u

    def do_has_user(self, q, name):
        return name in self.users

    def do_user_info(self, q, name=None):
        u = self.need_user(name) if name else q.user
        return {"name": u.name, "access": u.access, "has_password": u.hash is not None, "tokens": [{"key": k, **t} for k, t in u.tokens.items()], "created_at": u.created, "whitelists": {k: [X.text(x) for x in v] for k, v in u.white.items()}}

    def do_users_info(self, q):
        return [self.do_user_info(q, n) for n in self.users]

    def do_set_password(self, q, name, password):
        self.need_user(name).set(password)

    def do_new_token(self, q, name, expires=None, description=""):
        key = secrets.token_hex(11)
        self.need_user(name).tokens[key] = {"expires": expires.ts if isinstance(expires, DateTime) else expires, "description": description, "created_on": int(self.clock())}
        return key

    def do_has_token(self, q, key):
        return any(key in u.tokens for u in self.users.values())

    def do_del_token(self, q, key):
        for u in self.users.values():
            if u.tokens.pop(key, None):
                return
        raise LookupError_("token not found")

    def do_del_expired(self, q):
        for u in self.users.values():
            u.tokens = {k: t for k, t in u.tokens.items() if t["expires"] is None or t["expires"] > self.clock()}

    def do_grant(self, q, scope, name, mask):
        s, u = self.scope(scope), self.need_user(name)
        u.access[s.name] = u.access.get(s.name, 0) | mask

    def do_revoke(self, q, scope, name, mask):
        s, u = self.scope(scope), self.need_user(name)
        if u is q.user and mask & GRANT:
            raise OperationError("users can't revoke their own right to grant")
        u.access[s.name] = u.access.get(s.name, 0) & ~mask

    def allowed(self, user: User, what: str, name: str) -> None:
        import re

        rules = user.white.get(what)
        if rules is not None and not any(r == name if isinstance(r, str) else re.search(r.pattern, name) for r in rules):
            raise ForbiddenError(f"`{name}` is not on the list of `{user.name}`")

    def do_whitelist_add(self, q, user, what, rule=None):
        if what not in ("rooms", "procedures"):
            raise ValueError_("lists are for rooms and procedures")
        rules = self.need_user(user).white.setdefault(what, [])
        if rule is not None:
            rules.append(rule)

    def do_whitelist_del(self, q, user, what, rule=None):
        u = self.need_user(user)
        if what not in u.white:
            raise LookupError_("no such list")
        if rule is None:
            del u.white[what]
        else:
            u.white[what] = [r for r in u.white[what] if X.text(r) != X.text(rule)]

    # -- nodes and counters: the cluster manager's work, kept as a registry
    def do_new_node(self, q, secret, address, port=9220):
        i = max(self.nodes) + 1
        self.nodes[i] = {"node_id": i, "address": address, "port": port, "status": "REGISTERED"}
        return i

    def do_del_node(self, q, i):
        if i not in self.nodes or i == 0:
            raise LookupError_(f"node {i} not found or in use")
        del self.nodes[i]

    def do_has_node(self, q, i):
        return i in self.nodes

    def do_node_info(self, q):
        out = {**self.nodes[0], "changes": self.changes, "uptime": self.clock() - self.count["started_at"]}
        if self.spark is not None:
            out |= {"spark_version": self.spark.version, "default_parallelism": self.spark.sparkContext.defaultParallelism}
        return out

    def do_nodes_info(self, q):
        return list(self.nodes.values())

    def do_counters(self, q):
        n = self.count["queries_success"] + self.count["queries_with_error"]
        return {**self.count, "average_query_duration": self.count["total_query_duration"] / n if n else 0.0}

    def do_reset_counters(self, q):
        self.count = dict.fromkeys(_COUNTERS, 0) | {"started_at": self.clock()}

    def do_set_log_level(self, q, level):
        names = ["DEBUG", "INFO", "WARN", "ERROR", "FATAL"]
        if not isinstance(level, int) or not 0 <= level < 5:
            raise TypeError_("log levels go from 0 to 4")
        if self.spark is not None:
            self.spark.sparkContext.setLogLevel(names[level])
        logging.getLogger("quillon").setLevel((level + 1) * 10)

    def do_shutdown(self, q):
        """Refuses further queries; the session belongs to its owner, who stops it."""
        self.stopped = True



