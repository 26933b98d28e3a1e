"""Lexer and precedence-climbing parser. The tree is made of tuples-like Node objects."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import Any

from quillon.errors import SyntaxError_


class Node:
    """A syntax node: kind, and fields as attributes."""

    __slots__ = ("f", "kind")

    def __init__(self, kind: str, **f: Any):
        self.kind, self.f = kind, f

    def __getattr__(self, name: str) -> Any:
        try:
            return self.f[name]
        except KeyError:
            raise AttributeError(name) from None

    def __repr__(self) -> str:
        return f"{self.kind}({', '.join(f'{k}={v!r}' for k, v in self.f.items())})"


_SKIP = re.compile(r"(?:\s+|//[^\n]*(?:\n|$)|/\*.*?\*/)*", re.S)
_NAME = re.compile(r"[A-Za-z_][0-9A-Za-z_]{0,254}(?![0-9A-Za-z_])")
_FLOAT = re.compile(r"(?:inf|nan|[0-9]*\.[0-9]+(?:e[+-][0-9]+)?)(?![0-9A-Za-z_.])")
_INT = re.compile(r"(?:0b[01]+|0o[0-7]+|0x[0-9a-fA-F]+|[0-9]+)(?![0-9A-Za-z_.])")
_STRING = re.compile(r"(?:'[^']*')+|(?:\"[^\"]*\")+")
_REGEX = re.compile(r"/((?:\\.|[^/\\\n])+)/([a-z]*)")
_ASSIGN = re.compile(r"=(?!=)|(?:\+|-|\*|/|%|&|\^|\|)=(?!=)")
#: Loosest first; operators of one row associate to the left.
_LEVELS = [["||"], ["&&"], ["==", "!=", "<=", ">=", "<", ">"], ["|"], ["^"], ["&"], ["<<", ">>"], ["+", "-"], ["*", "/", "%"]]
_OPS = sorted((o for row in _LEVELS for o in row), key=len, reverse=True)
_RANK = {o: i for i, row in enumerate(_LEVELS) for o in row}
KEYWORDS = {"nil", "true", "false", "if", "else", "return", "for", "in", "continue", "break"}
INT_MIN, INT_MAX = -(1 << 63), (1 << 63) - 1
MAX_NESTING = 400


class Parser:
    def __init__(self, text: str):
        self.s, self.i, self.depth = text, 0, 0
        self.skip()

    # -- lexing
    def skip(self) -> None:
        self.i = _SKIP.match(self.s, self.i).end()

    def fail(self, what: str = "") -> SyntaxError_:
        line = self.s.count("\n", 0, self.i) + 1
        at = self.i - self.s.rfind("\n", 0, self.i)
        return SyntaxError_(f"error at line {line}, position {at}{', ' + what if what else ''}")

    def peek(self, token: str) -> bool:
        return self.s.startswith(token, self.i)

    def take(self, token: str) -> bool:
        if self.peek(token):
            self.i += len(token)
            self.skip()
            return True
        return False

    def need(self, token: str) -> None:
        if not self.take(token):
            raise self.fail(f"expecting: {token}")

    def match(self, rx: re.Pattern) -> re.Match | None:
        m = rx.match(self.s, self.i)
        if m:
            self.i = m.end()
            self.skip()
        return m

    def keyword(self, word: str) -> bool:
        m = _NAME.match(self.s, self.i)
        if m and m[0] == word:
            self.i = m.end()
            self.skip()
            return True
        return False

    def name(self) -> str:
        m = self.match(_NAME)
        if not m:
            raise self.fail("expecting a name")
        return m[0]

    # -- statements
    def program(self) -> Node:
        body = self.statements("")
        if self.i < len(self.s):
            raise self.fail("end of input expected")
        return Node("block", body=body)

    def statements(self, close: str) -> list[Node]:
        body: list[Node] = []
        while self.i < len(self.s) and not (close and self.peek(close)):
            body.append(self.statement())
            if not self.take(";"):
                break
            while self.take(";"):
                pass
        return body

    def statement(self) -> Node:
        self.depth += 1
        if self.depth > MAX_NESTING:
            raise self.fail("nested too deep")
        try:
            return self.ternary()
        finally:
            self.depth -= 1

    def ternary(self) -> Node:
        cond = self.binary(0)
        if self.take("?"):
            then = self.statement()
            self.need(":")
            return Node("ternary", cond=cond, then=then, other=self.statement())
        return cond

    def operator(self) -> str | None:
        for o in _OPS:
            if self.peek(o):
                # "a |= b" and closures after a value are no operators
                return None if _ASSIGN.match(self.s, self.i) and o not in ("==", "!=", "<=", ">=") and self.s.startswith("=", self.i + len(o)) else o
        return None

    def binary(self, least: int) -> Node:
        left = self.unary()
        while True:
            op = self.operator()
            if op is None or _RANK[op] < least:
                return left
            self.take(op)
            right = self.binary(_RANK[op] + 1)
            left = Node("logic" if op in ("&&", "||") else "binary", op=op, left=left, right=right)

    def unary(self) -> Node:
        ops = ""
        while self.i < len(self.s) and self.s[self.i] in "!~-+":
            ops += self.s[self.i]
            self.i += 1
            self.skip()
        node = self.control() or self.postfix(self.primary())
        if ops and node.kind == "lit" and type(node.value) in (int, float) and ops[-1] in "+-" and not (node.value == 1 << 63 and ops[-1] == "+"):
            node, ops = Node("lit", value=-node.value if ops[-1] == "-" else node.value), ops[:-1]
        if node.kind == "lit" and type(node.value) is int and node.value > INT_MAX:
            raise self.fail("integer overflow")
        return Node("prefix", ops=ops, value=node) if ops else node

    def control(self) -> Node | None:
        start = self.i
        m = _NAME.match(self.s, self.i)
        word = m[0] if m else ""
        if self.peek("||") or self.peek("|"):
            return self.closure()
        if word == "if" and self.keyword("if"):
            if not self.take("("):
                self.i = start
                return None
            cond = self.statement()
            self.need(")")
            then = self.statement()
            save = self.i
            other = self.statement() if self.keyword("else") else None
            if other is None:
                self.i = save
            return Node("if", cond=cond, then=then, other=other)
        if word == "return" and self.keyword("return"):
            values = []
            if self.i < len(self.s) and self.s[self.i] not in ";})]":
                values.append(self.statement())
                while len(values) < 3 and self.take(","):
                    values.append(self.statement())
            return Node("return", values=values)
        if word == "for" and self.keyword("for"):
            self.need("(")
            names = [self.name()]
            while self.take(","):
                names.append(self.name())
            if not self.keyword("in"):
                raise self.fail("expecting: in")
            over = self.statement()
            self.need(")")
            return Node("for", names=names, over=over, body=self.statement())
        if word in ("continue", "break") and self.keyword(word):
            return Node(word)
        return None

    def closure(self) -> Node:
        start = self.i
        names: list[str] = []
        if not self.take("||"):
            self.need("|")
            while not self.peek("|"):
                names.append(self.name())
                if not self.take(","):
                    break
            self.need("|")
        body = self.statement()
        return Node("closure", names=names, body=body, text=self.s[start : self.i].strip())

    # -- expressions
    def primary(self) -> Node:
        s, i = self.s, self.i
        if i >= len(s):
            raise self.fail("unexpected end")
        if m := self.match(_FLOAT):
            return Node("lit", value=float(m[0]))
        if m := self.match(_INT):
            v = int(m[0], 0) if m[0][:2] in ("0x", "0b", "0o") else int(m[0])
            if v > 1 << 63:
                raise self.fail("integer overflow")
            return Node("lit", value=v)
        if m := self.match(_STRING):
            q = m[0][0]
            return Node("lit", value=m[0][1:-1].replace(q + q, q))
        if s[i] == "/" and (m := self.match(_REGEX)):
            return Node("regex", pattern=m[1], flags=m[2])
        if s[i] == "`":
            return self.template()
        if self.take("&{"):
            return Node("ano", fields=self.fields("}"))
        if s[i] == "{":
            return self.brace()
        if self.take("["):
            items = self.listing("]")
            return Node("list", items=items)
        if self.take("("):
            inner = self.statement()
            self.need(")")
            return Node("paren", value=inner)
        if s[i] == "." and (s[i + 1 : i + 2] == "." or _NAME.match(s, self.skipped(i + 1))):
            return self.chain(Node("root"))
        m = _NAME.match(s, i)
        if not m:
            raise self.fail()
        word = self.name()
        if word in ("nil", "true", "false"):
            return Node("lit", value={"nil": None, "true": True, "false": False}[word])
        if word in ("inf", "nan"):
            return Node("lit", value=float(word))
        if self.take("("):
            return Node("call", name=word, args=self.listing(")"))
        if a := self.match(_ASSIGN):
            return Node("assign", target=Node("var", name=word), op=a[0], value=self.statement())
        if self.peek("{"):
            return self.instance(word)
        return Node("var", name=word)

    def skipped(self, i: int) -> int:
        return _SKIP.match(self.s, i).end()

    def instance(self, word: str) -> Node:
        save = self.i
        self.take("{")
        if self.peek("|"):
            body = self.closure()
            self.need("}")
            return Node("enum", name=word, member=None, by=body)
        m = _NAME.match(self.s, self.i)
        if m and self.s[self.skipped(m.end()) : self.skipped(m.end()) + 1] == "}":
            member = self.name()
            self.need("}")
            return Node("enum", name=word, member=member, by=None)
        if self.peek("}") or (m and self.s[self.skipped(m.end()) : self.skipped(m.end()) + 1] == ":"):
            return Node("instance", name=word, fields=self.fields("}"))
        self.i = save
        return Node("var", name=word)

    def brace(self) -> Node:
        save = self.i
        self.take("{")
        m = _NAME.match(self.s, self.i)
        if self.peek("}") or (m and self.s[self.skipped(m.end()) : self.skipped(m.end()) + 1] == ":"):
            return Node("thing", fields=self.fields("}"))
        body = self.statements("}")
        if not body:
            self.i = save
            raise self.fail()
        self.need("}")
        return Node("block", body=body)

    def fields(self, close: str) -> list[tuple[str, Node]]:
        out = []
        while not self.peek(close):
            name = self.name()
            self.need(":")
            out.append((name, Node("var", name=name) if self.peek(",") or self.peek(close) else self.statement()))
            if not self.take(","):
                break
        self.need(close)
        return out

    def listing(self, close: str) -> list[Node]:
        out = []
        while not self.peek(close):
            out.append(self.statement())
            if not self.take(","):
                break
        self.need(close)
        return out

    def template(self) -> Node:
        self.i += 1
        parts: list[Node] = []
        text = ""
        while True:
            if self.i >= len(self.s):
                raise self.fail("unexpected end")
            two, one = self.s[self.i : self.i + 2], self.s[self.i]
            if two in ("``", "{{", "}}"):
                text += one
                self.i += 2
            elif one == "`":
                self.i += 1
                self.skip()
                break
            elif one == "{":
                if text:
                    parts.append(Node("lit", value=text))
                    text = ""
                self.i += 1
                self.skip()
                parts.append(self.statement())
                if not self.peek("}"):
                    raise self.fail("expecting: }")
                self.i += 1
            else:
                text += one
                self.i += 1
        if text:
            parts.append(Node("lit", value=text))
        return Node("template", parts=parts)

    def postfix(self, node: Node) -> Node:
        while True:
            if self.peek("["):
                self.take("[")
                parts: list[Node | None] = [None]
                while not self.peek("]"):
                    if self.take(":"):
                        parts.append(None)
                    else:
                        parts[-1] = self.statement()
                self.need("]")
                if len(parts) > 3:
                    raise self.fail("a slice has three parts at most")
                node = Node("index", value=node, at=parts[0]) if len(parts) == 1 else Node("slice", value=node, start=parts[0], stop=parts[1], step=parts[2] if len(parts) > 2 else None)
                if a := self.match(_ASSIGN):
                    return Node("assign", target=node, op=a[0], value=self.statement())
            elif self.peek("."):
                node = self.chain(node)
                if node.kind == "assign":
                    return node
            else:
                return node

    def chain(self, value: Node) -> Node:
        self.take("..") or self.need(".")
        name = self.name()
        if self.take("("):
            return Node("method", value=value, name=name, args=self.listing(")"))
        node = Node("prop", value=value, name=name)
        if a := self.match(_ASSIGN):
            return Node("assign", target=node, op=a[0], value=self.statement())
        return node


@lru_cache(maxsize=1024)
def parse(text: str) -> Node:
    """The tree of a program; kept for repeated texts."""
    try:
        return Parser(text).program()
    except RecursionError:
        raise SyntaxError_("nested too deep") from None


#: Calls that change state: a query with one of them is a change.
CHANGING = set(
    """add again_at again_in assign cancel clear del del_enum del_type extend extend_unique fill import mod_enum mod_type new_procedure
    mod_procedure del_procedure rename_procedure new_type set_type pop push remove ren rename_enum rename_type restrict set set_args set_closure
    set_enum set_name set_owner shift splice task to_thing to_type unshift wse commit new_collection del_collection rename_collection""".split()
)


def changes(node: Any) -> bool:
    """Whether a tree assigns a property or calls something that changes state (else it is pure)."""
    if isinstance(node, Node):
        if node.kind == "assign" and node.target.kind != "var":
            return True
        if node.kind in ("call", "method") and node.name in CHANGING:
            return True
        return any(changes(v) for v in node.f.values())
    if isinstance(node, (list, tuple)):
        return any(changes(v) for v in node)
    return False
