"""Lexer and parser of the SQL dialect: a recursive descent over tokens, to dataclasses.

SELECT with a conjunction of comparisons and an optional ORDER BY over one or two tables (comma or JOIN), single-row
INSERT, UPDATE, DELETE, CREATE/DROP TABLE, CREATE/DROP INDEX (parsed, not offered), DESC, SHOW TABLES, BEGIN, COMMIT, ABORT,
ROLLBACK, HELP, EXIT. Keywords in any case, identifiers with case; strings in single quotes without escapes; a sign
belongs to its number; a number with a dot is FLOAT. Comments: -- and /* */.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from lakeloom.plans.errors import SyntaxFault

# The keywords of the dialect.
KEYWORDS = frozenset([
    "show", "tables", "create", "drop", "desc", "insert", "into", "values", "delete", "from", "asc", "order", "by",
    "where", "update", "set", "select", "int", "char", "float", "index", "and", "join", "on", "begin", "commit",
    "abort", "rollback", "primary", "key", "exit", "help", "table",
])
_TOKEN = re.compile(r"\s+|--[^\n]*|/\*.*?\*/|(?P<num>[+-]?\d+\.\d*|[+-]?\d+)|(?P<word>[A-Za-z][A-Za-z0-9_]*)|'(?P<str>[^']*)'|(?P<op><>|<=|>=|[<>=(),.;*])", re.S)


@dataclass(frozen=True)
class Token:
    kind: str  # word, key, int, float, str, op, end
    value: object
    at: int


def tokens(text: str) -> list[Token]:
    out, pos = [], 0
    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if not m:
            raise SyntaxFault(f"unexpected {text[pos]!r} at {pos}")
        if m["num"] is not None:
            out.append(Token("float", float(m["num"]), pos) if "." in m["num"] else Token("int", int(m["num"]), pos))
        elif m["word"] is not None:
            low = m["word"].lower()
            out.append(Token("key", low, pos) if low in KEYWORDS else Token("word", m["word"], pos))
        elif m["str"] is not None:
            out.append(Token("str", m["str"], pos))
        elif m["op"] is not None:
            out.append(Token("op", m["op"], pos))
        pos = m.end()
    return [*out, Token("end", None, pos)]


@dataclass(frozen=True)
class Literal:
    kind: str  # INT, FLOAT, CHAR
    value: object


@dataclass(frozen=True)
class Name:
    table: str | None
    column: str


@dataclass(frozen=True)
class Comparison:
    left: Name
    op: str
    right: Name | Literal


@dataclass(frozen=True)
class ColumnDef:
    name: str
    kind: str  # INT, FLOAT, CHAR
    size: int
    primary: bool = False


@dataclass(frozen=True)
class Statement:
    verb: str
    table: str | None = None
    tables: tuple[str, ...] = ()
    columns: tuple[Name, ...] | None = None  # None: *
    where: tuple[Comparison, ...] = ()
    order: tuple[Name, bool] | None = None
    values: tuple[Literal, ...] = ()
    sets: tuple[tuple[str, Literal], ...] = ()
    defs: tuple[ColumnDef, ...] = ()
    keys: tuple[str, ...] = field(default=())


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    def peek(self, value: str, kind: str = "key") -> bool:
        t = self.tokens[self.at]
        return t.kind == kind and t.value == value

    def take(self, value: str, kind: str = "key") -> bool:
        if self.peek(value, kind):
            self.at += 1
            return True
        return False

    def need(self, value: str, kind: str = "key") -> None:
        if not self.take(value, kind):
            t = self.tokens[self.at]
            raise SyntaxFault(f"{value!r} expected at {t.at}")

    def word(self) -> str:
        t = self.tokens[self.at]
        if t.kind != "word":
            raise SyntaxFault(f"a name expected at {t.at}")
        self.at += 1
        return str(t.value)

    def listed(self, one) -> tuple:
        out = [one()]
        while self.take(",", "op"):
            out.append(one())
        return tuple(out)

    def literal(self) -> Literal:
        t = self.tokens[self.at]
        kinds = {"int": "INT", "float": "FLOAT", "str": "CHAR"}
        if t.kind not in kinds:
            raise SyntaxFault(f"a value expected at {t.at}")
        self.at += 1
        return Literal(kinds[t.kind], t.value)

    def name(self) -> Name:
        first = self.word()
        return Name(first, self.word()) if self.take(".", "op") else Name(None, first)

    def comparison(self) -> Comparison:
        left = self.name()
        t = self.tokens[self.at]
        if t.kind != "op" or t.value not in ("=", "<>", "<", ">", "<=", ">="):
            raise SyntaxFault(f"a comparison expected at {t.at}")
        self.at += 1
        right = self.name() if self.tokens[self.at].kind == "word" else self.literal()
        return Comparison(left, str(t.value), right)

    def where(self) -> tuple[Comparison, ...]:
        if not self.take("where"):
            return ()
        out = [self.comparison()]
        while self.take("and"):
            out.append(self.comparison())
        return tuple(out)

    def column_def(self) -> ColumnDef | str:
        if self.take("primary"):
            self.need("key")
            self.need("(", "op")
            key = self.word()
            self.need(")", "op")
            return key
        name, size, kind = self.word(), 4, ""
        if self.take("int"):
            kind = "INT"
        elif self.take("float"):
            kind = "FLOAT"
        elif self.take("char"):
            self.need("(", "op")
            n = self.literal()
            self.need(")", "op")
            if n.kind != "INT" or n.value < 1:
                raise SyntaxFault("CHAR needs a positive length")
            kind, size = "CHAR", n.value
        else:
            raise SyntaxFault(f"a type expected at {self.tokens[self.at].at}")
        primary = False
        if self.take("primary"):
            self.need("key")
            primary = True
        return ColumnDef(name, kind, size, primary)

    def statement(self) -> Statement:
        verb = self.tokens[self.at]
        self.at += 1
        if verb.kind != "key":
            raise SyntaxFault("a statement begins with a keyword")
        make = getattr(self, f"_{verb.value}", None)
        if make is None:
            raise SyntaxFault(f"no statement begins with {verb.value}")
        out = make()
        self.take(";", "op")
        if self.tokens[self.at].kind != "end":
            raise SyntaxFault(f"text after the statement at {self.tokens[self.at].at}")
        return out

    def _select(self) -> Statement:
        columns = None if self.take("*", "op") else self.listed(self.name)
        self.need("from")
        tables = [self.word()]
        while self.take(",", "op") or self.take("join"):
            tables.append(self.word())
        where, order = self.where(), None
        if self.take("order"):
            self.need("by")
            by = self.name()
            order = (by, self.take("desc") or not (self.take("asc") or True))
        return Statement("select", tables=tuple(tables), columns=columns, where=where, order=order)

    def _insert(self) -> Statement:
        self.need("into")
        table = self.word()
        self.need("values")
        self.need("(", "op")
        values = self.listed(self.literal)
        self.need(")", "op")
        return Statement("insert", table, values=values)

    def _assignment(self) -> tuple[str, Literal]:
        name = self.word()
        self.need("=", "op")
        return name, self.literal()

    def _update(self) -> Statement:
        table = self.word()
        self.need("set")
        sets = self.listed(self._assignment)
        return Statement("update", table, sets=sets, where=self.where())

    def _delete(self) -> Statement:
        self.need("from")
        return Statement("delete", self.word(), where=self.where())

    def _create(self) -> Statement:
        if self.take("index"):
            return Statement("create index", *self._index())
        self.need("table")
        table = self.word()
        self.need("(", "op")
        parts = self.listed(self.column_def)
        self.need(")", "op")
        defs = tuple(p for p in parts if isinstance(p, ColumnDef))
        keys = tuple(d.name for d in defs if d.primary) + tuple(p for p in parts if isinstance(p, str))
        return Statement("create table", table, defs=defs, keys=keys)

    def _index(self) -> tuple[str]:
        table = self.word()
        self.need("(", "op")
        self.listed(self.word)
        self.need(")", "op")
        return (table,)

    def _drop(self) -> Statement:
        if self.take("index"):
            return Statement("drop index", *self._index())
        self.need("table")
        return Statement("drop table", self.word())

    def _desc(self) -> Statement:
        return Statement("desc", self.word())

    def _show(self) -> Statement:
        self.need("tables")
        return Statement("show tables")


for _verb in ("begin", "commit", "abort", "rollback", "help", "exit"):
    setattr(Parser, f"_{_verb}", lambda self, verb=_verb: Statement(verb))


def parse(text: str) -> Statement:
    return Parser(text).statement()
