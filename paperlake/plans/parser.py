"""The dialect's lexer and recursive-descent parser. Whatever follows a statement is an error."""

from __future__ import annotations

import re

from . import ast

_TOKEN = re.compile(r"""\s+|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<string>'(?:[^'\\]|''|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[^\W\d]\w*|`[^`]+`)|(?P<op><=|>=|!=|<>|[=<>(),.\[\]*;])|(?P<json>\{)""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")


class ParseError(ValueError):
    pass


def _string(raw: str) -> str:
    """Both a backslash and a doubled quote escape."""
    q, body = raw[0], raw[1:-1]
    body = re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), body, flags=re.S)
    return body.replace("''", "'") if q == "'" else body


def lex(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup == "json":
            end = _json_end(text, at)
            out.append(("json", text[at:end], at))
            at = end
            continue
        if m.lastgroup:
            out.append((m.lastgroup, m[0], at))
        at = m.end()
    return out


def _json_end(text: str, at: int) -> int:
    depth, quoted, i = 0, False, at
    while i < len(text):
        c = text[i]
        if quoted:
            i += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    raise ParseError("the document isn't closed")


#: What may follow a collection's name, and so can't be its alias unless it is quoted.
AFTER_COLLECTION = ("JOIN", "INNER", "LEFT", "RIGHT", "CROSS", "ON", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET")


class Parser:
    def __init__(self, text: str):
        self.tokens = lex(text)
        self.at = 0

    # tokens

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        i = self.at + ahead
        return self.tokens[i][:2] if i < len(self.tokens) else ("end", "")

    def word(self, ahead: int = 0) -> str:
        kind, text = self.peek(ahead)
        return text.upper() if kind == "name" and not text.startswith("`") else ""

    def take(self, *words: str) -> bool:
        """Take these words if they come next."""
        if all(self.word(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise ParseError(f"{' '.join(words)} expected before {self.peek()[1] or 'the end'!r}")

    def symbol(self, text: str) -> bool:
        if self.peek() == ("op", text):
            self.at += 1
            return True
        return False

    def need_symbol(self, text: str) -> None:
        if not self.symbol(text):
            raise ParseError(f"{text!r} expected before {self.peek()[1] or 'the end'!r}")

    def name(self) -> str:
        kind, text = self.peek()
        if kind != "name":
            raise ParseError(f"a name expected before {text or 'the end'!r}")
        self.at += 1
        return text.strip("`")

    def path(self) -> str:
        out = self.name()
        while True:
            if self.symbol("."):
                out += "." + self.name()  # keywords are names here
            elif self.symbol("["):
                kind, text = self.peek()
                if kind == "number" and re.fullmatch(r"-?\d+", text) or (kind, text) == ("op", "*"):
                    self.at += 1
                    out += f"[{text}]"
                    self.need_symbol("]")
                else:
                    raise ParseError(f"an index or * expected before {text!r}")
            else:
                return out

    def collection(self) -> str:
        out = self.name()
        while self.symbol("."):
            out += "." + self.name()
        return out

    def alias(self) -> str | None:
        """A name of its own for a collection in this query, with AS or without."""
        if self.take("AS"):
            return self.name()
        return self.name() if self.peek()[0] == "name" and self.word() not in AFTER_COLLECTION else None

    # statements

    def statement(self):
        heads = {"SELECT": self.select, "INSERT": self.insert, "UPDATE": self.update, "DELETE": self.delete, "CREATE": self.create, "DROP": self.drop}
        if self.word() not in heads:
            raise ParseError(f"a statement begins with one of {', '.join(heads)}")
        out = heads[self.word()]()
        self.symbol(";")
        if self.peek()[0] != "end":
            raise ParseError(f"nothing may follow the statement, but {self.peek()[1]!r} does")
        return out

    def select(self) -> ast.Select:
        self.need("SELECT")
        distinct = self.take("DISTINCT")
        items = None
        if not self.symbol("*"):
            items = [self.item()]
            while self.symbol(","):
                items.append(self.item())
        self.need("FROM")
        q = ast.Select(items, self.collection(), distinct=distinct)
        q.alias = self.alias()
        while (kind := self.join_kind()) is not None:
            name, alias = self.collection(), self.alias()
            on: list[tuple[str, str]] = []
            if kind != "cross":
                self.need("ON")
                on.append(self.equality())
                while self.take("AND"):
                    on.append(self.equality())
            q.joins.append(ast.Join(kind, name, tuple(on), alias))
        if self.take("WHERE"):
            q.where = self.condition()
        if self.take("GROUP", "BY"):
            q.group.append(self.path())
            while self.symbol(","):
                q.group.append(self.path())
        if self.take("HAVING"):
            q.having = self.condition()
        if self.take("ORDER", "BY"):
            q.order.append(self.sort_key())
            while self.symbol(","):
                q.order.append(self.sort_key())
        if self.take("LIMIT"):
            q.limit = self.whole()
        if self.take("OFFSET"):
            q.offset = self.whole()
        return q

    def whole(self) -> int:
        kind, text = self.peek()
        if kind != "number" or not text.isdigit():
            raise ParseError(f"a whole number expected before {text or 'the end'!r}")
        self.at += 1
        return int(text)

    def sort_key(self) -> tuple[str, bool]:
        key = self.aggregate().label if self.is_aggregate() else self.path()
        down = self.take("DESC")
        if not down:
            self.take("ASC")
        return key, down

    def join_kind(self) -> str | None:
        for kind in ("LEFT", "RIGHT"):
            if self.word() == kind:
                self.at += 1
                self.take("OUTER")
                self.need("JOIN")
                return kind.lower()
        if self.take("CROSS", "JOIN"):
            return "cross"
        return "inner" if self.take("INNER", "JOIN") or self.take("JOIN") else None

    def equality(self) -> tuple[str, str]:
        left = self.path()
        self.need_symbol("=")
        return left, self.path()

    def item(self) -> ast.Item:
        value = self.aggregate() if self.is_aggregate() else self.operand()
        if isinstance(value, ast.Literal):
            raise ParseError("a path, function or aggregate expected in the list")
        return ast.Item(value, self.name() if self.take("AS") else None)

    def is_aggregate(self) -> bool:
        return self.word() in AGGREGATES and self.peek(1) == ("op", "(")

    def aggregate(self) -> ast.Aggregate:
        name = self.name().upper()
        self.need_symbol("(")
        distinct = self.take("DISTINCT")
        path = None if self.symbol("*") else self.path()
        self.need_symbol(")")
        if path is None and (name != "COUNT" or distinct):
            raise ParseError(f"{name} needs a path")
        return ast.Aggregate(name, path, distinct)

    def operand(self):
        kind, text = self.peek()
        if kind == "number":
            self.at += 1
            return ast.Literal(float(text) if re.search(r"[.eE]", text) else int(text))
        if kind == "string":
            self.at += 1
            return ast.Literal(_string(text))
        if self.word() in ("TRUE", "FALSE", "NULL") and self.peek(1) != ("op", "."):
            return ast.Literal({"TRUE": True, "FALSE": False, "NULL": None}[self.name().upper()])
        if kind == "name" and self.peek(1) == ("op", "("):
            if self.is_aggregate():
                return self.aggregate()
            name = self.name()
            self.need_symbol("(")
            args = []
            if not self.symbol(")"):
                args.append(self.operand())
                while self.symbol(","):
                    args.append(self.operand())
                self.need_symbol(")")
            return ast.Call(name, tuple(args))
        return ast.Path(self.path())

    def literal(self) -> object:
        value = self.operand()
        if not isinstance(value, ast.Literal):
            raise ParseError("a literal expected")
        return value.value

    # conditions

    def condition(self):
        out = self.conjunction()
        while self.take("OR"):
            out = ast.Or(out, self.conjunction())
        return out

    def conjunction(self):
        out = self.negation()
        while self.take("AND"):
            out = ast.And(out, self.negation())
        return out

    def negation(self):
        if self.take("NOT"):
            return ast.Not(self.negation())
        if self.symbol("("):
            out = self.condition()
            self.need_symbol(")")
            return out
        return self.comparison()

    def comparison(self):
        left = self.operand()
        if self.take("IS", "NOT", "NULL"):
            return ast.Not(ast.IsNull(left))
        if self.take("IS", "NULL"):
            return ast.IsNull(left)
        no = self.take("NOT")
        if self.take("IN"):
            self.need_symbol("(")
            values = [self.literal()]
            while self.symbol(","):
                values.append(self.literal())
            self.need_symbol(")")
            out: object = ast.In(left, tuple(values))
        elif self.take("LIKE"):
            pattern = self.literal()
            if not isinstance(pattern, str):
                raise ParseError("LIKE takes a string")
            out = ast.Like(left, pattern)
        elif self.take("BETWEEN"):
            low = self.operand()
            self.need("AND")
            out = ast.And(ast.Compare(left, ">=", low), ast.Compare(left, "<=", self.operand()))
        else:
            kind, op = self.peek()
            if no or kind != "op" or op not in ("=", "!=", "<>", "<", "<=", ">", ">="):
                raise ParseError(f"a comparison expected before {op or 'the end'!r}")
            self.at += 1
            out = ast.Compare(left, op, self.operand())
        return ast.Not(out) if no else out

    # changes

    def insert(self) -> ast.Insert:
        self.need("INSERT", "INTO")
        name = self.collection()
        if self.symbol("("):
            names = [self.name()]
            while self.symbol(","):
                names.append(self.name())
            self.need_symbol(")")
            self.need("VALUES")
            self.need_symbol("(")
            values = [self.operand()]
            while self.symbol(","):
                values.append(self.operand())
            self.need_symbol(")")
            if len(names) != len(values):
                raise ParseError(f"{len(names)} names but {len(values)} values")
            return ast.Insert(name, values=dict(zip(names, values, strict=True)))
        self.take("VALUES")
        kind, text = self.peek()
        if kind != "json":
            raise ParseError("a document or a list of names expected")
        self.at += 1
        return ast.Insert(name, json=text)

    def update(self) -> ast.Update:
        self.need("UPDATE")
        name = self.collection()
        self.need("SET")
        sets = [self.assignment()]
        while self.symbol(","):
            sets.append(self.assignment())
        return ast.Update(name, sets, self.condition() if self.take("WHERE") else None)

    def assignment(self) -> tuple[str, object]:
        path = self.path()
        self.need_symbol("=")
        return path, self.operand()

    def delete(self) -> ast.Delete:
        self.need("DELETE", "FROM")
        return ast.Delete(self.collection(), self.condition() if self.take("WHERE") else None)

    def create(self) -> ast.CreateIndex:
        self.need("CREATE")
        unique = self.take("UNIQUE")
        self.need("INDEX")
        index = self.name()
        self.need("ON")
        name = self.collection()
        self.need_symbol("(")
        paths = [self.path()]
        while self.symbol(","):
            paths.append(self.path())
        self.need_symbol(")")
        return ast.CreateIndex(index, name, paths, unique)

    def drop(self) -> ast.DropIndex:
        self.need("DROP", "INDEX")
        index = self.name()
        self.need("ON")
        return ast.DropIndex(index, self.collection())


def parse(text: str):
    return Parser(text).statement()
