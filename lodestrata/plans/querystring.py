"""The mini-language of query_string.

    either := both (OR both)*
    both   := one (AND one)*
    one    := ( either ) | [field:] ( term | "phrase" | ( either ) )

Two terms side by side are joined by the default operator.  AND binds tighter.
"""

from __future__ import annotations

import re

from . import tree as t
from .errors import SearchError

TOKEN = re.compile(r'\s*(?:(?P<open>\()|(?P<close>\))|"(?P<phrase>[^"]*)"|(?P<field>[^\s()":]+):(?=\S)|(?P<term>[^\s()"]+))')


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = TOKEN.match(text, at)
        if not m:
            raise SearchError(f"can't read the query string from {text[at:]!r} on")
        kind = m.lastgroup
        word = m[kind]
        out.append((word.lower(), word) if kind == "term" and word in ("AND", "OR") else (kind, word))
        at = m.end()
    return out


class Reader:
    def __init__(self, found: list[tuple[str, str]], default: str):
        self.tokens, self.i, self.default = found, 0, default

    def peek(self) -> str:
        return self.tokens[self.i][0] if self.i < len(self.tokens) else ""

    def take(self) -> str:
        self.i += 1
        return self.tokens[self.i - 1][1]

    def either(self, field: str):
        items = [self.both(field)]
        while self.peek() == "or" or self.default == "or" and self.peek() not in ("", "close", "and"):
            if self.peek() == "or":
                self.take()
            items.append(self.both(field))
        return items[0] if len(items) == 1 else t.Any_(tuple(items))

    def both(self, field: str):
        items = [self.one(field)]
        while self.peek() == "and" or self.default == "and" and self.peek() not in ("", "close", "or"):
            if self.peek() == "and":
                self.take()
            items.append(self.one(field))
        return items[0] if len(items) == 1 else t.All(tuple(items))

    def one(self, field: str):
        kind = self.peek()
        if kind == "field":
            return self.one(self.take())
        if kind == "open":
            self.take()
            inner = self.either(field)
            if self.peek() != "close":
                raise SearchError("a parenthesis isn't closed")
            self.take()
            return inner
        if kind not in ("term", "phrase"):
            raise SearchError("the query string ends or joins where a term is due")
        if not field:
            raise SearchError("a term of the query string has no field")
        return t.Contains(field, self.take())


def parse_query_string(body: dict):
    """Its tree; ``fields`` reads the whole string once for each, joined by the default operator."""
    text = body.get("query")
    if not isinstance(text, str):
        raise SearchError("query_string needs a query")
    default = str(body.get("default_operator", "or")).lower()
    if default not in ("or", "and"):
        raise SearchError(f"unknown operator {default!r}")
    found = tokens(text)
    if not [x for x in found if x[0] not in ("open", "close")] or text.strip() == "*":
        return t.MatchAll()
    items = []
    for field in body.get("fields") or [body.get("default_field", "")]:
        r = Reader(found, default)
        items.append(r.either(field))
        if r.i < len(found):
            raise SearchError(f"can't read {found[r.i][1]!r} in the query string")
    return items[0] if len(items) == 1 else (t.All if default == "and" else t.Any_)(tuple(items))
