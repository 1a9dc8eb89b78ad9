"""Declarations, calls and imports of Java."""

from __future__ import annotations

import re

from sparkloom.parse.lexer import Source
from sparkloom.parse.rows import Rows, is_test_path

_MODIFIERS = frozenset("abstract default final native non private protected public sealed static strictfp synchronized transient volatile".split())
_NOT_CALLS = frozenset("assert catch do else for if instanceof new return super switch synchronized this throw try while yield".split())


class Extractor:
    def __init__(self, rows: Rows):
        self.r, self.s = rows, rows.source
        self.t = rows.source.tokens

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def op(self, i: int, text: str) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "op" and self.t[i].text == text

    def name_at(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "name"

    def past(self, i: int) -> int:
        m = self.t[i].match
        return m + 1 if m > i else len(self.t)

    def generic(self, i: int) -> int:
        """Past type arguments that open at i."""
        depth, j = 0, i
        while j < len(self.t):
            x = self.t[j]
            if x.kind == "op" and x.text == "<":
                depth += 1
            elif x.kind == "op" and set(x.text) == {">"}:
                depth -= len(x.text)
                if depth <= 0:
                    return j + 1
            elif x.kind == "op" and x.text not in (",", ".", "?", "&", "[", "]", "@"):
                return i + 1
            j += 1
        return j

    def run(self) -> None:
        test = any(self.op(i, "@") and self.text(i + 1) == "Test" for i in range(len(self.t)))
        self.r.framework = "junit" if test else "unknown" if is_test_path(self.r.path) else None
        self.visit(0, len(self.t))

    def visit(self, i: int, end: int) -> None:
        """Top level, and the bodies of what is no class or interface."""
        while i < end:
            if self.text(i) == "import" and self.name_at(i):
                j = i + 1
                while j < end and not self.op(j, ";"):
                    j += 1
                first = i + 2 if self.text(i + 1) == "static" else i + 1
                spec = "".join(self.text(k) for k in range(first, j))
                self.r.imports.append(re.sub(r"[.]\*$", "", spec))
                i = j + 1
            elif self.name_at(i) and self.text(i) in ("class", "interface") and self.name_at(i + 1) and not self.op(i - 1, ".") and not self.op(i - 1, "@"):
                i = self.declared(i, self.back(i))
            else:
                i += 1

    def back(self, i: int) -> int:
        """The first modifier or annotation of a declaration at i."""
        while i > 0:
            if self.text(i - 1) in _MODIFIERS and self.name_at(i - 1):
                i -= 1
            elif self.op(i - 1, ")") and self.op(self.t[i - 1].match - 2, "@"):
                i = self.t[i - 1].match - 2
            elif self.op(i - 2, "@"):
                i -= 2
            else:
                return i
        return i

    def declared(self, i: int, first: int) -> int:
        """A class or interface whose keyword is at i; past its body."""
        kind, name = self.text(i), self.text(i + 1)
        body = i + 2
        while body < len(self.t) and not self.op(body, "{"):
            body += 1
        if body >= len(self.t):
            return body
        stop = self.past(body)
        id = self.r.node(f"{self.r.file}#{kind}:{name}", kind.capitalize(), name, self.t[first].start, self.t[stop - 1].end, self.t[body].start)
        self.r.define(id)
        if kind == "class":
            self.heritage(id, i + 2, body)
        self.members(id, body + 1, stop - 1)
        return stop

    def heritage(self, cls: str, i: int, end: int) -> None:
        mode = None
        while i < end:
            word = self.text(i)
            if word in ("extends", "implements", "permits"):
                mode, i = word, i + 1
            elif self.op(i, ","):
                i += 1
            else:
                first = i
                while i < end and not self.op(i, ",") and self.text(i) not in ("extends", "implements", "permits"):
                    i = self.generic(i) if self.op(i, "<") else i + 1
                symbol = self.s.text[self.t[first].start : self.t[i - 1].end]
                if mode == "extends":
                    self.r.extends(cls, symbol)
                elif mode == "implements":
                    self.r.implements(cls, symbol)

    def members(self, cls: str, i: int, end: int) -> None:
        while i < end:
            first = i
            while i < end and (self.text(i) in _MODIFIERS and self.name_at(i) or self.op(i, "@") and self.text(i + 1) != "interface"):
                if self.op(i, "@"):
                    i += 2
                    while self.op(i, "."):
                        i += 2
                    i = self.past(i) if self.op(i, "(") else i
                else:
                    i += 1
            if i >= end:
                return
            if self.text(i) in ("class", "interface") and self.name_at(i + 1):
                i = self.declared(i, first)
                continue
            if self.text(i) in ("enum", "record") and self.name_at(i + 1) or self.op(i, "@"):
                while i < end and not self.op(i, "{"):
                    i += 1
                i = self.past(i) if i < end else end
                continue
            j, bracket = i, None
            while j < end and not self.op(j, ";") and not self.op(j, "{") and not self.op(j, "="):
                if self.op(j, "("):
                    bracket = j
                    break
                j = self.generic(j) if self.op(j, "<") else j + 1
            if bracket is not None:
                k = self.past(bracket)
                while k < end and not self.op(k, "{") and not self.op(k, ";"):
                    k += 1
                stop = self.past(k) if self.op(k, "{") else min(k + 1, end)
                start = i
                if self.op(start, "<"):
                    start = self.generic(start)
                if bracket - 1 > start:  # a type stands before the name: no constructor
                    self.method(cls, first, bracket, k, stop)
                i = stop
                continue
            if self.op(j, "{"):  # an initialiser, or a body not understood
                i = self.past(j)
                continue
            stop = j
            while stop < end and not self.op(stop, ";"):
                stop = self.past(stop) if self.t[stop].kind == "op" and self.text(stop) in ("(", "[", "{") else stop + 1
            self.fields(cls, first, i, stop)
            i = stop + 1

    def method(self, cls: str, first: int, bracket: int, k: int, stop: int) -> None:
        name, start = self.text(bracket - 1), self.t[first].start
        body = self.t[k].start if self.op(k, "{") else None
        id = self.r.node(f"{cls}.method:{name}@{self.s.place(start)[0]}", "Method", name, start, self.t[stop - 1].end, body)
        self.r.edge("HAS_METHOD", cls, id)
        if body is not None:
            self.calls(id, k + 1, stop - 1)

    def fields(self, cls: str, first: int, i: int, stop: int) -> None:
        j, names = i, []
        while j < stop:
            if self.op(j, "<"):
                j = self.generic(j)
                continue
            if self.name_at(j) and (j + 1 == stop or self.op(j + 1, "=") or self.op(j + 1, ",") or self.op(j + 1, "[") and (self.name_at(j - 1) or self.op(j - 1, ","))):
                names.append(self.text(j))
                j += 1
                while j < stop and not self.op(j, ","):
                    j = self.past(j) if self.t[j].kind == "op" and self.text(j) in ("(", "[", "{") else self.generic(j) if self.op(j, "<") else j + 1
            j += 1
        for name in names:
            self.r.edge("HAS_PROPERTY", cls, self.r.node(f"{cls}.prop:{name}", "Property", name, self.t[first].start, self.t[min(stop, len(self.t) - 1)].end))

    def calls(self, caller: str, i: int, end: int) -> None:
        made = []
        for j in range(i, end):
            if not self.name_at(j):
                continue
            word = self.text(j)
            if word == "new" and self.name_at(j + 1):
                k = j + 2
                while self.op(k, "."):
                    k += 2
                if self.op(k, "<"):
                    k = self.generic(k)
                if self.op(k, "("):
                    made.append((j, self.s.text[self.t[j + 1].start : self.t[k - 1].end]))
            elif self.op(j + 1, "(") and word not in _NOT_CALLS and not (self.text(j - 1) == "new" or self.constructed(j)):
                after = self.past(j + 1)
                declares = (self.op(after, "{") or self.text(after) == "throws") and (self.name_at(j - 1) and self.text(j - 1) not in _NOT_CALLS | {"else"} or self.op(j - 1, ">") or self.op(j - 1, "]"))
                if not declares and not (self.op(after, "{") and self.op(j - 1, "@")):
                    self.r.call(caller, word)
        for _, symbol in made:
            self.r.call(caller, symbol)

    def constructed(self, j: int) -> bool:
        """The name at j ends the type of a ``new a.b.C(...)``."""
        while self.op(j - 1, ".") and self.name_at(j - 2):
            j -= 2
        return self.text(j - 1) == "new" and self.name_at(j - 1)


def extract(path: str, language: str, text: str) -> Rows:
    rows = Rows(path, language, Source(text, language))
    Extractor(rows).run()
    return rows
