"""Declarations, calls, imports and exports of JavaScript and TypeScript.

A tolerant tree is read from the tokens: only the shapes that matter get nodes,
the rest is passed over.  ``extract`` then walks the tree in source order.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field

from sparkloom.parse.lexer import Source
from sparkloom.parse.rows import Rows, is_test_path

# Router methods, functions of test suites, packages of test frameworks.
VERBS = frozenset(("get", "post", "put", "delete", "patch", "head", "options", "use", "all"))
TEST_CALLS = frozenset(("describe", "it", "test", "suite", "bench", "fdescribe", "fit", "xdescribe", "xit", "xtest"))
FRAMEWORKS = {"@jest/globals": "jest", "bun:test": "bun", "jest": "jest", "mocha": "mocha", "vitest": "vitest"}
EXPORTABLE = ("Class", "Enum", "Function", "Interface", "Method", "TypeAlias", "Variable")
_CONTROL = frozenset("catch for if switch while with".split())
_WORDS = frozenset("as async await break case const continue default delete do else export extends finally in instanceof let of return satisfies throw try typeof var void yield".split()) | _CONTROL
_MODIFIERS = frozenset("abstract accessor async declare get override private protected public readonly set static".split())
_FUNCTIONS = ("arrow", "function")


@dataclass
class Node:
    type: str
    start: int
    end: int
    name: str | None = None
    body: int | None = None  # offset where the body begins
    children: list["Node"] = field(default_factory=list)
    inner: list["Node"] = field(default_factory=list)  # what the body holds
    more: dict = field(default_factory=dict)


class Parser:
    def __init__(self, source: Source):
        self.s, self.t = source, source.tokens
        self.unclosed: set[tuple[int, int]] = set()
        #: Templates and elements, whose tokens hold others.
        self.wide = [i for i, x in enumerate(self.t) if x.kind in ("template", "jsx")]

    # Small helpers; positions are token numbers.

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def op(self, i: int, text: str) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "op" and self.t[i].text == text

    def name_at(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "name"

    def past(self, i: int) -> int:
        """Past the bracket group that opens at i."""
        m = self.t[i].match
        return m + 1 if m > i else len(self.t)

    def end_of(self, i: int, j: int) -> int:
        """Where the text of the tokens i to j - 1 ends."""
        ends = [self.t[k].end for k in self.wide[bisect_left(self.wide, i) : bisect_left(self.wide, j)]]
        return max([self.t[j - 1].end, *ends])

    def generic(self, i: int, end: int) -> int:
        """Past type arguments that open at i; i itself if these are none.  What
        never closes before ``end`` is remembered, with all opened in it."""
        if (i, end) in self.unclosed:
            return i
        open_, j = [], i
        while j < end:
            x = self.t[j]
            if x.kind == "op":
                if x.text == "<":
                    if (j, end) in self.unclosed:
                        break
                    open_.append(j)
                elif x.text in (">", ">=") or x.text.startswith(">>"):
                    del open_[max(len(open_) - x.text.count(">"), 0) :]
                    if not open_:
                        return j + 1
                elif x.text in ("(", "[", "{"):
                    j = self.past(j)
                    continue
                elif x.text not in (",", "|", "&", ".", "=>", "?", ":", "=", "...", "-", "+", "`"):
                    break
            elif x.kind not in ("name", "string", "number", "template"):
                break
            j += 1
        self.unclosed.update((k, end) for k in open_)
        return i

    def type_end(self, i: int, end: int, stops: tuple[str, ...]) -> int:
        """Past a type that begins at i; an object type is one if a type is due."""
        due = True
        while i < end:
            x = self.t[i]
            if x.kind == "op":
                if x.text == "=>":
                    due = True
                elif x.text in stops and not (x.text == "{" and due):
                    return i
                elif x.text in ("(", "[", "{"):
                    i, due = self.past(i), False
                    continue
                elif x.text == "<":
                    i, due = max(self.generic(i, end), i + 1), False
                    continue
                elif x.text in (")", "]", "}"):
                    return i
                else:
                    due = x.text in ("|", "&", ".", "?", ":")
                    if x.text not in ("|", "&", ".", "?", ":", "-", "+", "...", ","):
                        return i
            else:
                due = x.text in ("keyof", "typeof", "readonly", "is", "extends", "infer", "unique", "asserts", "in")
                if i and not due and self.t[i - 1].kind != "op" and self.s.place(x.start)[0] > self.s.place(self.t[i - 1].start)[0]:
                    return i
            i += 1
        return i

    def defaults(self, i: int) -> list[Node]:
        """Default values of a parameter list that opens at i."""
        out, end, j = [], self.past(i) - 1, i + 1
        while j < end:
            if self.op(j, "="):
                stop = j + 1
                while stop < end and not self.op(stop, ","):
                    stop = self.past(stop) if self.text(stop) in ("(", "[", "{") and self.t[stop].kind == "op" else stop + 1
                out += self.sequence(j + 1, stop, False)
                j = stop
            else:
                j = self.past(j) if self.t[j].kind == "op" and self.text(j) in ("(", "[") else j + 1
        return out

    # Statements.

    def declares(self, i: int) -> bool:
        """Token i begins a statement, as far as what stands before it tells."""
        if i == 0:
            return True
        p = self.t[i - 1]
        if p.kind == "op":
            return p.text in (";", "{", "}", ")") or (p.text == "]" or p.text == ">") and self._new_line(i)
        if p.kind == "name":
            return p.text in ("export", "default", "declare", "abstract", "else", "do", "async") or (p.text not in _WORDS and self._new_line(i))
        return self._new_line(i)

    def _new_line(self, i: int) -> bool:
        return self.s.place(self.t[i].start)[0] > self.s.place(self.t[i - 1].end)[0]

    def sequence(self, i: int, end: int, statements: bool = True) -> list[Node]:
        out: list[Node] = []
        while i < end:
            node, j = self.item(i, end, statements)
            if node is not None:
                out.append(node)
            i = max(j, i + 1)
        return out

    def item(self, i: int, end: int, statements: bool) -> tuple[Node | None, int]:
        x = self.t[i]
        if x.kind == "name":
            word = x.text
            if word == "import" and not self.op(i + 1, "(") and not self.op(i + 1, ".") and self.declares(i):
                return self.import_statement(i, end)
            if word == "export" and self.declares(i):
                return self.export_statement(i, end)
            if word in ("const", "let", "var") and (self.name_at(i + 1) or self.op(i + 1, "{") or self.op(i + 1, "[")):
                if word == "const" and self.text(i + 1) == "enum":
                    found = self.named_type(i + 1, end)
                    if found:
                        found[0].start = x.start
                        return found
                return self.declaration(i, end)
            if word == "abstract" and self.text(i + 1) == "class":
                node, j = self.class_like(i + 1, end, True)
                node.start = x.start
                return node, j
            if word == "class" and not self.op(i - 1, "."):
                return self.class_like(i, end, self.declares(i))
            if word in ("interface", "enum", "type") and self.name_at(i + 1) and self.declares(i):
                found = self.named_type(i, end)
                if found:
                    return found
            if word == "function" or word == "async" and self.text(i + 1) == "function" and not self._new_line(i + 1):
                return self.function(i, end)
            if word in _CONTROL and self.op(i + 1, "("):
                return Node("group", x.start, x.end, children=self.sequence(i + 2, self.past(i + 1) - 1, False)), self.past(i + 1)
            if word in _WORDS and word != "async" and not self.op(i + 1, "=>"):
                return None, i + 1
        if x.kind == "op" and x.text == "{":
            stop = self.past(i)
            return Node("block", x.start, self.t[stop - 1].end, children=self.sequence(i + 1, stop - 1)), stop
        if x.kind == "op" and x.text not in ("(", "[", "<", "@"):
            return None, i + 1
        return self.expression(i, end)

    def import_statement(self, i: int, end: int) -> tuple[Node, int]:
        j = i + 1
        while j < end and self.t[j].kind != "string" and not self.op(j, ";"):
            j = self.past(j) if self.op(j, "{") else j + 1
        node = Node("import", self.t[i].start, self.t[min(j, end - 1)].end)
        if j < end and self.t[j].kind == "string" and not self.op(j - 1, "("):
            node.name = _unquoted(self.t[j].text)
        return node, j + 1

    def export_statement(self, i: int, end: int) -> tuple[Node, int]:
        node, j = Node("export", self.t[i].start, self.t[i].end), i + 1
        if self.op(j, "*") or self.op(j, "{") or self.text(j) == "type" and (self.op(j + 1, "{") or self.op(j + 1, "*")):
            j += self.text(j) == "type"
            names = []
            if self.op(j, "{"):
                stop = self.past(j)
                for part in self._split(j + 1, stop - 1):
                    words = [self.text(k) for k in part if self.text(k) != "type" or len(part) == 1]
                    if words:
                        names.append((_unquoted(words[0]), _unquoted(words[-1])))
                j = stop
            else:
                j += 1
                if self.text(j) == "as":
                    j += 2
            if self.text(j) == "from" and j + 1 < end and self.t[j + 1].kind == "string":
                node.name = _unquoted(self.t[j + 1].text)
                return node, j + 2
            node.more["names"] = names
            return node, j
        if self.text(j) == "default":
            j += 1
        while self.op(j, "@"):
            j = self.decorator(j)
        while self.text(j) == "declare":
            j += 1
        if j >= end:
            return node, j
        child, stop = self.item(j, end, True)
        if child is not None:
            node.children = [child]
            name = child.name if child.type in ("function_declaration", "class", "interface", "type", "enum") else None
            if child.type == "declaration" and child.children:
                name = child.children[0].name
            node.more["names"] = [(name, name)] if name else []
            node.end = child.end
        return node, stop

    def decorator(self, i: int) -> int:
        j = i + 2
        while self.op(j, "."):
            j += 2
        return self.past(j) if self.op(j, "(") else j

    def _split(self, i: int, end: int) -> list[list[int]]:
        out, part = [], []
        while i < end:
            if self.op(i, ","):
                out.append(part)
                part = []
            else:
                part.append(i)
            i += 1
        return [p for p in [*out, part] if p]

    def declaration(self, i: int, end: int) -> tuple[Node, int]:
        node, j = Node("declaration", self.t[i].start, self.t[i].end), i + 1
        while j < end:
            first, name = j, None
            if self.op(j, "{") or self.op(j, "["):
                j = self.past(j)
            elif self.name_at(j):
                name = self.text(j)
                j += 1
            else:
                break
            if self.op(j, "!"):
                j += 1
            if self.op(j, ":"):
                j = self.type_end(j + 1, end, ("=", ",", ";", "{"))
            declarator = Node("declarator", self.t[first].start, self.t[j - 1].end, name)
            if self.op(j, "="):
                j += 1
                values, stop = [], j
                while stop < end and not self.op(stop, ",") and not self.op(stop, ";"):
                    if stop > j and self._ended(stop):
                        break
                    value, k = self.item(stop, end, False)
                    if value is not None:
                        values.append((stop, value, k))
                    stop = max(k, stop + 1)
                declarator.children = [v for _, v, _ in values]
                if len(values) == 1 and values[0][0] == j and values[0][2] == stop:
                    declarator.more["value"] = values[0][1]
                elif len(values) == 1 and self.text(j) in ("await", "new"):
                    pass
                declarator.end = self.end_of(first, min(stop, end))
                j = stop
            elif self.text(j) in ("of", "in"):
                node.children.append(declarator)
                return node, j
            node.children.append(declarator)
            node.end = declarator.end
            if not self.op(j, ","):
                break
            j += 1
        return node, j

    def _ended(self, i: int) -> bool:
        """A line end parts token i from a finished value before it."""
        if not self._new_line(i):
            return False
        x, p = self.t[i], self.t[i - 1]
        if p.kind == "op" and p.text not in (")", "]", "}"):
            return False
        if p.kind == "name" and p.text in _WORDS:
            return False
        return not (x.kind == "op" and x.text not in ("{", "@", "++", "--", "(", "[")) and x.text not in ("instanceof", "in", "as", "satisfies")

    def named_type(self, i: int, end: int) -> tuple[Node, int] | None:
        word, j = self.text(i), i + 2
        if word == "type":
            if self.op(j, "<"):
                j = self.generic(j, end)
            if not self.op(j, "="):
                return None
            stop = self.type_end(j + 1, end, (";",))
            return Node("type", self.t[i].start, self.t[stop - 1].end, self.text(i + 1)), stop
        while j < end and not self.op(j, "{"):
            j += 1
        if j >= end:
            return None
        stop = self.past(j)
        return Node(word, self.t[i].start, self.t[stop - 1].end, self.text(i + 1), self.t[j].start), stop

    def function(self, i: int, end: int) -> tuple[Node, int]:
        start, declared = i, self.declares(i)
        j = i + (2 if self.text(i) == "async" else 1)
        if self.op(j, "*"):
            j += 1
        name = self.text(j) if self.name_at(j) else None
        j += name is not None
        if self.op(j, "<"):
            j = max(self.generic(j, end), j + 1)
        node = Node("function_declaration" if declared and name else "function", self.t[start].start, self.t[min(j, end - 1)].end, name)
        if not self.op(j, "("):
            return node, j
        return self.finish(node, j, end)

    def finish(self, node: Node, j: int, end: int) -> tuple[Node, int]:
        """Parameters, return type and body from the bracket at j."""
        node.more["params"] = self.defaults(j)
        j = self.past(j)
        if self.op(j, ":"):
            j = self.type_end(j + 1, end, ("{", ";", "=>", "=", ","))
        if self.op(j, "{"):
            stop = self.past(j)
            node.body, node.inner = self.t[j].start, self.sequence(j + 1, stop - 1)
            node.end = self.t[stop - 1].end
            return node, stop
        node.end = self.t[min(j, end) - 1].end
        if node.type == "function_declaration":
            node.type = "signature"  # an overload: no body, no function
        return node, j

    def class_like(self, i: int, end: int, declared: bool) -> tuple[Node, int]:
        j = i + 1
        name = self.text(j) if self.name_at(j) and self.text(j) not in ("extends", "implements") else None
        node = Node("class" if declared and name else "class_expression", self.t[i].start, self.t[i].end, name)
        j += name is not None
        if self.op(j, "<"):
            j = max(self.generic(j, end), j + 1)
        heritage: list[tuple[str, str]] = []
        mode = None
        while j < end and not self.op(j, "{"):
            word = self.text(j)
            if word in ("extends", "implements"):
                mode, j = word, j + 1
                continue
            if self.op(j, ","):
                j += 1
                continue
            first = j
            while j < end and not self.op(j, "{") and not self.op(j, ",") and self.text(j) != "implements":
                if self.op(j, "<"):
                    j = max(self.generic(j, end), j + 1)
                else:
                    j = self.past(j) if self.op(j, "(") else j + 1
            text = self.s.text[self.t[first].start : self.t[j - 1].end]
            if mode == "extends":
                node.children += self.sequence(first, j, False) if "(" in text else []
                plain = text.split("<", 1)[0].rstrip() if self.s.language != "java" else text
                if "(" not in text:
                    heritage.append(("extends", plain))
            elif mode and "(" not in text:
                heritage.append(("implements", text))
        node.more["heritage"] = heritage
        if j >= end:
            return node, j
        stop = self.past(j)
        node.body, node.end = self.t[j].start, self.t[stop - 1].end
        node.inner = self.members(j + 1, stop - 1)
        return node, stop

    def members(self, i: int, end: int) -> list[Node]:
        out = []
        while i < end:
            if self.op(i, ";"):
                i += 1
                continue
            if self.op(i, "@"):
                i = self.decorator(i)
                continue
            first, j = i, i
            while self.text(j) in _MODIFIERS and self.name_at(j) and not (self.t[j + 1].kind == "op" and self.text(j + 1) in ("(", "=", ";", ":", "?", "!", "<", "}")):
                j += 1
            if self.op(j, "*"):
                j += 1
            if self.op(j, "{"):  # a static block
                stop = self.past(j)
                out.append(Node("block", self.t[first].start, self.t[stop - 1].end, children=self.sequence(j + 1, stop - 1)))
                i = stop
                continue
            if self.op(j, "["):
                stop = self.past(j)
                name = self.s.text[self.t[j].start : self.t[stop - 1].end]
                j = stop
            else:
                name = self.text(j)
                j += 1
            if self.op(j, "?") or self.op(j, "!"):
                j += 1
            after = self.generic(j, end) if self.op(j, "<") else j
            if self.op(after, "("):
                node = Node("method", self.t[first].start, self.t[j - 1].end, name)
                node, i = self.finish(node, after, end)
                if node.body is not None:
                    out.append(node)
                continue
            node = Node("field", self.t[first].start, self.t[j - 1].end, name)
            if self.op(j, ":"):
                j = self.type_end(j + 1, end, ("=", ";"))
            if self.op(j, "="):
                stop = j + 1
                while stop < end and not self.op(stop, ";") and not (stop > j + 1 and self._ended(stop)):
                    value, k = self.item(stop, end, False)
                    if value is not None:
                        node.children.append(value)
                    stop = max(k, stop + 1)
                j = stop
            node.end = self.end_of(first, min(j, end))
            out.append(node)
            i = max(j, i + 1)
        return out

    # Expressions.

    def arrow(self, i: int, end: int) -> tuple[Node, int] | None:
        j = i + 1 if self.text(i) == "async" and self.name_at(i) and not self.op(i + 1, "=>") and (self.op(i + 1, "(") or self.name_at(i + 1) or self.op(i + 1, "<")) else i
        if self.op(j, "<"):
            j = self.generic(j, end)
        if self.name_at(j) and self.op(j + 1, "=>"):
            node, k = Node("arrow", self.t[i].start, self.t[j].end), j + 1
        elif self.op(j, "("):
            k = self.past(j)
            if self.op(k, ":"):
                k = self.type_end(k + 1, end, ("=>", ";", ")", ",", "{", "="))
            if not self.op(k, "=>") or k >= end:
                return None
            node = Node("arrow", self.t[i].start, self.t[k].end)
            node.more["params"] = self.defaults(j)
        else:
            return None
        k += 1
        if self.op(k, "{"):
            stop = self.past(k)
            node.body, node.end = self.t[k].start, self.t[stop - 1].end
            node.inner = self.sequence(k + 1, stop - 1)
            return node, stop
        if k >= end:
            return node, k
        stop, values = k, []
        while stop < end and not self.op(stop, ",") and not self.op(stop, ";") and not (self.t[stop].kind == "op" and self.text(stop) in (")", "]", "}")):
            if stop > k and self._ended(stop):
                break
            value, m = self.item(stop, end, False)
            if value is not None:
                values.append(value)
            stop = max(m, stop + 1)
        node.body, node.end = self.t[k].start, self.end_of(k, stop)
        node.more["value"] = values
        return node, stop

    def expression(self, i: int, end: int) -> tuple[Node | None, int]:
        found = self.arrow(i, end)
        if found:
            return found
        x, children = self.t[i], []
        callee = x.kind if x.kind != "name" else "identifier"
        if x.kind == "name" and x.text == "new" and i + 1 < end:
            return self.new(i, end)
        if x.kind == "op" and x.text == "@":
            j = i + 1
            return None, j
        if x.kind == "op" and x.text in ("(", "["):
            j = self.past(i)
            children, callee = self.sequence(i + 1, min(j - 1, end), False), "group"
        elif x.kind == "op":
            return None, i + 1
        else:
            j = i + 1
            if x.kind in ("template", "jsx"):
                while j < end and self.t[j].start < x.end:
                    stop = self.past(j) if self.op(j, "{") else j + 1
                    children += self.sequence(j + 1, stop - 1, False) if self.op(j, "{") else []
                    j = stop
        prop = obj = None
        last: Node | None = None
        while j < end:
            if self.op(j, ".") or self.op(j, "?.") and not self.op(j + 1, "(") and not self.op(j + 1, "["):
                obj, prop = self.s.text[x.start : self.t[j - 1].end], self.text(j + 1)
                callee, j = "member", j + 2
                continue
            if self.op(j, "?."):
                j += 1
                continue
            if self.op(j, "!") and not self.op(j + 1, "=") and not self._new_line(j):
                j += 1
                continue
            if self.op(j, "["):
                if self._new_line(j) and last is None and callee == "identifier":
                    break
                stop = self.past(j)
                children += self.sequence(j + 1, stop - 1, False)
                callee, j = "subscript", stop
                continue
            k = self.generic(j, end) if self.op(j, "<") else j
            if self.op(k, "("):
                if x.text in ("function", "class") or k > j and k == j:
                    break
                stop = self.past(k)
                if callee == "identifier" and self.op(stop, "{") and i and self.t[i - 1].kind in ("op", "name") and self.text(i - 1) in ("{", ",", "}", "get", "set", "async", "static", "*"):
                    node, m = self.finish(Node("method", x.start, x.end, x.text), k, end)
                    return node, m
                function = (callee, self.s.text[x.start : self.t[j - 1].end], obj, prop, j - 1)
                args = self.sequence(k + 1, stop - 1, False)
                last = Node("call", x.start, self.t[stop - 1].end, children=[*children, *args])
                last.more = {"function": function, "args": args, "first": self._first_string(k + 1, stop - 1), "import": x.text == "import" and callee == "identifier"}
                children, callee, prop, obj, j = [last], "call", None, None, stop
                continue
            if j < end and self.t[j].kind == "template" and not self._new_line(j):
                tail = self.t[j].end
                j += 1
                while j < end and self.t[j].start < tail:
                    stop = self.past(j) if self.op(j, "{") else j + 1
                    children += self.sequence(j + 1, stop - 1, False) if self.op(j, "{") else []
                    j = stop
                callee = "template"
                continue
            break
        if last is not None and callee == "call":
            return last, j
        return (Node("group", x.start, self.end_of(i, j), children=children) if children else None), j

    def new(self, i: int, end: int) -> tuple[Node, int]:
        j = i + 1
        if self.op(j, "("):
            j = self.past(j)
        else:
            j += 1
        while self.op(j, ".") and j < end:
            j += 2
        constructor = self.s.text[self.t[i + 1].start : self.t[j - 1].end]
        if self.op(j, "<"):
            j = self.generic(j, end)
        children, stop = [], j
        if self.op(j, "("):
            stop = self.past(j)
            children = self.sequence(j + 1, stop - 1, False)
        node = Node("new", self.t[i].start, self.t[min(stop, end) - 1].end, children=children, more={"constructor": constructor})
        # A chain on the new object: new X().run()
        while self.op(stop, ".") and self.name_at(stop + 1):
            obj, prop = self.s.text[node.start : self.t[stop - 1].end], self.text(stop + 1)
            k = self.generic(stop + 2, end) if self.op(stop + 2, "<") else stop + 2
            if not self.op(k, "("):
                stop += 2
                node = Node("group", node.start, self.t[stop - 1].end, children=[node])
                continue
            after = self.past(k)
            args = self.sequence(k + 1, after - 1, False)
            call = Node("call", node.start, self.t[after - 1].end, children=[node, *args])
            call.more = {"function": ("member", f"{obj}.{prop}", obj, prop, stop + 1), "args": args, "first": self._first_string(k + 1, after - 1), "import": False}
            node, stop = call, after
        return node, stop

    def _first_string(self, i: int, end: int) -> str | None:
        """The first argument that is a plain string."""
        while i < end:
            if self.t[i].kind == "string" and (self.op(i + 1, ",") or i + 1 == end) and (self.op(i - 1, "(") or self.op(i - 1, ",")):
                return _unquoted(self.t[i].text)
            i = self.past(i) if self.t[i].kind == "op" and self.text(i) in ("(", "[", "{") else i + 1
        return None


def _unquoted(s: str) -> str:
    return s[1:-1] if len(s) >= 2 and s[0] in "\"'`" and s[0] == s[-1] else s


class Extractor:
    def __init__(self, rows: Rows):
        self.r = rows

    def run(self, tree: list[Node]) -> None:
        framework = self.framework(tree)
        self.r.framework = framework or ("unknown" if is_test_path(self.r.path) else None)
        for n in tree:
            self.visit(n, None)

    def framework(self, tree: list[Node]) -> str | None:
        calls, stack, seen = False, list(tree), 0
        while stack and seen <= 5000:
            n = stack.pop()
            seen += 1
            if n.type == "import" and n.name in FRAMEWORKS:
                return FRAMEWORKS[n.name]
            calls = calls or n.type == "call" and n.more["function"][1] in TEST_CALLS
            stack += self.below(n)
        return "jest" if calls else None

    @staticmethod
    def below(n: Node) -> list[Node]:
        value = n.more.get("value")
        return [*n.more.get("params", ()), *n.children, *n.inner, *(value if isinstance(value, list) else ())]

    def visit(self, n: Node, enclosing: str | None) -> None:
        handler = getattr(self, f"on_{n.type}", None)
        if handler is None or handler(n, enclosing):
            for c in self.below(n):
                self.visit(c, enclosing)

    def on_import(self, n: Node, enclosing: str | None) -> None:
        if n.name is not None:
            self.r.imports.append(n.name)

    def on_export(self, n: Node, enclosing: str | None) -> None:
        if n.name is not None:
            self.r.imports.append(n.name)
            return
        for c in n.children:
            self.visit(c, enclosing)
        for local, name in n.more.get("names", ()):
            # The first declaration of that name in this file.
            target = next((i for i, row in self.r.nodes.items() if row["name"] == local and row["kind"] in EXPORTABLE), None)
            if target:
                self.r.edge("EXPORTS", self.r.file, target, exported=name)

    def on_call(self, n: Node, enclosing: str | None) -> bool:
        if n.more["import"]:
            if n.more["first"] is not None:
                self.r.imports.append(n.more["first"])
            return True
        handlers = [a for a in n.more["args"] if a.type in _FUNCTIONS]
        if handlers:
            kind, text, obj, prop, _ = n.more["function"]
            label, tag, http = text or "<call>", n.more["first"], {}
            if kind == "member":
                label = f"{obj}.{prop}"
                if prop.lower() in VERBS:
                    http = {"http_method": prop.upper(), "route": tag, "router_object": obj}
            for k, a in enumerate(handlers):
                row, col = self.r.source.place(a.start)
                suffix = f"#{k}" if len(handlers) > 1 else ""
                name = f'<{label}:"{tag}">{suffix}' if tag else f"<{label}@{row}>{suffix}"
                id = self.r.node(f"{self.r.file}#handler:{label}@{row}:{col}", "Function", name, a.start, a.end, a.body, **http)
                self.r.define(id)
                self.calls(a, id)
        return True

    def on_class(self, n: Node, enclosing: str | None) -> None:
        cls = self.r.node(f"{self.r.file}#class:{n.name}", "Class", n.name, n.start, n.end, n.body)
        self.r.define(cls)
        for kind, symbol in n.more["heritage"]:
            (self.r.extends if kind == "extends" else self.r.implements)(cls, symbol)
        for m in n.inner:
            row = self.r.source.place(m.start)[0]
            if m.type == "method":
                id = self.r.node(f"{cls}.method:{m.name}@{row}", "Method", m.name, m.start, m.end, m.body)
                self.r.edge("HAS_METHOD", cls, id)
                self.calls(m, id)
            elif m.type == "field":
                self.r.edge("HAS_PROPERTY", cls, self.r.node(f"{cls}.prop:{m.name}", "Property", m.name, m.start, m.end))

    def _type(self, n: Node, kind: str, tag: str) -> None:
        self.r.define(self.r.node(f"{self.r.file}#{tag}:{n.name}", kind, n.name, n.start, n.end, n.body))

    def on_interface(self, n: Node, enclosing: str | None) -> None:
        self._type(n, "Interface", "interface")

    def on_type(self, n: Node, enclosing: str | None) -> None:
        self._type(n, "TypeAlias", "type")

    def on_enum(self, n: Node, enclosing: str | None) -> None:
        self._type(n, "Enum", "enum")

    def on_signature(self, n: Node, enclosing: str | None) -> None:
        return None

    def on_function_declaration(self, n: Node, enclosing: str | None) -> None:
        row = self.r.source.place(n.start)[0]
        id = self.r.node(f"{self.r.file}#fn:{n.name}@{row}", "Function", n.name, n.start, n.end, n.body)
        self.r.define(id)
        self.calls(n, id)
        for c in n.inner:
            self.visit(c, id)

    def on_declaration(self, n: Node, enclosing: str | None) -> bool:
        handled = False
        for d in n.children:
            value = d.more.get("value")
            if d.name and isinstance(value, Node) and value.type in _FUNCTIONS:
                row = self.r.source.place(d.start)[0]
                id = self.r.node(f"{self.r.file}#fn:{d.name}@{row}", "Function", d.name, d.start, d.end)
                self.r.define(id)
                self.calls(value, id)
                # Of an expression body only what the expression holds is visited.
                body = value.inner or [c for v in value.more.get("value", ()) for c in self.below(v)]
                for c in body:
                    self.visit(c, id)
                handled = True
            elif enclosing is None and d.name and isinstance(value, Node) and value.type in ("call", "new"):
                builder = value.more["constructor"] if value.type == "new" else value.more["function"][1]
                self.r.define(self.r.node(f"{self.r.file}#var:{d.name}", "Variable", d.name, d.start, d.end, builder=builder))
        return not handled

    def on_declarator(self, n: Node, enclosing: str | None) -> bool:
        if isinstance(n.more.get("value"), Node):
            self.visit(n.more["value"], enclosing)
            return False
        return True

    def calls(self, root: Node, caller: str) -> None:
        """Calls in source order, without those of functions further in."""
        stack = list(reversed(self.below(root)))
        while stack:
            n = stack.pop()
            if n.type in (*_FUNCTIONS, "function_declaration", "method"):
                continue
            if n.type == "declarator" and isinstance(n.more.get("value"), Node) and n.more["value"].type in _FUNCTIONS:
                continue
            if n.type == "call" and not n.more["import"]:
                kind, text, _, prop, _ = n.more["function"]
                symbol = prop if kind == "member" and prop else text
                if symbol:
                    self.r.call(caller, symbol)
            stack += reversed(self.below(n))


def extract(path: str, language: str, text: str) -> Rows:
    source = Source(text, language)
    rows = Rows(path, language, source)
    Extractor(rows).run(Parser(source).sequence(0, len(source.tokens)))
    return rows
