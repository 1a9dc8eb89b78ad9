"""Tokens of JavaScript, TypeScript and Java, with places and matched brackets."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np

OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_NAME = re.compile(r"[A-Za-z_$#\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*")
_NUMBER = re.compile(r"0[xXbBoO][\w]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?\w*|\.\d[\d_]*(?:[eE][+-]?\d+)?")
_OPERATOR = re.compile(r"=>|\.\.\.|\?\.(?!\d)|>>>=|<<=|>>=|\*\*=|&&=|\|\|=|\?\?=|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|\*\*|[-+*/%&|^]=|::|.", re.S)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
#: What holds no end, escape or embedded value, of a template and of strings.
_PLAIN = {"`": re.compile(r"[^`\\$]+"), '"': re.compile(r'[^"\\\n]+'), "'": re.compile(r"[^'\\\n]+")}
#: From this length line ends are found in one pass over the bytes.
_LONG = 10_000
#: After these words a slash begins a regular expression and a < begins JSX.
_BEFORE_VALUE = frozenset("return typeof instanceof in of new delete void throw case do else yield await default".split())


@dataclass(slots=True)
class Token:
    kind: str  # name, string, template, number, regex, op
    text: str
    start: int
    end: int
    match: int = -1


def _line_starts(text: str) -> list[int]:
    if len(text) < _LONG:
        return [0] + [m.end() for m in re.finditer("\n", text)]
    wide = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") if not text.isascii() else np.frombuffer(text.encode(), "u1")
    return [0, *(np.flatnonzero(wide == 10) + 1).tolist()]


class Source:
    """Text with its tokens; rows and columns count from 0."""

    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self._lines = _line_starts(text)
        self.tokens: list[Token] = []
        self._lex(0, len(text), None)
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind != "op":
                continue
            if t.text in OPEN:
                stack.append(i)
            elif t.text in CLOSE:
                while stack and OPEN[self.tokens[stack[-1]].text] != t.text:
                    stack.pop()
                if stack:
                    j = stack.pop()
                    t.match, self.tokens[j].match = j, i
        for i in stack:
            self.tokens[i].match = len(self.tokens) - 1

    def place(self, offset: int) -> tuple[int, int]:
        row = bisect_right(self._lines, offset) - 1
        return row, offset - self._lines[row]

    def _value_next(self) -> bool:
        """A value, not an operator, comes next."""
        if not self.tokens:
            return True
        t = self.tokens[-1]
        if t.kind == "op":
            return t.text not in (")", "]", "}", "++", "--")
        return t.kind == "name" and t.text in _BEFORE_VALUE

    def _add(self, kind: str, start: int, end: int) -> int:
        self.tokens.append(Token(kind, self.text[start:end], start, end))
        return end

    def _lex(self, at: int, end: int, until: str | None) -> int:
        """Lex up to ``end``, or past the bracket that closes ``until``."""
        text, depth, java = self.text, 0, self.language == "java"
        while at < end:
            c = text[at]
            if c.isspace():
                at += 1
            elif text.startswith("//", at) or (c == "#" and text.startswith("#!", at) and at == 0):
                stop = text.find("\n", at)
                at = end if stop < 0 else stop
            elif text.startswith("/*", at):
                stop = text.find("*/", at + 2)
                at = end if stop < 0 else stop + 2
            elif java and text.startswith('"""', at):
                stop = text.find('"""', at + 3)
                at = self._add("string", at, end if stop < 0 else stop + 3)
            elif c in "\"'":
                at = self._add("string", at, self._string(at, end))
            elif c == "`" and not java:
                at = self._template(at, end)
            elif m := _NAME.match(text, at):
                at = self._add("name", at, m.end())
            elif m := _NUMBER.match(text, at):
                at = self._add("number", at, m.end())
            elif c == "/" and not java and self._value_next() and (m := _REGEX.match(text, at)):
                at = self._add("regex", at, m.end())
            elif c == "<" and self.language in ("javascript", "tsx") and self._value_next() and re.match(r"<(>|[A-Za-z][\w.:-]*(?!\s*(,|extends\b))[\s/>])", text[at : at + 80]):
                at = self._jsx(at, end)
            else:
                m = _OPERATOR.match(text, at)
                at = self._add("op", at, m.end())
                if until:
                    depth += (m[0] == "{") - (m[0] == "}")
                    if depth < 0:
                        return at
        return at

    def _string(self, at: int, end: int) -> int:
        quote, i = self.text[at], at + 1
        while i < end and self.text[i] != quote:
            if self.text[i] == "\n":
                return i
            m = _PLAIN[quote].match(self.text, i, end)
            i = m.end() if m else i + 2
        return min(i + 1, end)

    def _template(self, at: int, end: int) -> int:
        """A template is one token, followed by the tokens of what it embeds."""
        index, i = len(self.tokens), at + 1
        self.tokens.append(Token("template", "", at, at))
        while i < end and self.text[i] != "`":
            if self.text.startswith("${", i):
                self._add("op", i + 1, i + 2)
                i = self._lex(i + 2, end, "}")
            elif m := _PLAIN["`"].match(self.text, i, end):
                i = m.end()
            else:
                i += 2 if self.text[i] == "\\" else 1
        self.tokens[index].end = stop = min(i + 1, end)
        self.tokens[index].text = self.text[at:stop]
        return stop

    def _jsx(self, at: int, end: int) -> int:
        """Elements become a ``jsx`` token and the tokens of what they embed."""
        index, i, depth = len(self.tokens), at, 0
        self.tokens.append(Token("jsx", "", at, at))
        while i < end:
            if self.text[i] == "{":
                self._add("op", i, i + 1)
                i = self._lex(i + 1, end, "}")
            elif self.text[i] == "<":
                closing = self.text.startswith("</", i)
                i += 1
                while i < end and self.text[i] != ">":
                    if self.text[i] in "\"'":
                        i = self._string(i, end)
                    elif self.text[i] == "{":
                        self._add("op", i, i + 1)
                        i = self._lex(i + 1, end, "}")
                    else:
                        i += 1
                alone = self.text[i - 1] == "/" and not closing
                i += 1
                depth += 0 if alone else -1 if closing else 1
                if depth <= 0:
                    break
            else:
                i += 1
        self.tokens[index].end = stop = min(i, end)
        self.tokens[index].text = self.text[at:stop]
        return stop
