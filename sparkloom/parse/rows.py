"""Rows that an extractor writes, shared by all languages."""

from __future__ import annotations

import re
from typing import Any

from sparkloom.functions.text import TEST_PATHS
from sparkloom.parse.lexer import Source
from sparkloom.schema import edge_id

BODY_LIMIT, KEPT_SHARE = 50_000, 0.8
_TEST_PATH = re.compile("|".join(TEST_PATHS), re.I)


def is_test_path(path: str) -> bool:
    return bool(_TEST_PATH.search(path))


class Rows:
    """Nodes and edges of one file in the order written; the first write wins.

    ``imports`` are (specifier, order) and are resolved over all files later."""

    def __init__(self, path: str, language: str, source: Source):
        self.path, self.language, self.source = path, language, source
        self.file = f"file:{path}"
        self.nodes: dict[str, dict[str, Any]] = {}
        self.edges: dict[tuple, dict[str, Any]] = {}
        self.imports: list[str] = []
        self.framework: str | None = None

    def node(self, id: str, kind: str, name: str, start: int, end: int, body_at: int | None = None, **more: Any) -> str:
        """A symbol over source[start:end] whose body, if any, begins at body_at."""
        if id in self.nodes:
            return id
        text = self.source.text[start:end]
        signature = text if body_at is None else self.source.text[start:body_at].rstrip()
        row = dict(zip(("start_row", "start_col", "end_row", "end_col"), (*self.source.place(start), *self.source.place(end)), strict=True))
        kept, cut = text, None
        if len(text) > BODY_LIMIT:
            kept, cut = text[:BODY_LIMIT], True
            line = kept.rfind("\n")
            if line > BODY_LIMIT * KEPT_SHARE:
                kept = kept[:line]
        self.nodes[id] = {"id": id, "kind": kind, "name": name, "path": self.path, "language": self.language, **row, "signature": signature, "body": kept, "body_truncated": cut, **more}
        return id

    def edge(self, kind: str, src: str, dst: str, unresolved: str | None = None, exported: str | None = None) -> None:
        key = (src, dst, kind, exported)
        if key not in self.edges:
            self.edges[key] = {"id": edge_id(kind, src, dst), "kind": kind, "src": src, "dst": dst, "unresolved": unresolved, "exported_name": exported}

    def define(self, id: str) -> None:
        self.edge("DEFINES", self.file, id)

    def call(self, caller: str, symbol: str) -> None:
        self.edge("CALLS", caller, f"unresolved:callable:{symbol}", symbol)

    def extends(self, cls: str, symbol: str) -> None:
        self.edge("EXTENDS", cls, f"unresolved:class:{symbol}", symbol)

    def implements(self, cls: str, symbol: str) -> None:
        self.edge("IMPLEMENTS", cls, f"unresolved:interface:{symbol}", symbol)
