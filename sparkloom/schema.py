"""The property graph: node and edge columns, id formats, kinds."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()

NODE_KINDS = ("Repository", "Folder", "File", "Class", "Interface", "TypeAlias", "Enum", "Function", "Method", "Property", "Variable")
STORE_KINDS = ("Community", "Unresolved")
EDGE_KINDS = ("CONTAINS", "DEFINES", "HAS_METHOD", "HAS_PROPERTY", "CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS", "EXPORTS", "IN_COMMUNITY")
CALLABLE = ("Function", "Method")

NODE = T.StructType(
    [T.StructField("id", _S, False), T.StructField("kind", _S, False), T.StructField("name", _S, False)]
    + [T.StructField(c, _S) for c in ("path", "language")]
    + [T.StructField(c, _I) for c in ("start_row", "start_col", "end_row", "end_col")]
    + [T.StructField(c, _S) for c in ("signature", "body")]
    + [T.StructField("body_truncated", _B)]
    + [T.StructField(c, _S) for c in ("http_method", "route", "router_object", "builder")]
    + [T.StructField("is_test", _B), T.StructField("test_framework", _S)]
    + [T.StructField(c, _S) for c in ("content_hash", "last_indexed", "last_commit", "source_url")]
    + [T.StructField("seq", T.LongType())]
)
EDGE = T.StructType(
    [T.StructField(c, _S, c != "dst") for c in ("id", "kind", "src")]
    + [T.StructField(c, _S) for c in ("dst", "unresolved", "exported_name")]
    + [T.StructField("seq", T.LongType())]
)


def repo_id(path: str) -> str:
    return f"repo:{path}"


def folder_id(path: str) -> str:
    return f"folder:{path}"


def file_id(path: str) -> str:
    return f"file:{path}"


def edge_id(kind: str, src: str, dst: str) -> str:
    return f"{kind}:{src}->{dst}"
