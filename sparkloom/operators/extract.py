"""Source files to node, edge and import rows: one narrow stage over files."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.schema import EDGE, NODE

_ROW = T.StructType(
    [T.StructField("what", T.StringType()), T.StructField("file", T.StringType()), T.StructField("file_seq", T.LongType()), T.StructField("local_seq", T.LongType()), T.StructField("spec", T.StringType()), T.StructField("framework", T.StringType())]
    + [T.StructField("node", NODE), T.StructField("edge", EDGE)]
)
#: Tags of rows, and the columns that hold what they say.
TAGS, _SAID = ("node", "edge", "import", "file", "failed"), ("spec", "framework", "node", "edge")
_ARROW_TYPES = {T.StringType: pa.string(), T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.BooleanType: pa.bool_()}


def _fields(of: T.StructType) -> list[pa.Field]:
    return [pa.field(f.name, pa.struct(_fields(f.dataType)) if isinstance(f.dataType, T.StructType) else _ARROW_TYPES[type(f.dataType)], f.nullable) for f in of]


_SCHEMA = pa.schema(_fields(_ROW))
#: Characters of text, and for each file some more, whose rows are given on together.
_HELD_SIZE, _FILE_SIZE = 1 << 24, 1 << 13
#: Calls in each other that the parsers may make, some six a level of nesting.
DEEPEST = 300_000
#: Symbols a file may hold before its numbers would meet the next file's.
_PER_FILE = 1 << 24


def extract_file(path: str, language: str, text: str):
    from sparkloom.parse import java, js

    return (java if language == "java" else js).extract(path, language, text)


def _struct(rows: list[dict], of: T.StructType) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array([r.get(f.name) for r in rows], _ARROW_TYPES[type(f.dataType)]) for f in of], fields=_fields(of))


def _batch(what: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows (file, seq, place in the file, what it says) of one tag."""
    files, seqs, places, said = zip(*rows, strict=True)
    none = dict.fromkeys(_SAID)
    if what in ("node", "edge"):
        of = NODE if what == "node" else EDGE
        none[what] = _struct([r | {"seq": seq * _PER_FILE + i} for seq, i, r in zip(seqs, places, said, strict=True)], of)
    elif what in ("import", "file"):
        none["spec" if what == "import" else "framework"] = pa.array(said, pa.string())
    columns = {"what": pa.array([what] * len(rows), pa.string()), "file": pa.array(files, pa.string()), "file_seq": pa.array(seqs, pa.int64()), "local_seq": pa.array(places, pa.int64())}
    columns |= {c: pa.nulls(len(rows), _SCHEMA.field(c).type) if a is None else a for c, a in none.items()}
    return pa.RecordBatch.from_arrays([columns[c] for c in _ROW.names], schema=_SCHEMA)


def _extract(batches: Iterator[pa.RecordBatch], tags: frozenset[str]) -> Iterator[pa.RecordBatch]:
    # Frames of Python functions live on the heap: deep nesting is a matter of memory.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEPEST))
    held: dict[str, list[tuple]] = {}
    size = 0
    for batch in batches:
        for row in range(batch.num_rows):
            path, language, text, seq = [batch.column(c)[row].as_py() for c in ("path", "language", "content", "seq")]
            size += _FILE_SIZE + len(text or "")
            try:
                found = extract_file(path, language, text or "")
            except (RecursionError, MemoryError, IndexError, ValueError):
                held.setdefault("failed", []).append((f"file:{path}", seq, 0, None))
            else:
                said = {"file": [found.framework], "node": found.nodes.values(), "edge": found.edges.values(), "import": found.imports}
                for what, items in said.items():
                    if what in tags and items:
                        held.setdefault(what, []).extend((found.file, seq, i, x) for i, x in enumerate(items))
            if size >= _HELD_SIZE:
                yield from (_batch(what, rows) for what, rows in held.items() if what in tags)
                held, size = {}, 0
    yield from (_batch(what, rows) for what, rows in held.items() if what in tags)


def extract_symbols(files: DataFrame, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """Tagged rows (node, edge, import, file, failed) of files (path, language,
    content, seq); of all tags, or those asked for.  A file that can't be read
    gives one failed row (see ``failures``); null text is an empty file."""
    wanted = frozenset(tags)
    return files.select("path", "language", "content", "seq").mapInArrow(lambda batches: _extract(batches, wanted), _ROW)


def failures(rows: DataFrame) -> DataFrame:
    """(file,) of files whose symbols could not be read."""
    return rows.where("what = 'failed'").select("file")


def parts_of(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes, edges, imports (src, spec) and test marks (file, framework)."""
    nodes = rows.where("what = 'node'").select("node.*")
    edges = rows.where("what = 'edge'").select("edge.*")
    imports = rows.where("what = 'import'").select(F.col("file").alias("src"), "spec")
    marks = rows.where("what = 'file' and framework is not null").select("file", "framework")
    return nodes, edges, imports, marks
