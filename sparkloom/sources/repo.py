"""Repositories as tables: walking, hashing, git deltas."""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import IGNORED, LANGUAGES, language, url_slug
from sparkloom.operators.graph import numbered
from sparkloom.sources.shared import staged

_URL = re.compile(r"^(https?://|git@|ssh://)")
_FILES = "path string, language string, hash string, content string, seq long"


def is_url(text: str) -> bool:
    return bool(_URL.match(text))


def cache_dir() -> str:
    return os.environ.get("SPARKLOOM_CACHE") or str(Path.home() / ".cache" / "sparkloom")


def git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, text=True).stdout


def resolve_source(spark: SparkSession, source: str) -> tuple[str, str | None]:
    """(local path, url or None): a path as it is, a URL cloned or brought up."""
    if not is_url(source):
        return os.path.abspath(source), None
    slug = spark.range(1).select(url_slug(F.lit(source))).first()[0]
    place = os.path.join(cache_dir(), slug)
    if os.path.isdir(os.path.join(place, ".git")):
        git(place, "fetch", "--depth", "1", "origin")
        git(place, "reset", "--hard", "FETCH_HEAD")
    else:
        os.makedirs(os.path.dirname(place), exist_ok=True)
        subprocess.run(["git", "clone", "--depth", "1", source, place], check=True, capture_output=True)
    return place, source


def language_of(path: str) -> str | None:
    return LANGUAGES.get(path.rsplit(".", 1)[-1].lower()) if "." in os.path.basename(path) else None


_LISTED = "path string, parent string, is_dir boolean"


def listing(spark: SparkSession, root: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path, parent, is_dir) of the folders and source files below ``root``,
    without ignored names and those that start with a dot.  Folders are listed by
    executors, which all mount the disk, level by level; each level is a written
    table.  Unlike Spark's own listing it keeps names that start with an underscore.
    """
    skip = {*IGNORED, *ignore}

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["path"]:
                rows = []
                for entry in os.scandir(folder):
                    if entry.name in skip or entry.name.startswith("."):
                        continue
                    if entry.is_dir(follow_symlinks=False):
                        rows.append((entry.path, folder, True))
                    elif entry.is_file() and language_of(entry.path):
                        rows.append((entry.path, folder, False))
                yield pd.DataFrame(rows, columns=["path", "parent", "is_dir"])

    level, found = spark.createDataFrame([(root,)], "path string"), []
    while not level.isEmpty():
        found.append(staged(level.repartition(spark.sparkContext.defaultParallelism).mapInPandas(below, _LISTED), "listing"))
        level = found[-1].where("is_dir").select("path")
    return reduce(DataFrame.unionByName, found)


def walk_order(listed: DataFrame) -> DataFrame:
    """(path, language, seq) of the source files in walk order: depth first, the
    names in a folder sorted."""
    files = listed.where("not is_dir").select("path", language(F.col("path")).alias("language"))
    return numbered(files.withColumn("_names", F.split("path", "/")), F.col("_names"), name="seq").drop("_names")


def scan(ordered: DataFrame, content: bool = True) -> DataFrame:
    """(path, language, hash, content, seq) of files (path, language, seq) on a
    disk that all executors mount; what can't be read has no hash."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, kind, seq in zip(batch["path"], batch["language"], batch["seq"], strict=True):
                try:
                    raw = Path(path).read_bytes()
                    row = (path, kind, hashlib.sha256(raw).hexdigest(), raw.decode("utf-8", "replace") if content else None, seq)
                except OSError:
                    row = (path, kind, None, None, seq)
                yield pd.DataFrame([row], columns=["path", "language", "hash", "content", "seq"])

    return ordered.mapInPandas(read, _FILES)


def containment(listed: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Repository, Folder and File nodes (id, kind, name, path, language) and
    CONTAINS edges (id, kind, src, dst); folders without source files stay."""
    path, kind = F.col("path"), F.when(F.col("is_dir"), "Folder").otherwise("File")
    id = F.concat(F.when(F.col("is_dir"), "folder:").otherwise("file:"), path)
    own = listed.sparkSession.createDataFrame([(f"repo:{root}", "Repository", os.path.basename(root), root, None)], "id string, kind string, name string, path string, language string")
    nodes = listed.select(id.alias("id"), kind.alias("kind"), F.substring_index(path, "/", -1).alias("name"), "path", F.when(~F.col("is_dir"), language(path)).alias("language"))
    up = F.when(F.col("parent") == root, F.lit(f"repo:{root}")).otherwise(F.concat(F.lit("folder:"), "parent"))
    edges = listed.select(F.concat(F.lit("CONTAINS:"), up, F.lit("->"), id).alias("id"), F.lit("CONTAINS").alias("kind"), up.alias("src"), id.alias("dst"))
    return own.unionByName(nodes), edges


# Git.


def is_git(repo: str) -> bool:
    return subprocess.run(["git", "-C", repo, "rev-parse", "--git-dir"], capture_output=True).returncode == 0


def head(repo: str) -> str | None:
    try:
        return git(repo, "rev-parse", "HEAD").strip()
    except subprocess.CalledProcessError:
        return None


def is_ancestor(repo: str, commit: str) -> bool:
    return subprocess.run(["git", "-C", repo, "merge-base", "--is-ancestor", commit, "HEAD"], capture_output=True).returncode == 0


def is_clean(repo: str) -> bool:
    return not git(repo, "status", "--porcelain", "-uall").strip()


def parse_name_status(raw: str) -> list[tuple[str, str]]:
    """(path, change) from ``diff --name-status -z``; a rename or copy deletes
    the old path and adds the new one (a copy keeps the old)."""
    out, parts = [], [p for p in raw.split("\0") if p]
    i = 0
    while i < len(parts):
        code = parts[i][0]
        if code in "RC":
            out += [(parts[i + 1], "deleted"), (parts[i + 2], "added")]
            i += 3
            continue
        out.append((parts[i + 1], {"A": "added", "D": "deleted"}.get(code, "changed")))
        i += 2
    return out


def parse_status(raw: str) -> list[tuple[str, str]]:
    """(path, change) from ``status --porcelain -uall -z``."""
    out, parts = [], [p for p in raw.split("\0") if p]
    i = 0
    while i < len(parts):
        code, path = parts[i][:2], parts[i][3:]
        if "R" in code or "C" in code:
            out += [(path, "added"), (parts[i + 1], "deleted")]
            i += 2
            continue
        out.append((path, "added" if code == "??" or "A" in code else "deleted" if "D" in code else "changed"))
        i += 1
    return out


def git_delta(spark: SparkSession, repo: str, since: str) -> DataFrame:
    """(path, change_type) of commits since one and of the work tree; paths are
    absolute.  The work tree's word counts where both speak."""
    from sparkloom.operators.incremental import merge_deltas

    schema = "path string, change_type string"
    full = lambda rows: [(os.path.join(repo, p), c) for p, c in rows]
    commits = spark.createDataFrame(full(parse_name_status(git(repo, "diff", "--name-status", "-z", f"{since}..HEAD"))), schema)
    tree = spark.createDataFrame(full(parse_status(git(repo, "status", "--porcelain", "-uall", "-z"))), schema)
    return merge_deltas(commits, tree)
