"""Text for people and tools: tables and reports of bounded size."""

from __future__ import annotations

import json
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RISK = {"risky": "Risky to change", "focus": "Change with focus", "safe": "Probably safe"}


def rows(df: DataFrame, limit: int = 50) -> list[dict]:
    """The first rows of an ordered, already bounded result."""
    return [r.asDict(recursive=True) for r in df.limit(limit).collect()]


def table(df: DataFrame, limit: int = 50) -> str:
    found = rows(df, limit)
    if not found:
        return "(none)"
    head = list(found[0])
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    lines += ["| " + " | ".join(_cell(r[c]) for c in head) + " |" for r in found]
    return "\n".join(lines)


def _cell(value) -> str:
    if value is None:
        return ""
    if isinstance(value, float):
        return f"{value:.4f}"
    text = ", ".join(map(str, value)) if isinstance(value, list) else str(value)
    return text.replace("\n", " ").replace("|", "\\|")[:200]


def plural(n: int, one: str, many: str | None = None) -> str:
    return f"{n} {one if n == 1 else many or one + 's'}"


def _places(found: list[dict], none: str) -> list[str]:
    return [f"- `{r['name'] or r['node']}` in {r['path'] or '?'}:{(r['start_row'] or 0) + 1}" for r in found] or [none]


def impact(found: dict) -> str:
    """The report of an impact analysis: verdict, reach, spine, tests, production
    callers by community (capped), the breakdown, and the numbers."""
    if not found["found"]:
        return "No such symbol."
    sizes = rows(found["communities"], 100)
    home, others = found["home"], [r for r in sizes if r["community"] != found["home"]]
    parts = [f"# Impact of `{found['name']}` in {found['path']}", f"## {_RISK[found['verdict']]} (risk {found['risk']:.1f})"]
    parts.append(f"{plural(found['prod_direct'], 'direct caller')}, {found['prod_indirect']} indirect, {plural(found['test_direct'] + found['test_indirect'], 'in a test', 'in tests')}.")
    parts.append("Callers are those the graph shows; calls through re-exports, factories or at run time may be missing.")
    if found["note"]:
        parts.append(found["note"])
    named = ", ".join(r["label"] for r in others[:12]) + ("" if len(others) <= 12 else f" and {len(others) - 12} more")
    parts += ["## Other communities", f"Callers stand in {plural(len(others), 'other community', 'other communities')}: {named}." if others else "All callers stand in the symbol's own community."]
    spine = rows(found["spine"], 40)
    parts += ["## Callers in the spine", "\n".join(_places(spine, "None of the direct callers is in a spine file."))]
    tests = rows(found["tests"], 60)
    parts += ["## Tests to look at", "\n".join([f"- {r['path']} ({plural(r['calls'], 'call')})" for r in tests] or ["No test calls it directly."])]
    parts.append(f"## Direct callers in production (at most {found['cap']} a community)")
    shown: dict = {}
    for r in rows(found["production"], 200):
        shown.setdefault(r["community"], []).append(r)
    for community in sorted(shown, key=lambda c: (c != home, str(c))):
        size = next((r for r in sizes if r["community"] == community), None)
        left = (size["direct"] if size else len(shown[community])) - len(shown[community])
        head = f"### {shown[community][0]['label']}" + (" (its own)" if community == home else "")
        parts.append("\n".join([head, *_places(shown[community], ""), *([f"- and {left} more here"] if left > 0 else [])]))
    if not shown:
        parts.append("None.")
    if others:
        lines = [f"- {r['label']}: {plural(r['callers'], 'caller')}" + (" (its own)" if r["community"] == home else "") for r in sizes]
        bare = [r["community"] for r in sizes if r["label"].startswith("community-") and r["community"] is not None]
        if bare:
            lines += ["", f"To do: give {plural(len(bare), 'community', 'communities')} a label with `label_community`: {', '.join(bare)}."]
        parts += ["## By community", "\n".join(lines)]
    numbers = [
        f"- in a spine file itself: {'yes' if found['is_core'] else 'no'}",
        f"- direct callers: {found['prod_direct'] + found['test_direct']} ({found['prod_direct']} production, {found['test_direct']} test)",
        f"- further callers within {found['depth']} steps: {found['prod_indirect'] + found['test_indirect']} ({found['prod_indirect']} production, {found['test_indirect']} test)",
        "- callers through interfaces: not known",
        f"- risk score: {found['risk']:.1f}",
    ]
    return "\n\n".join([*parts, "## Numbers", "\n".join(numbers)])


def overview(parts: dict[str, DataFrame]) -> str:
    return "\n\n".join(f"## {name.capitalize()}\n\n{table(df)}" for name, df in parts.items())


def wiki(parts: dict[str, DataFrame]) -> str:
    """The wiki's text.  Lists were capped where they were made: five spine files
    and functions and eight outside packages a community, twenty entry points."""
    found = {name: rows(df, 500) for name, df in parts.items() if name not in ("orphans", "tests")}
    out = ["# Wiki"]
    for r in found["repository"]:
        out.append(f"{r['name']} at {r['path']}" + (f", commit {r['last_commit'][:12]}" if r["last_commit"] else ""))
    for name in ("kinds", "languages"):
        out.append(f"{name.capitalize()}: " + ", ".join(f"{r[next(iter(r))]} {r['n']}" for r in found[name]))
    title = {r["community"]: r["label"] or r["guess"] or f"community-{r['community']}" for r in found["communities"]}
    own = {name: {c: [r for r in found[name] if r["community"] == c] for c in title} for name in ("spine", "functions", "externals")}
    for r in found["communities"]:
        c = r["community"]
        lines = [f"## {title[c]} ({plural(r['size'], 'file')})"]
        lines.append(r["description"] or "Purpose: to be written.")
        if r["stale"]:
            lines.append(f"The label is {plural(r['age_days'], 'day')} old and may not fit any more.")
        lines += ["", "Spine files:", *([f"- `{s['name']}` in {s['path']}" for s in own["spine"][c]] or ["- none"])]
        lines += ["", "Most called functions:", *([f"- `{f['signature'] or f['name']}` in {f['path']} ({plural(f['callers'], 'caller')})" for f in own["functions"][c]] or ["- none is called from the code itself"])]
        into, from_ = ([title.get(x[k], f"community-{x[k]}") for x in found["cross"] if x[o] == c] for k, o in (("dst_community", "src_community"), ("src_community", "dst_community")))
        lines += ["", f"Imports from: {', '.join(into) or 'itself alone'}", f"Imported by: {', '.join(from_) or 'none'}"]
        if own["externals"][c]:
            lines.append("Outside packages: " + ", ".join(f"`{x['symbol']}` ({x['n']})" for x in own["externals"][c]))
        out.append("\n".join(lines))
    for head, name, line in (
        ("Routes", "routes", lambda r: f"- {r['http_method']} {r['route'] or '?'}: `{r['name']}` in {r['path']}"),
        ("Entry points", "entries", lambda r: f"- {r['path']}"),
        ("Tests", "test_frameworks", lambda r: f"- {r['test_framework']}: {plural(r['n'], 'file')}"),
        ("Glossary", "glossary", lambda r: f"- `{r['name']}` ({plural(r['callers'], 'caller')})"),
    ):
        out.append(f"## {head}\n" + ("\n".join(map(line, found[name][:100])) or "none"))
    bare = [str(r["community"]) for r in found["communities"] if not r["label"]]
    for r in found["coverage"]:
        lines = ["## Coverage", f"{r['clustered']} of {r['total']} files are in a community, {r['orphans']} are not."]
        if bare:
            lines.append(f"Without a label: {', '.join(bare[:12])}" + (f" and {len(bare) - 12} more" if len(bare) > 12 else ""))
        out.append("\n".join(lines))
    return "\n\n".join(out)


def as_json(df: DataFrame, limit: int = 50) -> str:
    return json.dumps(rows(df, limit), default=str)


def document(tables: dict[str, DataFrame], out: TextIO, pretty: bool = False) -> None:
    """Whole tables as one JSON document, a partition at a time on the driver:
    rows are sorted by id, and what is null is left out."""
    row, line = ("    ", "\n") if pretty else ("", "")
    out.write("{" + line)
    for k, (name, df) in enumerate(tables.items()):
        out.write(("," + line if k else "") + ("  " if pretty else "") + json.dumps(name) + (": [" if pretty else ":[") + line)
        text = df.orderBy("id").select(F.to_json(F.struct("*")).alias("row"))
        for i, r in enumerate(text.toLocalIterator()):
            shown = json.dumps(json.loads(r["row"]), indent=2, ensure_ascii=False).replace("\n", "\n    ") if pretty else r["row"]
            out.write(("," + line if i else "") + row + shown)
        out.write(line + ("  ]" if pretty else "]"))
    out.write(line + "}\n")
