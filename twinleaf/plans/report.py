"""Reports: rows of members in order, and JSON, HTML and console output written from them one by one."""

from __future__ import annotations

import html
import json
import os
from collections.abc import Iterator
from datetime import datetime, timezone
from itertools import chain, groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import __version__
from ..operators.basis import basis_counts, basis_groups
from ..operators.keys import among
from ..operators.storage import materialize
from .detect import Detection

GROUP = ("group_id", "clone_type", "representative_hash", "similarity_score")
MEMBER = ("fragment_id", "file_path", "language", "fragment_type", "start_line", "end_line", "token_count", "source_text")
TITLES = {1: "Type 1: exact clones", 2: "Type 2: structural clones", 3: "Type 3: near duplicates"}


def report_members(found: Detection, fragments: DataFrame, basis: Column | None = None) -> DataFrame:
    """One row per member: group_id, clone_type, representative_hash, similarity_score[, basis_internal], ord, and the member's fields[, is_basis].

    basis: whether a fragment is in the reference set; then only groups that touch it stay. No group is gathered in one row.
    """
    from ..functions.tokens import tokens

    # the texts of other fragments neither move nor are tokenised
    rows = fragments.where(among(F.col("ord"), found.members.select("ord")))
    members, head, fields = found.members.select(*GROUP, "ord"), [*GROUP], [F.col(c).alias("file" if c == "file_path" else c) for c in MEMBER]
    if basis is not None:
        rows = rows.withColumn("is_basis", basis)
        marks = materialize(rows.select("ord", "is_basis"), "marks")
        touched = basis_groups(members.join(marks, "ord")).select("group_id", "clone_type", "basis_internal")
        members, head, fields = members.join(touched, ["group_id", "clone_type"]), [*GROUP, "basis_internal"], [*fields, F.col("is_basis")]
        rows = rows.where(among(F.col("ord"), (members := materialize(members, "touching")).select("ord")))
    return members.join(rows.withColumn("token_count", F.size(tokens(F.col("source_text")))), "ord").select(*head, "ord", *fields)


def report_groups(found: Detection, fragments: DataFrame, basis: Column | None = None) -> DataFrame:
    """One row per group with its members in an array, in order: for groups that fit a row."""
    rows = report_members(found, fragments, basis)
    head = [*GROUP, *(["basis_internal"] if basis is not None else [])]
    member = F.struct("ord", *[c for c in rows.columns if c not in head and c != "ord"])
    grouped = rows.groupBy(*head).agg(F.sort_array(F.collect_list(member)).alias("members"))
    return grouped.withColumn("members", F.transform("members", lambda m: m.dropFields("ord"))).select(*GROUP, "members", *head[len(GROUP) :])


def summary(found: Detection, fragments: DataFrame, files_scanned: int) -> dict[str, int]:
    return {"files_scanned": files_scanned, "fragments_extracted": fragments.count(), **found.counts().first().asDict()}


def basis_summary(rows: DataFrame) -> dict[str, int]:
    """Groups of each type in the rows of members."""
    return basis_counts(rows.select("group_id", "clone_type").distinct()).first().asDict()


def _in_order(rows: DataFrame) -> Iterator[tuple[dict, Iterator[dict]]]:
    """(group, its members) one by one, in order; rows come a partition at a time."""
    head = [c for c in (*GROUP, "basis_internal") if c in rows.columns]
    flat = (r.asDict() for r in rows.orderBy("clone_type", "group_id", "ord").toLocalIterator())
    for _, members in groupby(flat, key=lambda r: (r["clone_type"], r["group_id"])):
        first = next(members)
        group = {c: first[c] for c in head}
        if group["similarity_score"] is None:
            del group["similarity_score"]
        else:
            group["similarity_score"] = round(group["similarity_score"], 4)
        yield group, ({c: v for c, v in r.items() if c not in head and c != "ord"} for r in chain([first], members))


def write_json(path: str, rows: DataFrame, totals: dict[str, int], session_id: str, scan_path: list[str], basis_paths: list[str] | None = None) -> str:
    """A JSON file, written member by member; returns its path."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    head = {"generated_at": datetime.now(timezone.utc).isoformat(), "version": __version__, "session_id": session_id, "scan_path": scan_path, "summary": dict(totals)}
    if basis_paths:
        head["basis_paths"] = basis_paths
        head["summary"] |= basis_summary(rows)
    indented = lambda x, by: json.dumps(x, indent=2, ensure_ascii=False).replace("\n", "\n" + " " * by)
    with open(path, "w", encoding="utf-8") as out:
        out.write(json.dumps(head, indent=2, ensure_ascii=False)[:-2] + ',\n  "clone_groups": [')
        for k, (group, members) in enumerate(_in_order(rows)):
            out.write(("," if k else "") + "\n    " + indented(group, 4)[: -len("\n    }")] + ',\n      "members": [')
            for n, m in enumerate(members):
                out.write(("," if n else "") + "\n        " + indented(m, 8))
            out.write("\n      ]\n    }")
        out.write("\n  ]\n}\n")
    return os.path.realpath(path)


_STYLE = (
    "body{font-family:sans-serif;margin:2rem}.tile{display:inline-block;padding:.6rem 1rem;margin-right:1rem;border:1px solid #ccc;border-radius:6px}"
    "details{margin:.4rem 0}pre{background:#f6f6f6;padding:.6rem;overflow:auto}.chip{background:#246;color:#fff;border-radius:4px;padding:0 .4rem;font-size:.8em}"
)
_SCRIPT = (
    "const q=document.getElementById('q');q.oninput=()=>document.querySelectorAll('details').forEach(d=>d.hidden=!d.textContent.toLowerCase().includes(q.value.toLowerCase()));"
    "document.getElementById('all').onclick=()=>document.querySelectorAll('details').forEach(d=>d.open=!d.open)"
)


def write_html(path: str, rows: DataFrame, totals: dict[str, int], session_id: str, scan_path: list[str], basis_paths: list[str] | None = None) -> str:
    """A page with a tile per count and a section per type; returns its path."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    e = html.escape
    counts = totals | (basis_summary(rows) if basis_paths else {})
    sizes = rows.groupBy("clone_type", "group_id").agg(F.count(F.lit(1)).alias("n")).orderBy("clone_type", "group_id").toLocalIterator()
    with open(path, "w", encoding="utf-8") as out:
        out.write(f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Clone report</title><style>{_STYLE}</style></head><body><h1>Clone report</h1>')
        out.write(f"<p>Session {e(session_id)}, {e(', '.join(scan_path))}, {datetime.now(timezone.utc):%Y-%m-%d %H:%M} UTC</p>")
        out.write("".join(f'<span class="tile">{e(k.replace("_", " "))}: <b>{v}</b></span>' for k, v in counts.items()))
        out.write('<p><input id="q" placeholder="Filter"> <button id="all">Expand or collapse all</button></p>')
        open_type = 0
        empty = {1: "No exact clones found.", 2: "No structural clones found.", 3: "No near duplicates found."}

        def start(up_to: int) -> None:
            nonlocal open_type
            while open_type < up_to:
                if open_type and not seen[open_type]:
                    out.write(f"<p>{empty[open_type]}</p>")
                open_type += 1
                if open_type <= 3:
                    out.write(f"<h2>{TITLES[open_type]}</h2>")

        seen = {1: 0, 2: 0, 3: 0}
        for (g, members), size in zip(_in_order(rows), sizes):
            start(g["clone_type"])
            seen[g["clone_type"]] += 1
            score = f", {g['similarity_score'] * 100:.0f}%" if "similarity_score" in g else ""
            badge = ' <span class="chip">Basis-to-Basis</span>' if g.get("basis_internal") else ""
            out.write(f"<details><summary>{e(g['group_id'])}: {size.n} members{score}{badge}</summary>")
            for m in members:
                chip = ' <span class="chip">BASIS</span>' if m.get("is_basis") else ""
                out.write(f"<p>{e(m['file'] or '')}:{m['start_line']}-{m['end_line']} ({e(m['fragment_type'])}, {e(m['language'] or '')}, {m['token_count']} tokens){chip}</p><pre>{e(m['source_text'])}</pre>")
            out.write("</details>")
        start(4)
        out.write(f"<script>{_SCRIPT}</script></body></html>")
    return os.path.realpath(path)


def write_reports(kind: str, stem: str, *args, **kwargs) -> list[str]:
    """kind: json, html or both."""
    if kind not in ("json", "html", "both"):
        raise ValueError(f"unknown format: {kind}")
    out = []
    if kind in ("json", "both"):
        out.append(write_json(f"{stem}.json", *args, **kwargs))
    if kind in ("html", "both"):
        out.append(write_html(f"{stem}.html", *args, **kwargs))
    return out


def console(totals: dict[str, int], basis: dict[str, int] | None = None) -> str:
    """The summary as lines; with a basis, `n (basis n)` for the groups."""
    lines = []
    for k, v in totals.items():
        extra = f" (basis {basis[f'basis_{k}']})" if basis and f"basis_{k}" in basis else ""
        lines.append(f"{k.replace('_', ' ')}: {v}{extra}")
    return "\n".join(lines)
