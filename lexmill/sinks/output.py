"""Results as JSON, as plain lines for tools, and as text for people."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def json_rows(found: DataFrame) -> DataFrame:
    """One JSON object a row, in the order path, line, content; nulls are left out."""
    return found.select(F.to_json(F.struct(F.col("file_path").alias("path"), F.col("line_number").alias("line"), F.col("line_content").alias("content"))).alias("line"))


def json_envelope(found: DataFrame, pattern: str, kind: str, path: str = "file_path") -> DataFrame:
    """One row: the envelope of a result that has a limit, paths in order."""
    paths = F.sort_array(F.collect_list(F.struct(F.col(path).alias("path"))))
    row = found.agg(F.count(F.lit(1)).alias("count"), paths.alias("results"))
    return row.select(F.to_json(F.struct(F.lit(pattern).alias("pattern"), F.lit(kind).alias("type"), "count", "results")).alias("line"))


def plain_lines(snippets: DataFrame) -> DataFrame:
    """file_path, line_number, line: "path:line:text" for matches, "path-line-text" for context, "--" ahead of every later group."""
    sep = F.when(F.col("is_match"), F.lit(":")).otherwise(F.lit("-"))
    text = F.concat("file_path", sep, F.col("line_number").cast("string"), sep, "line_content")
    by_file = Window.partitionBy("file_path").orderBy("line_number")
    first = (F.col("grp") > 1) & (F.lag("grp").over(by_file) != F.col("grp"))
    marked = snippets.withColumn("first", first)
    rows = marked.withColumn("line", F.explode(F.when(F.col("first"), F.array(F.lit("--"), text)).otherwise(F.array(text))))
    return rows.select("file_path", "line_number", "line")


def envelope(pattern: str, kind: str, results: Iterable[dict]) -> str:
    rows = [{k: v for k, v in r.items() if v is not None} for r in results]
    return json.dumps({"pattern": pattern, "type": kind, "count": len(rows), "results": rows}, ensure_ascii=False, separators=(",", ":"))


def default_snippet(path: str, groups: list[list[tuple[int, str, bool]]]) -> list[str]:
    """A file's heading, its windows with line numbers, and "..." between them."""
    width = max((len(str(n)) for g in groups for n, _, _ in g), default=1)
    out = [path]
    for i, group in enumerate(groups):
        if i:
            out.append("  ...")
        out += [f"  {n:>{width}} | {text}" for n, text, _ in group]
    return out


def plain_snippet(path: str, groups: list[list[tuple[int, str, bool]]], first: bool) -> list[str]:
    out = []
    for i, group in enumerate(groups):
        if i or not first:
            out.append("--")
        out += [f"{path}{':' if m else '-'}{n}{':' if m else '-'}{text}" for n, text, m in group]
    return out


def symbol_lines(rows: list[dict], pattern: str) -> list[str]:
    if not rows:
        return [f"No symbols found for: {pattern}"]
    out = [f"Found {len(rows)} symbols for: {pattern}"]
    for i, r in enumerate(rows, 1):
        out += ["", f"{i}. {r['name']} ({r['kind']})", f"   {r['repo_rel_path']}:{r['line_start']}  lang:{r['language']}"]
        if r.get("signature"):
            out.append(f"   {r['signature'].replace(chr(10), ' ').strip()}")
    return out


def format_bytes(n: int) -> str:
    size = float(n)
    for unit in ("B", "KB", "MB", "GB"):
        if size < 1024:
            return f"{int(size)} B" if unit == "B" else f"{size:.1f} {unit}"
        size /= 1024
    return f"{size:.1f} TB"


def format_ago(then_ns: int, now_ns: int | None = None) -> str:
    """How long ago a time was, in its largest unit."""
    seconds = max(0, ((time.time_ns() if now_ns is None else now_ns) - then_ns) // 10**9)
    for size, unit in ((86_400, "d"), (3600, "h"), (60, "m")):
        if seconds >= size:
            return f"{seconds // size}{unit} ago"
    return f"{seconds}s ago"


def status_lines(status: dict) -> list[str]:
    """An index's status for people."""
    if status["active"] is None:
        return [f"{status.get('repo', 'index')}: no index"]
    state = "needs a rebuild" if status["needs_rebuild"] else "ready"
    return [f"{status.get('repo', 'index')}: {state}", f"Files:    {status['n_files']}", f"Segments: {len(status['segments'])}", f"Size:     {format_bytes(status['bytes'])}", f"Built:    {format_ago(status['built_ns'])}"]


def format_duration(seconds: int) -> str:
    hours, rest = divmod(int(seconds), 3600)
    minutes, secs = divmod(rest, 60)
    return f"{hours}h {minutes}m" if hours else f"{minutes}m {secs}s" if minutes else f"{secs}s"
