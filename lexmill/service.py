"""The searches as functions of plain values: a command line and a three-tool server call them."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import functions as F

from lexmill.config import Config
from lexmill.functions.dialect import BadPattern
from lexmill.operators import regexes, tokens
from lexmill.operators.index import Index, NoIndex
from lexmill.operators.snippets import snippets
from lexmill.operators.symbols import InvalidQuery, search_symbols
from lexmill.plans.patterns import parse_symbol_query
from lexmill.sinks import output


class Service:
    """Searches over the active generation of an index."""

    def __init__(self, index: Index, config: Config | None = None):
        self.index, self.config = index, config or Config()

    def _limit(self, limit: int | None) -> int:
        return self.config.default_limit if limit is None else limit

    def token_rows(self, pattern: str, limit: int | None = None, glob: str | None = None) -> list[dict]:
        found = tokens.search_ranked(self.index.corpus(), pattern, self._limit(limit), glob)
        return [{"path": r["file_path"]} for r in found.collect()]

    def token_count(self, pattern: str) -> int:
        return tokens.search(self.index.corpus(), pattern).count()

    def regex_files(self, pattern: str, limit: int | None = None, glob: str | None = None, ignore_case: bool = False, multiline: bool = False) -> list[str]:
        found = regexes.matching_files(self.index.corpus(), pattern, ignore_case, multiline)
        found = tokens.with_glob(found, glob).orderBy("file_path")
        limit = self._limit(limit)
        return [r["file_path"] for r in (found.limit(limit) if limit else found).collect()]

    def regex_rows(self, pattern: str, limit: int | None = None, glob: str | None = None, ignore_case: bool = False, multiline: bool = False) -> list[dict]:
        """Matching lines of up to limit files."""
        paths = self.regex_files(pattern, limit, glob, ignore_case, multiline)
        corpus = self.index.corpus()
        corpus.files = corpus.files.where(F.col("file_path").isin(paths))
        rows = regexes.matching_lines(corpus, pattern, ignore_case, multiline).orderBy("file_path", "line_number").collect()
        return [{"path": r["file_path"], "line": r["line_number"], "content": r["line_content"]} for r in rows]

    def regex_count(self, pattern: str, ignore_case: bool = False, multiline: bool = False) -> int:
        return regexes.count_files(self.index.corpus(), pattern, ignore_case, multiline).first()["n"]

    def symbol_rows(self, query: str, limit: int | None = None, glob: str | None = None, symbol_regex: str | None = None, ignore_case: bool = False, multiline: bool = False) -> list[dict]:
        files = self.index.table("files") if symbol_regex is not None else None
        found = search_symbols(self.index.symbols(), query, self._limit(limit), glob, symbol_regex, files, ignore_case, multiline)
        return [r.asDict() for r in found.collect()]

    def groups(self, paths: list[str], pattern: str, regex: bool, before: int, after: int, ignore_case: bool = False) -> dict[str, list[list[tuple[int, str, bool]]]]:
        """Each path's windows of (line number, text, is match)."""
        corpus = self.index.corpus()
        corpus.files = corpus.files.where(F.col("file_path").isin(paths))
        corpus.postings = None
        found = regexes.regex_snippets(corpus, pattern, before, after, ignore_case) if regex else snippets(corpus.files, pattern, before, after)
        out: dict[str, dict[int, list]] = {}
        for r in found.orderBy("file_path", "line_number").collect():
            out.setdefault(r["file_path"], {}).setdefault(r["grp"], []).append((r["line_number"], r["line_content"], r["is_match"]))
        return {p: list(g.values()) for p, g in out.items()}


def symbol_result(row: dict) -> dict:
    return {"path": row["repo_rel_path"], "line": row["line_start"], "kind": row["kind"], "name": row["name"], "language": row["language"], "signature": row["signature"]}


def search(service: Service, pattern: str, *, regex: bool = False, symbol_regex: str | None = None, limit: int | None = None, glob: str | None = None, ignore_case: bool = False, multiline: bool = False, count: bool = False, files_only: bool = False, no_snippets: bool = False, before: int | None = None, after: int | None = None, context: int | None = None, style: str = "default", out: TextIO = sys.stdout) -> int:
    """Runs a search and prints it; 0 if anything was found, 1 if nothing, 2 for queries that make no sense."""
    base = service.config.context_lines if context is None else context
    before, after = base if before is None else before, base if after is None else after
    say = lambda *lines: print(*lines, sep="\n", file=out)
    try:
        query = None if regex else parse_symbol_query(pattern)
        if query is not None and query.has_filters:
            rows = service.symbol_rows(pattern, limit, glob, symbol_regex, ignore_case, multiline)
            if count:
                say(len(rows))
            elif files_only:
                say(*dict.fromkeys(r["repo_rel_path"] for r in rows)) if rows else None
            elif style == "json":
                say(output.envelope(pattern, "symbol", map(symbol_result, rows)))
            elif style == "plain":
                say(*(f"{r['repo_rel_path']}:{r['line_start']}:{r['signature'] or r['name']}" for r in rows)) if rows else None
            else:
                say(*output.symbol_lines(rows, pattern))
            return int(not rows)
        if count:
            n = service.regex_count(pattern, ignore_case, multiline) if regex else service.token_count(pattern)
            say(n)
            return int(not n)
        if style == "json" and not files_only:
            rows = service.regex_rows(pattern, limit, glob, ignore_case, multiline) if regex else service.token_rows(pattern, limit, glob)
            say(output.envelope(pattern, "regex" if regex else "token", rows))
            return int(not rows)
        paths = service.regex_files(pattern, limit, glob, ignore_case, multiline) if regex else [r["path"] for r in service.token_rows(pattern, limit, glob)]
        if not paths:
            if style == "default" and not files_only:
                say(f"No results found for {'regex' if regex else 'pattern'}: {pattern}")
            return 1
        if files_only or style == "plain" and no_snippets:
            say(*paths)
            return 0
        if style == "default":
            say(f"Found {len(paths)} file(s) with matches for regex: {pattern}" if regex else f"Found {len(paths)} results for pattern: {pattern}")
            if no_snippets:
                for i, path in enumerate(paths, 1):
                    say("", f"{i}. {path}")
                return 0
        shown = service.groups(paths, pattern, regex, before, after, ignore_case)
        first = True
        for path in paths:
            groups = shown.get(path, [])
            if style == "default":
                say("", *(output.default_snippet(path, groups) if groups else [path]))
            elif groups:
                say(*output.plain_snippet(path, groups, first))
                first = False
        return 0
    except (BadPattern, InvalidQuery, NoIndex, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


#: Error codes of the protocol.
INVALID_REQUEST, NO_METHOD, INVALID_PARAMS, INTERNAL, NOT_FOUND = -32600, -32601, -32602, -32603, -32002

#: The tools: what each calls, its required argument, and its optional ones.
TOOLS: dict[str, tuple[str, str, str, tuple[str, ...]]] = {
    "search_tokens": ("token", "token_rows", "pattern", ("limit", "glob")),
    "search_regex": ("regex", "regex_rows", "pattern", ("limit", "glob", "ignore_case", "multiline")),
    "search_symbols": ("symbol", "symbol_rows", "query", ("limit", "glob", "symbol_regex", "ignore_case", "multiline")),
}
_KINDS = {"limit": "integer", "ignore_case": "boolean", "multiline": "boolean"}


class ToolError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def tool_list() -> list[dict]:
    return [{"name": n, "description": f"Search {kind}s of the indexed files", "inputSchema": {"type": "object", "required": [need], "properties": {a: {"type": _KINDS.get(a, "string")} for a in (need, *more)}}} for n, (kind, _, need, more) in TOOLS.items()]


def call_tool(service: Service, name: str, arguments: dict) -> str:
    """The JSON envelope of a tool's result."""
    if name not in TOOLS:
        raise ToolError(INVALID_PARAMS, f"unknown tool {name}")
    kind, method, need, more = TOOLS[name]
    if not isinstance(arguments.get(need), str) or not arguments[need].strip():
        raise ToolError(INVALID_PARAMS, f"{need} must be a string that is not empty")
    if unknown := set(arguments) - {need, *more}:
        raise ToolError(INVALID_PARAMS, f"unknown arguments {sorted(unknown)}")
    limit = arguments.get("limit")
    if limit is not None and (not isinstance(limit, int) or isinstance(limit, bool) or limit < 0):
        raise ToolError(INVALID_PARAMS, "limit must be a whole number from 0 on")
    run: Callable[..., list[dict]] = getattr(service, method)
    try:
        rows = run(arguments[need], **{k: v for k, v in arguments.items() if k in more and v is not None})
    except NoIndex as e:
        raise ToolError(NOT_FOUND, str(e)) from e
    except (BadPattern, InvalidQuery, ValueError) as e:
        raise ToolError(INVALID_PARAMS, str(e)) from e
    return output.envelope(arguments[need], kind, map(symbol_result, rows) if kind == "symbol" else rows)


def serve(service: Service, source: TextIO, out: TextIO) -> None:
    """JSON-RPC 2.0, a message a line."""
    for line in source:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            message = {}
        if reply := answer(service, message):
            print(json.dumps(reply, ensure_ascii=False), file=out, flush=True)


def answer(service: Service, message: dict) -> dict | None:
    """The reply to a message; none for notifications."""
    number, method = message.get("id"), message.get("method")
    try:
        if not isinstance(method, str):
            raise ToolError(INVALID_REQUEST, "not a request")
        if number is None:
            return None
        if method == "initialize":
            result: dict = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "lexmill", "version": "1"}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": tool_list()}
        elif method == "tools/call":
            params = message.get("params") or {}
            result = {"content": [{"type": "text", "text": call_tool(service, params.get("name", ""), params.get("arguments") or {})}]}
        else:
            raise ToolError(NO_METHOD, f"unknown method {method}")
        return {"jsonrpc": "2.0", "id": number, "result": result}
    except ToolError as e:
        return {"jsonrpc": "2.0", "id": number, "error": {"code": e.code, "message": str(e)}}
    except Exception as e:  # the server outlives a failed request
        return {"jsonrpc": "2.0", "id": number, "error": {"code": INTERNAL, "message": str(e)[:500]}}
