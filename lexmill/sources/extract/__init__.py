"""Symbols from source files of ten languages."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexmill.operators.symbols import SYMBOL_SCHEMA

from .braces import C, Cpp, CSharp, Go, Java, Rust, TypeScript, Zig
from .indents import Python, Ruby

#: Scanner of each file extension.
SCANNERS = {
    "go": Go, "rs": Rust, "py": Python, "ts": TypeScript, "tsx": TypeScript, "java": Java, "c": C, "h": C, "cpp": Cpp, "cc": Cpp, "cxx": Cpp, "hpp": Cpp, "hxx": Cpp, "hh": Cpp,
    "cs": CSharp, "rb": Ruby, "zig": Zig,
}


def scanner_for(path: str):
    name = path.rpartition("/")[2]
    return SCANNERS.get(name.rpartition(".")[2].lower()) if "." in name else None


def extract_symbols(path: str, content: str) -> list[dict]:
    """Symbol rows of one file, in source order; none for other languages."""
    scanner = scanner_for(path)
    if scanner is None or not content:
        return []
    found = scanner().symbols(content)
    ends = [i for i, c in enumerate(content) if c == "\n"]
    ascii_only = content.isascii()
    offset = (lambda i: i) if ascii_only else (lambda i: len(content[:i].encode()))
    return [
        {"kind": d.kind, "name": d.name, "qualified_name": f"{d.container}::{d.name}" if d.container else None, "language": scanner.language, "repo_rel_path": path, "container_name": d.container,
         "visibility": d.visibility, "signature": d.signature, "line_start": bisect.bisect_left(ends, d.start) + 1, "line_end": bisect.bisect_left(ends, max(d.start, d.end - 1)) + 1, "byte_start": offset(d.start), "byte_end": offset(d.end), "doc": None}
        for d in found
    ]


def _extractor(keep: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r | dict(zip(keep, kept, strict=True)) for p, c, *kept in zip(batch["repo_rel_path"], batch["content"], *(batch[k] for k in keep), strict=True) for r in extract_symbols(p, c)]
            yield pd.DataFrame(rows, columns=[*SYMBOL_SCHEMA.names, *keep]).astype({"line_start": "int32", "line_end": "int32", "byte_start": "int64", "byte_end": "int64"})

    return run


def symbols_of(files: DataFrame, *keep: str) -> DataFrame:
    """The symbol table of files (repo_rel_path, content), with further columns of each symbol's file."""
    schema = T.StructType([*SYMBOL_SCHEMA.fields, *[files.schema[k] for k in keep]])
    return files.select("repo_rel_path", "content", *keep).mapInPandas(_extractor(keep), schema)
