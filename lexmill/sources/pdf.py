"""The text layer of simple PDF files: text operators of plain or deflated content streams."""

from __future__ import annotations

import re
import zlib

_STREAM = re.compile(rb"<<(?P<head>(?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n(?P<body>.*?)\r?\n?endstream", re.S)
_SHOW = re.compile(rb"\((?P<text>(?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*)\)|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<op>T\*|TJ|Tj|Td|TD|ET|'|\")|-?\d+\.?\d*|\[|\]", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class BadPdf(ValueError):
    """Not a PDF file, or one whose streams cannot be read."""


def _literal(raw: bytes) -> str:
    def one(m: re.Match) -> bytes:
        c = m[1]
        return bytes([int(c, 8) & 255]) if c.isdigit() else _ESCAPES.get(c, c if c != b"\n" else b"")

    plain = re.sub(rb"\\([0-7]{1,3}|.|\n)", one, raw, flags=re.S)
    return plain.decode("utf-16-be", "replace")[1:] if plain.startswith(b"\xfe\xff") else plain.decode("latin-1")


def pdf_text(data: bytes) -> str:
    """Shown strings, a line for each text line; BadPdf if the data is no PDF, or its streams or strings cannot be read."""
    try:
        return _text(data)
    except (ValueError, UnicodeError, OverflowError, RecursionError) as e:
        raise BadPdf(str(e)) from e


def _text(data: bytes) -> str:
    if not data.startswith(b"%PDF-"):
        raise BadPdf("no PDF header")
    out: list[str] = []
    for m in _STREAM.finditer(data):
        body = m["body"]
        if b"FlateDecode" in m["head"]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error as e:
                raise BadPdf(str(e)) from e
        elif b"/Filter" in m["head"]:
            continue
        for block in re.findall(rb"\bBT\b(.*?)\bET\b", body, re.S):
            held: list[str] = []
            for t in _SHOW.finditer(block):
                if t["text"] is not None:
                    held.append(_literal(t["text"]))
                elif t["hex"] is not None:
                    digits = re.sub(rb"\s", b"", t["hex"])
                    held.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1"))
                elif t["op"] in (b"Td", b"TD", b"T*", b"'") and held:
                    out.append("".join(held))
                    held = []
            if held:
                out.append("".join(held))
    return "\n".join(out)
