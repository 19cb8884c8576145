"""Settings, read from TOML files; a bad file warns and leaves the defaults."""

from __future__ import annotations

import os
import tomllib
import warnings
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    include_extensions: tuple[str, ...] = ()
    exclude_extensions: tuple[str, ...] = ()
    include_pdfs: bool = False
    max_file_size: int = 1 << 20
    idle_timeout_secs: int = 1800
    default_limit: int = 20
    context_lines: int = 2
    ignore_file: str = ".lexmillignore"


#: Where a root's settings may be, the preferred place first.
PLACES = (".lexmill/config.toml", ".lexmill.toml")


def read_config(path: str) -> Config:
    """Settings of a file; what it leaves out keeps its default, unknown keys and tables' names are passed over."""
    try:
        with open(path, "rb") as f:
            found = tomllib.load(f)
        flat = {k: v for t in found.values() if isinstance(t, dict) for k, v in t.items()} | {k: v for k, v in found.items() if not isinstance(v, dict)}
        kinds = {f.name: type(f.default) for f in fields(Config)}
        values = {}
        for k, v in flat.items():
            if k in kinds:
                v = tuple(v) if kinds[k] is tuple else v
                if type(v) is not kinds[k]:
                    raise ValueError(f"{k} has the wrong type")
                values[k] = v
        return Config(**values)
    except (OSError, ValueError) as e:
        warnings.warn(f"{path}: {e}; defaults apply", stacklevel=2)
        return Config()


def config_for(root: str) -> Config:
    for place in PLACES:
        if os.path.isfile(path := os.path.join(root, place)):
            return read_config(path)
    return Config()


def worktree_root(start: str) -> str:
    """The nearest folder upwards that holds .git, else the start."""
    at = os.path.abspath(start)
    while not os.path.exists(os.path.join(at, ".git")):
        if (up := os.path.dirname(at)) == at:
            return os.path.abspath(start)
        at = up
    return at


def repo_id(root: str) -> str:
    """A readable and distinct name of a root: its last component and a hash of its path."""
    root = os.path.abspath(root)
    slug = "".join(c if c.isalnum() or c in "-_" else "-" for c in os.path.basename(root).lower()) or "root"
    return f"{slug}-{_fnv64(root.encode()):016x}"


def _fnv64(data: bytes) -> int:
    """The 64-bit FNV-1a hash."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h
