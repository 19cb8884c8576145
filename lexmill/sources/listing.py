"""Files to search: directory scans, ignore rules, extensions, sizes and decoding."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.config import Config
from lexmill.functions.analyzers import extension
from lexmill.functions.globs import glob_regex

from .pdf import BadPdf, pdf_text

#: Extensions of files that are indexed.
EXTENSIONS = (
    "rs", "py", "js", "ts", "tsx", "jsx", "c", "cpp", "cc", "cxx", "h", "hpp", "hxx", "hh", "go", "java", "kt", "kts",
    "cs", "rb", "php", "swift", "zig", "md", "txt", "toml", "yaml", "yml", "json", "html", "css", "scss", "sass", "sh", "bash", "zsh",
)


def indexable(path: Column, config: Config | None = None, hidden: bool = False) -> Column:
    """The extension rule, and unless hidden is set that no component starts with a dot.

    Excluded extensions lose first; PDF counts if switched on; extra and built-in extensions count."""
    config = config or Config()
    ext = extension(path)
    known = ext.isin(*EXTENSIONS, *[e.lower() for e in config.include_extensions])
    if config.include_pdfs:
        known = known | (ext == "pdf")
    else:
        known = known & (ext != "pdf")
    if config.exclude_extensions:
        known = known & ~ext.isin(*[e.lower() for e in config.exclude_extensions])
    return known if hidden else known & ~path.rlike(r"(?:\A|/)\.")


@dataclass
class IgnoreRules:
    """Rules of ignore files: (folder, pattern, negated, folders only).  The last rule that matches decides; what lies in an ignored folder stays ignored."""

    rules: list[tuple[str, re.Pattern, bool, bool]] = field(default_factory=list)

    def add(self, folder: str, lines: Iterable[str]) -> None:
        for line in lines:
            line = line.rstrip("\n\r")
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            line = line[1:] if negated else line.removeprefix("\\")
            only_folders = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            line = line.lstrip("/")
            if line:
                self.rules.append((folder, re.compile(_ignore_regex(line, anchored)), negated, only_folders))

    def _one(self, path: str, is_folder: bool) -> bool:
        decided = False
        for folder, pattern, negated, only_folders in self.rules:
            if folder and not path.startswith(folder + "/"):
                continue
            inner = path[len(folder) + 1 :] if folder else path
            if (is_folder or not only_folders) and pattern.match(inner):
                decided = not negated
        return decided

    def decided(self, path: str, is_folder: bool) -> bool:
        """Whether a path is ignored that lies in no ignored folder."""
        return self._one(path, is_folder)

    def ignored(self, path: str) -> bool:
        parts = path.split("/")
        return any(self._one("/".join(parts[:i]), True) for i in range(1, len(parts))) or self._one(path, False)


def _ignore_regex(line: str, anchored: bool) -> str:
    out = "" if anchored else "(?:.*/)?"
    i = 0
    while i < len(line):
        if line.startswith("**/", i):
            out += "(?:.*/)?"
            i += 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out += "/.*"
            i += 3
        elif line[i] == "*":
            out += "[^/]*"
            i += 1
        elif line[i] == "?":
            out += "[^/]"
            i += 1
        elif line[i] == "[" and (end := line.find("]", i + 2)) > 0:
            inner = line[i + 1 : end].replace("\\", "\\\\")
            out += f"[{'^' + inner[1:] if inner[0] in '!^' else inner}]"
            i = end + 1
        elif line[i] == "\\" and i + 1 < len(line):
            out += re.escape(line[i + 1])
            i += 2
        else:
            out += re.escape(line[i])
            i += 1
    return out + r"\Z"


def global_ignore_lines() -> list[str]:
    """Lines of the user's own ignore file: core.excludesFile of their git configuration, else git/ignore in their configuration folder."""
    home = os.path.expanduser("~")
    folder = os.environ.get("XDG_CONFIG_HOME") or os.path.join(home, ".config")
    place = os.path.join(folder, "git/ignore")
    for name in (os.path.join(folder, "git/config"), os.path.join(home, ".gitconfig")):
        if os.path.isfile(name):
            with open(name, encoding="utf-8", errors="replace") as f:
                if found := re.search(r"(?mi)^\s*excludesfile\s*=\s*\"?([^\"\n]+?)\"?\s*$", f.read()):
                    place = os.path.expanduser(found[1])
    if not os.path.isfile(place):
        return []
    with open(place, encoding="utf-8", errors="replace") as f:
        return f.read().splitlines()


#: A folder's rules as they are handed down: (folder, lines), outermost first.
Handed = list[tuple[str, list[str]]]


def store_of(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), os.path.abspath(root.removeprefix("file:"))


class Tree:
    """Folders of one root, on any file system that Arrow knows."""

    def __init__(self, root: str):
        self.files, self.root = store_of(root)
        self.root = self.root.rstrip("/") or "/"

    def lines(self, name: str) -> list[str]:
        """Lines of a small text file; none if it is not there."""
        try:
            with self.files.open_input_stream(f"{self.root}/{name}") as f:
                return f.read().decode("utf-8", "replace").splitlines()
        except (OSError, ValueError):
            return []

    def listed(self, folder: str) -> list[fs.FileInfo]:
        """Files and folders in a folder, by name; linked folders are not followed."""
        at = f"{self.root}/{folder}" if folder else self.root
        found = self.files.get_file_info(fs.FileSelector(at))
        linked = lambda x: x.type == fs.FileType.Directory and isinstance(self.files, fs.LocalFileSystem) and os.path.islink(x.path)
        return sorted((x for x in found if not linked(x)), key=lambda x: x.base_name)

    def walked(self, folder: str, handed: Handed, last: list[str], deep: bool) -> Iterator[tuple]:
        """(path below the root, size, modified, reason) of the files in a folder, and of hidden, ignored or unreadable folders (their paths end in "/").

        deep: of all folders below as well; otherwise those are given as (path, None, None, rules to hand down)."""
        stack = [(folder, handed)]
        while stack:
            at, handed = stack.pop()
            try:
                found = self.listed(at)
            except OSError:
                yield f"{at}/", 0, None, "unreadable"
                continue
            if any(x.base_name == ".gitignore" and x.is_file for x in found):
                handed = [*handed, (at, self.lines(f"{at}/.gitignore" if at else ".gitignore"))]
            rules = IgnoreRules()
            for base, text in [*handed, ("", last)]:
                rules.add(base, text)
            for x in found:
                path, is_folder = f"{at}/{x.base_name}" if at else x.base_name, x.type == fs.FileType.Directory
                why = "hidden" if x.base_name.startswith(".") else "ignored" if rules.decided(path, is_folder) else None
                if is_folder and why is None:
                    if deep:
                        stack.append((path, handed))
                    else:
                        yield path, None, None, handed
                else:
                    yield path + "/" * is_folder, x.size or 0, x.mtime, why


_LISTED = pa.schema([("repo_rel_path", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("reason", pa.string())])
#: The driver opens folders until there are so many to hand out.
HANDED_OUT = 64


def _walker(root: str, last: list[str]):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, held = Tree(root), []
        for batch in batches:
            for row in batch.to_pylist():
                for entry in tree.walked(row["folder"], json.loads(row["handed"]), last, row["deep"]):
                    if entry[1] is not None:
                        held.append(entry)
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _LISTED, strict=True)], schema=_LISTED)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _LISTED, strict=True)], schema=_LISTED)

    return walk


def listing(spark: SparkSession, root: str, config: Config | None = None) -> DataFrame:
    """file_path, repo_rel_path, size, modified, reason of every file under root: reason is why it is not to be indexed, else null.

    Hidden and ignored folders are one row each (with a "/" at the end) and are not opened.  The driver opens folders from the
    top until there are enough to hand out; tasks list those, and walk what is below them.  Rules are those of the user's
    ignore file, the repository's exclude file, .gitignore files from the top down, and the root's own ignore file, which
    has the last word."""
    config = config or Config()
    tree = Tree(root)
    last = tree.lines(config.ignore_file)
    opened, waiting = [], [("", [("", global_ignore_lines()), ("", tree.lines(".git/info/exclude"))])]
    while waiting and len(waiting) < HANDED_OUT:
        folder, handed = waiting.pop(0)
        opened.append((folder, json.dumps(handed), False))
        waiting += [(path, down) for path, size, _, down in tree.walked(folder, handed, last, False) if size is None]
    work = opened + [(folder, json.dumps(handed), True) for folder, handed in waiting]
    given = spark.createDataFrame(work, "folder string, handed string, deep boolean").repartition(min(len(work), 4 * spark.sparkContext.defaultParallelism))
    found = given.mapInArrow(_walker(root, last), "repo_rel_path string, size long, modified timestamp, reason string")
    why = F.coalesce("reason", F.when(~F.col("repo_rel_path").endswith("/"), skip_reason(F.col("repo_rel_path"), F.col("size"), config)))
    return found.select(F.concat(F.lit(f"{tree.root}/"), "repo_rel_path").alias("file_path"), "repo_rel_path", "size", "modified", why.alias("reason"))


def _read_file(tree: Tree, path: str) -> bytes | None:
    """A file's bytes, of a PDF file its text; None if it cannot be read or is no PDF though named so."""
    try:
        with tree.files.open_input_stream(path) as f:
            data = f.read()
        return pdf_text(data).encode("utf-8", "replace") if path.lower().endswith(".pdf") else data
    except (OSError, BadPdf):
        return None


_READ = pa.schema([("file_path", pa.string()), *_LISTED, ("bytes", pa.binary())])


def _reader(root: str, most: int = 8 << 20):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, held, size = Tree(root), [], 0
        for batch in batches:
            for row in batch.to_pylist():
                data = None
                if row["reason"] is None:
                    data = _read_file(tree, row["file_path"])
                    row["reason"] = "unreadable" if data is None else None
                held.append(row | {"bytes": data})
                size += len(data or b"")
                if size >= most or len(held) >= 5000:
                    yield pa.RecordBatch.from_pylist(held, _READ)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, _READ)

    return read


def scanned(spark: SparkSession, root: str, config: Config | None = None) -> DataFrame:
    """The listing with the content of the files to be indexed: UTF-8 with bad bytes replaced, the text layer of PDF files.

    A file that cannot be read, or is no PDF though named so, is a row with the reason "unreadable".  Paths are dealt out evenly; contents are not shuffled."""
    listed = listing(spark, root, config).repartition(4 * spark.sparkContext.defaultParallelism, "file_path")
    found = listed.mapInArrow(_reader(root), "file_path string, repo_rel_path string, size long, modified timestamp, reason string, bytes binary")
    return found.select("file_path", "repo_rel_path", "size", "modified", F.make_valid_utf8(F.col("bytes").cast("string")).alias("content"), "reason")


def scan(spark: SparkSession, root: str, config: Config | None = None) -> DataFrame:
    """file_path, repo_rel_path, size, modified, content of the files under root that are to be indexed."""
    return scanned(spark, root, config).where("reason is null").drop("reason")


def _acted(root: str):
    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(root)
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                there = row["file_path"] is not None and _read_file(tree, row["file_path"]) is not None
                if there or row["known"]:
                    found.append((row["path"], "index" if there else "remove"))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["path", "action"])

    return act


def changed(listed: DataFrame, known: DataFrame, root: str | None = None) -> DataFrame:
    """path, action of what differs between a listing and the files that an index knows (repo_rel_path, size, modified): a change feed from two states of a tree.

    root: that of the listing; then files that differ are read, and those that turn out unreadable go, or are left out if the index doesn't know them.  Without it all of them count as readable."""
    now = listed.where("reason is null").select("repo_rel_path", F.struct("size", "modified").alias("now"), "file_path")
    then = known.select("repo_rel_path", F.struct("size", "modified").alias("then"))
    both = now.join(then, "repo_rel_path", "full_outer").where(~F.col("now").eqNullSafe(F.col("then")))
    if root is None:
        return both.select(F.col("repo_rel_path").alias("path"), F.when(F.col("now").isNull(), "remove").otherwise("index").alias("action"))
    rows = both.select(F.col("repo_rel_path").alias("path"), "file_path", F.col("then").isNotNull().alias("known"))
    return rows.repartition(4 * listed.sparkSession.sparkContext.defaultParallelism, "path").mapInArrow(_acted(root), "path string, action string")


def glob_files(files: DataFrame, glob: str) -> DataFrame:
    found = glob_regex(glob)
    return files.where(F.col("repo_rel_path").rlike(found) | F.regexp_extract("repo_rel_path", r"([^/]*)\z", 1).rlike(found))


def fingerprint(files: DataFrame, config: Config | None = None) -> DataFrame:
    """One row: n_files and a signature of their paths, sizes and times and of the configuration.

    Each file's hash is folded into sums, which need no order and no list of all files."""
    columns = [c for c in ("repo_rel_path", "file_path", "size", "modified") if c in files.columns]
    one, two = (F.xxhash64(F.lit(seed), *columns) for seed in (1, 2))
    wide = lambda c: F.sum(c.cast("decimal(38,0)"))
    sums = files.agg(F.count(F.lit(1)).alias("n_files"), wide(one).alias("a"), wide(two).alias("b"))
    return sums.select("n_files", F.sha2(F.concat_ws("|", F.col("n_files").cast("string"), F.coalesce("a", F.lit(0)).cast("string"), F.coalesce("b", F.lit(0)).cast("string"), F.lit(repr(config or Config()))), 256).alias("signature"))


def skip_reason(path: Column, size: Column, config: Config | None = None) -> Column:
    """Why a listed file is not indexed: hidden, extension or size; null if it is."""
    config = config or Config()
    hidden = path.rlike(r"(?:\A|/)\.")
    return F.when(hidden, "hidden").when(~indexable(path, config, hidden=True), "extension").when(size > config.max_file_size, "size")


#: Why a file is not indexed.
REASONS = ("hidden", "ignored", "extension", "size", "unreadable")


def skip_report(listed: DataFrame, config: Config | None = None, samples: int = 10) -> DataFrame:
    """reason, n, samples (the first paths, at most so many) of the files that are skipped: of a listing with reasons (repo_rel_path, reason), or of plain files (path, size)."""
    if "reason" in listed.columns:
        why = listed.select(F.col("repo_rel_path").alias("path"), "reason").where("reason is not null")
    else:
        why = listed.select("path", skip_reason(F.col("path"), F.col("size"), config).alias("reason")).where("reason is not null")
    counts = why.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    firsts = [why.where(F.col("reason") == r).orderBy("path").limit(samples) for r in REASONS]
    shown = reduce(DataFrame.unionByName, firsts).groupBy("reason").agg(F.sort_array(F.collect_list("path")).alias("samples"))
    return counts.join(shown, "reason")
