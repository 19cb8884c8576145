"""The planted benchmark corpus, benchmark profiles and tasks, and regression gates."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .patterns import Mode, parse_file_pattern

DIRS, FILES, LINES = 50, 20, 100
#: Line, source text, and how many files of each hundred hold it.
PLANTED = (
    (50, "fn initialize_connection() { let status = ready; }", 10),
    (51, "fn connect_database() { let pool = active; }", 5),
    (52, "fn handle_request() { let response = ok; }", 20),
)


def planted_corpus(spark: SparkSession) -> DataFrame:
    """file_path, content of 50 directories of 20 files of 100 lines."""
    flat = F.col("id")
    line = F.col("line")
    text = F.concat(F.lit("fn func_"), (flat % FILES).cast("string"), F.lit("_"), line.cast("string"), F.lit("() { let x = "), line.cast("string"), F.lit("; }"))
    for at, planted, share in PLANTED:
        text = F.when((line == at) & (flat % 100 < share), F.lit(planted)).otherwise(text)
    path = F.format_string("dir_%02d/file_%02d.rs", F.floor(flat / FILES), flat % FILES)
    rows = spark.range(DIRS * FILES).select("id", F.explode(F.sequence(F.lit(0), F.lit(LINES - 1))).alias("line")).select(path.alias("file_path"), "line", text.alias("t"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n")
    return rows.groupBy("file_path").agg(F.concat(joined, F.lit("\n")).alias("content"))


@dataclass
class Profile:
    key: str
    description: str = ""
    repo_names: list[str] = field(default_factory=list)
    repo_origin_substrings: list[str] = field(default_factory=list)
    default_repo_relpath: str | None = None
    min_tracked_files: int | None = None
    max_tracked_files: int | None = None
    lexical_queries: list[str] = field(default_factory=list)
    symbol_queries: list[str] = field(default_factory=list)
    symbol_regex_queries: list[dict] = field(default_factory=list)
    regex_queries: list[str] = field(default_factory=list)
    incremental_candidates: list[str] = field(default_factory=list)

    def fits(self, tracked_files: int) -> bool:
        return (self.min_tracked_files or 0) <= tracked_files <= (self.max_tracked_files if self.max_tracked_files is not None else tracked_files)


def load_profiles(path: str | Path) -> list[Profile]:
    """Profiles of a JSON file; ValueError if a key repeats, a profile has no queries, or a refinement is incomplete."""
    data = json.loads(Path(path).read_text())
    known = Profile.__dataclass_fields__
    profiles = [Profile(**{k: v for k, v in p.items() if k in known}) for p in data["profiles"]]
    if len({p.key for p in profiles}) < len(profiles):
        raise ValueError("profile keys repeat")
    for p in profiles:
        if not (p.lexical_queries or p.symbol_queries):
            raise ValueError(f"profile {p.key} has no queries")
        if any(not q.get("symbol") or not q.get("regex") for q in p.symbol_regex_queries):
            raise ValueError(f"profile {p.key}: a refinement needs a symbol query and a regex")
    return profiles


def load_tasks(path: str | Path) -> list[dict]:
    """Tasks of a JSON file, with "symbol_queries" and "lexical_queries" whatever the engine prefix of their names."""
    out = []
    for task in json.loads(Path(path).read_text())["tasks"]:
        row = {k: task[k] for k in ("id", "repo", "prompt", "expected_paths")}
        for kind in ("symbol_queries", "lexical_queries", "regex_queries"):
            row[kind] = [q for k, v in task.items() if k.endswith(kind) for q in v]
        if not row["expected_paths"]:
            raise ValueError(f"task {row['id']} expects no paths")
        out.append(row)
    return out


def grep_pattern(query: str) -> str:
    """The extended regular expression that finds a token pattern's tokens in raw text, case apart."""
    parsed = parse_file_pattern(query)
    token = parsed.tokens[0] if parsed.tokens else ""
    before, after = r"(^|[^[:alnum:]_])", r"($|[^[:alnum:]_])"
    return {Mode.EXACT: f"{before}{token}{after}", Mode.PREFIX: f"{before}{token}", Mode.SUFFIX: f"{token}{after}"}.get(parsed.mode, token)


def plan_metrics(results: list[list[str]], expected: list[str]) -> dict:
    """Of a task's queries in turn, with the paths that each found: whether an expected path came up, at which query, and after how many candidates."""
    seen = 0
    for i, paths in enumerate(results):
        for path in paths:
            seen += 1
            if path in expected:
                return {"success": True, "first_hit_query": i + 1, "candidates": seen}
    return {"success": False, "first_hit_query": None, "candidates": seen}


FAIL_RATIO, WARN_RATIO = 2.0, 1.5


def regressions(current: DataFrame, baseline: DataFrame, fail: float = FAIL_RATIO, warn: float = WARN_RATIO) -> DataFrame:
    """query, p50, base_p50, ratio, status (fail, warn or ok) of the queries that both have."""
    base = baseline.select("query", F.col("p50").alias("base_p50"))
    ratio = F.col("p50") / F.col("base_p50")
    status = F.when(F.col("ratio") > fail, "fail").when(F.col("ratio") > warn, "warn").otherwise("ok")
    return current.join(base, "query").withColumn("ratio", ratio).withColumn("status", status)


def latency_stats(runs: DataFrame) -> DataFrame:
    """query, avg, p50, p95, p99 of runs (query, ms), interpolated."""
    p = F.percentile("ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return runs.groupBy("query").agg(F.avg("ms").alias("avg"), p.alias("p")).select("query", "avg", *[F.col("p")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))])
