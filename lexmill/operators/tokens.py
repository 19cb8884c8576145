"""Token search: which files hold a token, tokens or a phrase; counts, and BM25 ranking.

Every search comes in two forms with the same answer: over postings, if the corpus has them, or straight over
the files, where a predicate inside each row needs no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.analyzers import body_tokens, token_runs
from lexmill.functions.globs import glob_matches
from lexmill.plans.patterns import FilePattern, Mode, Phrase, parse_file_pattern

from .corpus import Corpus

K1, B = 1.2, 0.75


def token_is(mode: Mode, text: str, token: Column | None = None, reversed_token: Column | None = None) -> Column:
    """The predicate of a mode; a suffix is a prefix of the reversed column where there is one."""
    token = F.col("token") if token is None else token
    if mode is Mode.EXACT:
        return token == text
    if mode is Mode.PREFIX:
        return token.startswith(text)
    if mode is Mode.SUFFIX:
        return reversed_token.startswith(text[::-1]) if reversed_token is not None else token.endswith(text)
    return token.contains(text)


def _may_hold(texts: Sequence[str]) -> Column:
    """A cheap test that no file with these tokens fails: it spares most files the analysis.  Sigma is left out, as its lower case depends on what follows."""
    lower = F.lower("content")
    return reduce(lambda a, b: a & b, [lower.contains(t) for t in texts if not set(t) & {"σ", "ς"}], F.lit(True))


def _one(corpus: Corpus, mode: Mode, text: str) -> DataFrame:
    if corpus.postings is None:
        return corpus.files.where(_may_hold([text]) & F.exists(body_tokens(F.col("content")), lambda t: token_is(mode, text, t))).select("file_path")
    table = corpus.reversed if mode is Mode.SUFFIX and corpus.reversed is not None else corpus.postings
    found = table.where(token_is(mode, text, reversed_token=F.col("token_rev"))).select("file_path")
    return found if mode is Mode.EXACT else found.distinct()


def exact(corpus: Corpus, token: str) -> DataFrame:
    return _one(corpus, Mode.EXACT, token.lower())


def prefix(corpus: Corpus, text: str) -> DataFrame:
    return _one(corpus, Mode.PREFIX, text.lower())


def suffix(corpus: Corpus, text: str) -> DataFrame:
    return _one(corpus, Mode.SUFFIX, text.lower())


def substring(corpus: Corpus, text: str) -> DataFrame:
    return _one(corpus, Mode.SUBSTRING, text.lower())


def all_terms(corpus: Corpus, terms: Sequence[str]) -> DataFrame:
    """Files that hold every term."""
    terms = sorted({t.lower() for t in terms})
    if not terms:
        return corpus.files.select("file_path").where(F.lit(False))
    if corpus.postings is None:
        tokens = body_tokens(F.col("content"))
        return corpus.files.where(_may_hold(terms) & (F.size(F.array_intersect(tokens, F.array(*map(F.lit, terms)))) == len(terms))).select("file_path")
    held = corpus.postings.where(F.col("token").isin(terms)).groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    return held.where(F.col("n") == len(terms)).select("file_path")


def _contains(part: str) -> Callable[[Column], Column]:
    return lambda token: token.contains(part)


def _equals(term: str) -> Callable[[Column], Column]:
    return lambda token: token == term


def all_substrings(corpus: Corpus, parts: Sequence[str]) -> DataFrame:
    """Files in which every part lies inside some token."""
    parts = sorted({p.lower() for p in parts})
    if not parts:
        return corpus.files.select("file_path").where(F.lit(False))
    if corpus.postings is None:
        tokens = body_tokens(F.col("content"))
        return corpus.files.where(reduce(lambda a, b: a & b, [F.exists(tokens, _contains(p)) for p in parts], _may_hold(parts))).select("file_path")
    some = corpus.postings.where(reduce(lambda a, b: a | b, [F.col("token").contains(p) for p in parts]))
    held = some.groupBy("file_path").agg(*[F.max(F.col("token").contains(p)).alias(f"h{i}") for i, p in enumerate(parts)])
    return held.where(reduce(lambda a, b: a & b, [F.col(f"h{i}") for i in range(len(parts))])).select("file_path")


def phrase(corpus: Corpus, terms: Sequence[tuple[int, str]] | Phrase) -> DataFrame:
    """file_path, hits: how often the terms stand at their relative positions (gaps stand for short runs)."""
    terms = list(terms.terms if isinstance(terms, Phrase) else terms)
    if len(terms) < 2:
        raise ValueError("a phrase has two terms at least")
    base = terms[0][0]
    steps = [(at - base, t.lower()) for at, t in terms]
    if corpus.postings is None:
        runs = token_runs(F.col("content"))
        found = F.transform(F.array(runs), lambda r: F.size(F.filter(F.sequence(F.lit(0), F.size(r)), lambda i: reduce(lambda a, b: a & b, [F.get(r, i + at).eqNullSafe(F.lit(t)) for at, t in steps]))))[0]
        return corpus.files.where(_may_hold([t for _, t in steps])).select("file_path", found.cast("long").alias("hits")).where("hits > 0")
    lists = corpus.postings.where(F.col("token").isin([t for _, t in steps])).groupBy("file_path").agg(F.map_from_entries(F.collect_list(F.struct("token", "positions"))).alias("at"))
    first = F.col("at")[F.lit(steps[0][1])]
    starts = reduce(lambda held, step: F.array_intersect(held, F.transform(F.col("at")[F.lit(step[1])], lambda p: p - step[0])), steps[1:], first)
    return lists.select("file_path", F.coalesce(F.size(starts), F.lit(0)).cast("long").alias("hits")).where("hits > 0")


def any_branch(corpus: Corpus, branches: Sequence[Sequence[str]]) -> DataFrame:
    """Files that hold all terms of some branch; empty branches are skipped."""
    found = [all_terms(corpus, b) for b in branches if b]
    if not found:
        return corpus.files.select("file_path").where(F.lit(False))
    return reduce(DataFrame.unionByName, found).distinct()


def search(corpus: Corpus, pattern: str | FilePattern) -> DataFrame:
    """file_path of all files that a pattern finds."""
    parsed = parse_file_pattern(pattern) if isinstance(pattern, str) else pattern
    if parsed.mode is Mode.EMPTY:
        return corpus.files.select("file_path").where(F.lit(False))
    if parsed.mode is Mode.ALL_TERMS:
        return all_terms(corpus, parsed.tokens)
    return _one(corpus, parsed.mode, parsed.tokens[0])


def count(found: DataFrame) -> DataFrame:
    """One row, n: the number of files found."""
    return found.agg(F.count(F.lit(1)).alias("n"))


def least(counts: Sequence[DataFrame]) -> DataFrame:
    """One row, n: the smallest of several counts."""
    return reduce(DataFrame.unionByName, counts).agg(F.min("n").alias("n"))


def with_glob(found: DataFrame, glob: str | None) -> DataFrame:
    return found if glob is None else found.where(glob_matches(F.col("file_path"), glob))


def index_stats(corpus: Corpus) -> DataFrame:
    """One row: n_files, n_terms (distinct), n_postings."""
    postings = corpus.with_postings().postings
    files = corpus.files.agg(F.count(F.lit(1)).alias("n_files"))
    return postings.agg(F.countDistinct("token").alias("n_terms"), F.count(F.lit(1)).alias("n_postings")).select(files.scalar().alias("n_files"), "n_terms", "n_postings")


def bm25(corpus: Corpus, terms: Sequence[str], limit: int | None = None, digits: int = 6) -> DataFrame:
    """file_path, score of the files that hold all terms, best first, ties by path; limit 0 or None: all.

    N and the mean length run over all files.  A term's document frequency is counted over its matches alone.
    These totals are a scalar subquery, not a join."""
    terms = sorted({t.lower() for t in terms})
    if corpus.postings is None:
        counted = lambda ts: F.struct(F.size(ts).cast("long").alias("dl"), *[F.size(F.filter(ts, _equals(x))).alias(f"tf{i}") for i, x in enumerate(terms)])
        # One row a file; as a generator, so that the filter below does not repeat the analysis.
        hits = corpus.files.select("file_path", "content", F.explode(F.transform(F.array(body_tokens(F.col("content"))), counted)).alias("x")).select("file_path", "content", "x.*")
        totals = [hits.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])]
    else:
        held = corpus.postings.where(F.col("token").isin(terms))
        hits = held.groupBy("file_path").agg(*[F.coalesce(F.max(F.when(F.col("token") == x, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, x in enumerate(terms)]).join(corpus.file_lengths(), "file_path")
        size = corpus.file_lengths().agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean"))
        totals = [size, held.agg(*[F.coalesce(F.sum((F.col("token") == x).cast("long")), F.lit(0)).alias(f"df{i}") for i, x in enumerate(terms)])]
    found = hits.where(_may_hold(terms)) if corpus.postings is None else hits
    found = found.where(reduce(lambda a, b: a & b, [F.col(f"tf{i}") > 0 for i in range(len(terms))], F.lit(bool(terms))))
    found = found.select("*", *[t.select(F.struct("*")).scalar().alias(f"_t{i}") for i, t in enumerate(totals)])
    total = {c: F.col(f"_t{i}")[c] for i, t in enumerate(totals) for c in t.columns}

    def part(i: int) -> Column:
        idf = F.log(1 + (total["n"] - total[f"df{i}"] + 0.5) / (total[f"df{i}"] + 0.5))
        return idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("dl") / total["mean"]))

    scored = found.select("file_path", F.round(sum((part(i) for i in range(len(terms))), F.lit(0.0)), digits).alias("score"))
    return _top(scored.orderBy(F.desc("score"), "file_path"), limit)


def _top(df: DataFrame, limit: int | None) -> DataFrame:
    return df.limit(limit) if limit else df


def phrase_ranked(corpus: Corpus, terms: Sequence[tuple[int, str]], limit: int | None = None) -> DataFrame:
    """file_path, score: the phrase's files under its terms' BM25."""
    holds = phrase(corpus, terms).select("file_path")
    scored = bm25(corpus, [t for _, t in terms]).join(holds, "file_path", "left_semi")
    return _top(scored.orderBy(F.desc("score"), "file_path"), limit)


def search_ranked(corpus: Corpus, pattern: str, limit: int | None = None, glob: str | None = None) -> DataFrame:
    """file_path, score: BM25 for whole terms, a constant 1 for patterns that expand to many terms.  The glob applies before the limit."""
    parsed = parse_file_pattern(pattern)
    if parsed.mode in (Mode.EXACT, Mode.ALL_TERMS):
        return _top(with_glob(bm25(corpus, parsed.tokens), glob).orderBy(F.desc("score"), "file_path"), limit)
    return _top(with_glob(search(corpus, parsed), glob).select("file_path", F.lit(1.0).alias("score")).orderBy("file_path"), limit)


def substrings_ranked(corpus: Corpus, parts: Sequence[str], limit: int | None = None) -> DataFrame:
    return _top(all_substrings(corpus, parts).select("file_path", F.lit(1.0).alias("score")).orderBy("file_path"), limit)


def list_all(corpus: Corpus, limit: int | None = None) -> DataFrame:
    return _top(corpus.files.select("file_path").orderBy("file_path"), limit)


def stored_text(corpus: Corpus, path: str) -> DataFrame:
    return corpus.files.where(F.col("file_path") == path).select("content")


