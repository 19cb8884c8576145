"""Whether a regex search narrows through the index or scans all files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .patterns import Candidates

#: From this share of the files on, narrowing costs more than it saves.
BROAD_SHARE = 0.15


def branch_sizes(terms: DataFrame, needed: Candidates) -> list[int]:
    """An upper bound of each branch's files: the document frequencies of the terms with its rarest fragment, from the index's term table in one pass."""
    parts = sorted({x for b in needed.branches for x in b})
    row = terms.agg(*[F.coalesce(F.sum(F.when(F.col("token").contains(p), F.col("df"))), F.lit(0)).alias(f"n{i}") for i, p in enumerate(parts)]).first()
    sizes = dict(zip(parts, row, strict=True))
    return [min(sizes[x] for x in b) for b in needed.branches]


def prefer_scan(corpus, needed: Candidates) -> bool:
    """Whether the branches may hold too large a share of the files; without stored term counts, scan."""
    if needed.everything or corpus.terms is None or not corpus.n_files:
        return True
    return sum(branch_sizes(corpus.terms, needed)) >= BROAD_SHARE * corpus.n_files
