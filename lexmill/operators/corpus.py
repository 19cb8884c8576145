"""Tables that searches read.

files     file_path, content (and whatever else the source has)
postings  token, token_rev, file_path, tf, positions (array<int>, ordinals that count short runs)
lengths   file_path, dl: body tokens of each file
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.analyzers import body_tokens, token_positions


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file_path, dl, postings of each file; a file's occurrences come in order."""
    for batch in batches:
        counts = np.diff(batch.column(1).offsets.to_numpy())
        found = batch.column(1).flatten()
        words = found.field("token").dictionary_encode()
        codes, pos = words.indices.to_numpy(), found.field("pos").to_numpy()
        row = np.repeat(np.arange(batch.num_rows), counts)
        order = np.lexsort((codes, row))
        codes, row = codes[order], row[order]
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])]))
        ends = np.append(starts, len(order)).astype(np.int32)
        token = words.dictionary.take(pa.array(codes[starts]))
        made = pa.StructArray.from_arrays([token, pa.array(np.diff(ends), pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(pos[order], pa.int32()))], ["token", "tf", "positions"])
        upto = np.concatenate([[0], np.cumsum(np.bincount(row[starts], minlength=batch.num_rows))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(upto), made)], ["file_path", "dl", "postings"])


def grouped_files(files: DataFrame) -> DataFrame:
    """file_path, dl, postings (token, tf, positions): a row for each file, made in one pass without a shuffle."""
    placed = F.coalesce(token_positions(F.col("content")), F.array().cast("array<struct<token:string,pos:int>>"))
    return files.select("file_path", placed.alias("x")).mapInArrow(_group, "file_path string, dl long, postings array<struct<token:string,tf:int,positions:array<int>>>")


def postings_of(grouped: DataFrame) -> DataFrame:
    rows = grouped.select("file_path", F.explode("postings").alias("p"))
    return rows.select("p.token", F.reverse("p.token").alias("token_rev"), "file_path", "p.tf", "p.positions")


def postings_table(files: DataFrame) -> DataFrame:
    """A row for each file and token."""
    return postings_of(grouped_files(files))


def lengths_table(files: DataFrame) -> DataFrame:
    return files.select("file_path", F.size(body_tokens(F.col("content"))).cast("long").alias("dl"))


def term_table(postings: DataFrame) -> DataFrame:
    """token, df, cf."""
    return postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("cf"))


def file_terms(files: DataFrame) -> DataFrame:
    """term_table straight from files: a token's first occurrence in a file counts for df, and counts are summed ahead of the one shuffle."""
    marked = lambda s: F.transform(s, lambda t, i: F.struct(t.alias("token"), ((i == 0) | (F.get(s, i - 1) != t)).cast("long").alias("first")))
    rows = files.select(F.explode(F.transform(F.array(F.sort_array(body_tokens(F.col("content")))), marked)[0]).alias("x"))
    return rows.groupBy("x.token").agg(F.sum("x.first").alias("df"), F.count(F.lit(1)).alias("cf"))


@dataclass
class Corpus:
    """Files, and what an index holds of them.

    reversed: token, token_rev, file_path sorted by token_rev.  terms: token, df, cf, maybe in several rows a token.  n_files: how many files there are, or were at the last build."""

    files: DataFrame
    postings: DataFrame | None = None
    lengths: DataFrame | None = None
    reversed: DataFrame | None = None
    terms: DataFrame | None = None
    n_files: int | None = None

    def with_postings(self) -> Corpus:
        if self.postings is not None:
            return self
        return Corpus(self.files, postings_table(self.files), lengths_table(self.files))

    def file_lengths(self) -> DataFrame:
        return self.lengths if self.lengths is not None else lengths_table(self.files)
