"""Quality rules: fixed rules on word statistics, then robust multivariate outliers.

A word is a maximal run of characters other than space and \\t..\\r.  The base rules reject texts of under 50
words and texts of which more than half the words lie in repeated 3-word windows.  The others are judged
against their language and source: of each such group the minimum covariance determinant of four transformed
statistics is estimated, and a text whose squared Mahalanobis distance exceeds CUTOFF is rejected.

Statistics: x0 = log mean word length; x1, x2, x3 = roots of symbols a word, repeated lines a line and repeated
words a word.  Counts are taken to vary like Poisson counts, so a statistic of a text of n words and l lines has
a noise variance of 1 / characters, 1 / 4n, 1 / 4l and 1 / 4l (repeated words come by the line).

Estimate.  Statistics are rounded to 1/GRID and a group's vectors are counted, so that all sums are sums of integers:
the estimate is the same however the rows are partitioned, and a hot group is as small as its distinct cells.
Medians are exact on the grid (counts of distinct values).  Four deterministic starts (median absolute
deviations; trimmed; bounded by tanh; plain covariance) take STEPS concentration steps each: location and scatter
of the half of the group nearest to the last estimate, ties of a distance class (1/64 of a logarithm) included.
Each scatter is made consistent with a normal law (RAW_FACTOR for the half-sample), and the noise of a text of the
group's median size is added, which is the resolution of the statistics: without it a statistic that is constant
in clean text would reject the first text that differs.  The start that ends with the smallest determinant wins;
location and scatter are then estimated once more from all vectors within the 97.5 % point of the chi-square law
(with REWEIGHTED_FACTOR).

Distance.  The final scatter plus the noise of the text's own size (of the group's median size, if the text is
longer).  CUTOFF is the 99.9 % point of the chi-square law with four degrees.  In groups whose four statistics
all vary the median distance is about 3.36; where clean text has no symbols and no repetition it is lower, as
constant statistics add nothing to it.

Groups of under LEAST_GROUP texts that pass the base rules are judged with their language's pool of such
groups, and pools that small by an estimate over all of the language; languages that small reject nothing.

All of it is DataFrame expressions: statistics are array functions inside each row, and only one row a group is
joined back.  Null texts, empty texts and blank texts have no words, fail the base rules, and enter no estimate.
A null lang or source is a group of its own.  Rows that repeat an id are judged apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .skew import few, salted_join

LEAST_WORDS = 50
REPEAT_PERCENT = 50
#: The half-sample of a minimum covariance determinant: the estimate holds while under half of a group is broken.
SHARE = 0.5
STEPS = 5
#: Points of the chi-square law with four degrees of freedom: 99.9 % and 97.5 %.
CUTOFF = 18.4668
REWEIGHTED_WITHIN = 11.1433
#: Share over the chi-square law with six degrees at the four degrees' point: 0.5 / F6(3.3567) and 0.975 / F6(11.1433).
RAW_FACTOR = 2.1094
REWEIGHTED_FACTOR = 1.0645
LEAST_GROUP = 40
#: Steps to a unit of a statistic; the estimate (not the distance) takes statistics beyond GRID_MOST steps as that many.
GRID = 256
GRID_MOST = 8191
#: Distance classes to a unit of the natural logarithm.
CLASSES = 64
TRIM = 2.0
#: Most groups whose estimates are broadcast (about 300 bytes each); more are joined by a salted shuffle.
MOST_BROADCAST = 100_000
D = 4

SPACES = " \t\n\x0b\x0c\r"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def _drop(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: windows are sorted by a 64-bit hash and compared with their neighbours."""
    windows = F.when(F.size(words) >= 3, F.transform(F.slice(words, 1, F.size(words) - 2), lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2))))

    def twice(found: Column) -> Column:
        placed = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(placed, lambda p: _covered(F.sort_array(F.filter(F.transform(p, lambda x, j: F.when((x["h"] == F.get(p, j - 1)["h"]) | (x["h"] == F.get(p, j + 1)["h"]), x["i"])), lambda i: i.isNotNull()))))

    return _let(windows, lambda t: F.when(t.isNull() | (F.size(F.array_distinct(t)) == F.size(t)), F.lit(0)).otherwise(twice(t)))


def _covered(starts: Column) -> Column:
    return _let(starts, lambda s: F.aggregate(F.transform(s, lambda x, j: F.least(F.lit(3), x - F.coalesce(F.get(s, j - 1), F.lit(-3)))), F.lit(0), lambda a, b: a + b))


def statistics(text: Column) -> dict[str, Column]:
    """Columns words (array) and lines (array) to be projected first, then the statistics on them."""
    text = F.coalesce(text, F.lit(""))
    return {
        "words": F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""),
        "lines": F.filter(F.split(text, "\n"), lambda x: _drop(x, SPACES) != ""),
        "word_chars": F.length(_drop(text, SPACES)).cast("long"),
        "n_symbols": (F.length(text) - F.length(_drop(text, "#*$%&|<>"))).cast("long"),
    }


def text_statistics(docs: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """keep, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    first = docs.select(*keep, *[c.alias(n) for n, c in statistics(F.col(text_col)).items()])
    names = [c for c in first.columns if c not in ("words", "lines")]
    return first.select(
        *names, F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _let(F.col("words"), _repeated).cast("long").alias("n_repeat_words"),
    )


def _features() -> list[Column]:
    per = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), per("n_symbols", "n_words"), per("n_dup_lines", "n_lines"), per("n_repeat_words", "n_words")]


def _minus(of: str, terms: list[str]) -> str:
    return " - ".join([of, *terms])


def _factor(noise: list[str]) -> list[str]:
    """SQL of l00, l10, ..: the Cholesky factor of the scatter v00.. plus the noise, each in terms of those before."""
    out = []
    for j in range(D):
        own = _minus(f"v{j}{j} + {noise[j]}", [f"l{j}{k} * l{j}{k}" for k in range(j)])
        out.append(f"sqrt(greatest({own}, 1e-12D)) as l{j}{j}")
        out += [f"({_minus(f'v{i}{j}', [f'l{i}{k} * l{j}{k}' for k in range(j)])}) / l{j}{j} as l{i}{j}" for i in range(j + 1, D)]
    return out


def _inverse() -> list[str]:
    """SQL of p00, p10, ..: the inverse of the factor, so that a distance is one sum of squares; and of its determinant."""
    out = []
    for j in range(D):
        out.append(f"1D / l{j}{j} as p{j}{j}")
        out += [f"-({' + '.join(f'l{i}{k} * p{k}{j}' for k in range(j, i))}) / l{i}{i} as p{i}{j}" for i in range(j + 1, D)]
    return [*out, f"{' * '.join(f'l{i}{i}' for i in range(D))} as size"]


def _distance(x: list[str]) -> str:
    """SQL of the squared Mahalanobis distance of x from m0.. under the inverse factor p00.. ."""
    solved = [" + ".join(f"p{i}{k} * (({x[k]}) - m{k})" for k in range(i + 1)) for i in range(D)]
    return " + ".join(f"pow({y}, 2)" for y in solved)


_PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
_SPARE = [f"{a}{i}{j}" for a in "vl" for i, j in _PAIRS]


def _noise(chars: str, words: str, lines: str) -> list[str]:
    """SQL of e0..: variances of the four statistics of a text of that size, from those of Poisson counts."""
    return [f"1D / greatest({chars}, 1D) as e0", f"0.25D / greatest({words}, 1L) as e1", f"0.25D / greatest({lines}, 1L) as e2", f"0.25D / greatest({lines}, 1L) as e3"]


def _median(counts: DataFrame, keys: list[str], value: str, share: float = 0.5) -> DataFrame:
    """keys, value: the least value up to which at least that share of the weight w of its keys lies; exact."""
    upto = F.sum("w").over(Window.partitionBy(*keys).orderBy(value))
    total = F.sum("w").over(Window.partitionBy(*keys))
    ranked = counts.groupBy(*keys, value).agg(F.sum("w").alias("w")).withColumn("_upto", upto).withColumn("_need", F.greatest(F.ceil(total * share), F.lit(1)))
    return ranked.where((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("w") < F.col("_need"))).select(*keys, value)


def _moments(cells: DataFrame, keys: list[str], z: list[str], unit: float, back: list[str], factor: float = 1.0) -> DataFrame:
    """keys, m0.., v00..: location and scatter (times factor) of the cells' vectors back + z / unit, z integers with weight w."""
    sums = [F.expr(f"sum(w * ({z[i]})) as s{i}") for i in range(D)] + [F.expr(f"sum(w * ({z[i]}) * ({z[j]})) as s{i}{j}") for i, j in _PAIRS]
    out = cells.groupBy(*keys).agg(F.sum("w").alias("n"), *sums, *[F.expr(f"first({back[i]}) as b{i}") for i in range(D)])
    location = [f"b{i} + s{i} / n / {unit}D as m{i}" for i in range(D)]
    return out.selectExpr(*keys, *location, *[f"{factor}D * (s{i}{j} / n - (s{i} / n) * (s{j} / n)) / {unit * unit}D as v{i}{j}" for i, j in _PAIRS])


_NOISE = [f"e{i}" for i in range(D)]
_ON_GRID = [f"q{i} / {GRID}D" for i in range(D)]


def _grid(x: Column) -> Column:
    return F.least(x * GRID, F.lit(float(GRID_MOST))).cast("long")


def estimates(scratch: Scratch, cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per grp: location m0.., scatter v00.., and n_words, n_lines, the medians.

    cells: grp, q0.. (statistics on the grid), w (how many texts).  sizes: grp, dim ("n_words" or "n_lines"), value, w."""
    values = cells.select("grp", "w", F.explode(F.array(*[F.struct(F.lit(f"c{i}").alias("dim"), F.col(f"q{i}").alias("value")) for i in range(D)])).alias("x")).select("grp", "x.dim", "x.value", "w")
    values = scratch.save(values.groupBy("grp", "dim", "value").agg(F.sum("w").alias("w")), "values")
    wide = lambda found, names: found.groupBy("grp").agg(*[F.max(F.when(F.col("dim") == n, F.col("value"))).alias(a) for n, a in names])
    coordinates = [(f"c{i}", f"c{i}") for i in range(D)]
    middles = scratch.save(_median(values, ["grp", "dim"], "value").unionByName(_median(sizes, ["grp", "dim"], "value")), "middles")
    away = values.join(middles.withColumnRenamed("value", "middle"), ["grp", "dim"]).select("grp", "dim", F.abs(F.col("value") - F.col("middle")).alias("value"), "w")
    spreads = wide(_median(away, ["grp", "dim"], "value"), [(c, c.replace("c", "a")) for c, _ in coordinates])
    base = wide(middles, [*coordinates, ("n_words", "n_words"), ("n_lines", "n_lines")]).join(spreads, "grp")
    #: A statistic's scale: the median absolute deviation as a normal law's standard deviation, but no less than the noise.
    scales = [f"greatest(1.4826D * a{i} / {GRID}, sqrt(e{i})) as d{i}" for i in range(D)]
    base = scratch.save(base.selectExpr("*", *_noise(f"n_words * exp(c0 / {GRID})", "n_words", "n_lines"), *scales), "base")
    shown = [f"{a}{i}" for a in "ced" for i in range(D)]
    few = _few(base)
    with_groups = lambda table: cells.join(F.broadcast(table) if few else table, "grp")
    joined = with_groups(base.select("grp", *shown))

    away, middle = [f"q{i} - c{i}" for i in range(D)], [f"c{i} / {GRID}D" for i in range(D)]
    inside = " and ".join(f"abs(q{i} - c{i}) <= {TRIM * GRID}D * d{i}" for i in range(D))
    #: tanh in steps of 1/4096 of a scale, so that its sums are sums of integers too.
    bounded = [f"cast(round(4096 * tanh((q{i} - c{i}) / ({GRID} * d{i}))) as long)" for i in range(D)]
    bound = _moments(joined, ["grp"], bounded, 4096.0, ["0D"] * D).join(base.select("grp", *shown), "grp")
    bound = bound.selectExpr("grp", *[f"{middle[i]} + m{i} * d{i} as m{i}" for i in range(D)], *[f"v{i}{j} * d{i} * d{j} as v{i}{j}" for i, j in _PAIRS])
    diagonal = base.selectExpr("grp", *[f"{middle[i]} as m{i}" for i in range(D)], *[f"{f'd{i} * d{i}' if i == j else '0D'} as v{i}{j}" for i, j in _PAIRS])
    starts = [diagonal, _moments(joined.where(inside), ["grp"], away, GRID, middle), bound, _moments(joined, ["grp"], away, GRID, middle)]
    fitted = starts[0].withColumn("start", F.lit(0))
    for number, start in enumerate(starts[1:], 1):
        fitted = fitted.unionByName(start.withColumn("start", F.lit(number)))
    keys = ["grp", "start"]
    fixed = base.select("grp", *[f"{a}{i}" for a in "ce" for i in range(D)])
    fitted = scratch.save(fitted.join(fixed, "grp").selectExpr("*", *_factor(_NOISE), *_inverse()).drop(*_SPARE), "starts")
    for _ in range(STEPS):
        placed = with_groups(fitted).withColumn("class", F.expr(f"floor({CLASSES} * ln({_distance(_ON_GRID)} + 1e-9D))"))
        bound = _median(placed, keys, "class", SHARE).withColumnRenamed("class", "most")
        near = placed.join(F.broadcast(bound) if few else bound, keys).where(F.col("class") <= F.col("most"))
        found = _moments(near, keys, away, GRID, middle, RAW_FACTOR)
        fitted = scratch.save(found.join(fixed, "grp").selectExpr("*", *_factor(_NOISE), *_inverse()).drop(*_SPARE), "fitted")
    best = fitted.groupBy("grp").agg(F.min(F.struct("size", "start")).alias("best")).select("grp", F.col("best.start").alias("start"))
    raw = scratch.save(fitted.join(best, keys).drop("start"), "raw")
    near = with_groups(raw).where(f"{_distance(_ON_GRID)} <= {REWEIGHTED_WITHIN}D")
    return scratch.save(_moments(near, ["grp"], away, GRID, middle, REWEIGHTED_FACTOR).join(base.select("grp", "n_words", "n_lines"), "grp"), "estimates")


def _few(table: DataFrame) -> bool:
    return few(table, MOST_BROADCAST)


def _judged(docs: DataFrame, kept: Column, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """Column "row" (kept), the statistics, base_failed, distance and kept, a row for each row of docs."""
    scratch = Scratch(docs.sparkSession, "quality")
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    stats = text_statistics(docs, text_col, kept.alias("row"), part(lang_col).alias("lang"), part(source_col).alias("source"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed).withColumns({f"x{i}": F.round(x * GRID) / GRID for i, x in enumerate(_features())})
    stats = scratch.save(stats, "statistics")

    passed = stats.where("not base_failed")
    where = ["lang", "source"]
    cells = scratch.save(passed.groupBy(*where, *[_grid(F.col(f"x{i}")).alias(f"q{i}") for i in range(D)]).agg(F.count(F.lit(1)).alias("w")), "cells")
    size = lambda name: F.struct(F.lit(name).alias("dim"), F.col(name).alias("value"))
    sizes = passed.select(*where, F.explode(F.array(size("n_words"), size("n_lines"))).alias("x")).groupBy(*where, "x.dim", "x.value").agg(F.count(F.lit(1)).alias("w"))
    sizes = scratch.save(sizes, "sizes")

    own = scratch.save(cells.groupBy(*where).agg(F.sum("w").alias("n")), "groups")
    small = F.col("n") < LEAST_GROUP
    langs = own.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.sum(F.when(small, F.col("n"))).alias("n_pool"))
    #: Null unless the language has a pool that is too small, and enough rows.
    whole = F.when((F.col("n_pool") < LEAST_GROUP) & (F.col("n_lang") >= LEAST_GROUP), F.to_json(F.struct("lang", F.lit(True).alias("whole"))))
    grp = F.when(~small, F.to_json(F.struct("lang", "source"))).when(F.col("n_pool") >= LEAST_GROUP, F.to_json(F.struct("lang"))).otherwise(whole)
    groups = scratch.save(own.join(langs, "lang").select("lang", "source", grp.alias("grp"), whole.alias("whole")), "judged")
    fed = scratch.save(groups.select("lang", "source", F.explode(F.array_distinct(F.array_compact(F.array("grp", "whole")))).alias("grp")), "fed")
    fed = F.broadcast(fed) if _few(fed) else fed
    merged = cells.join(fed, where).groupBy("grp", *[f"q{i}" for i in range(D)]).agg(F.sum("w").alias("w"))
    lengths = sizes.join(fed, where).groupBy("grp", "dim", "value").agg(F.sum("w").alias("w"))
    found = estimates(scratch, scratch.save(merged, "merged"), scratch.save(lengths, "lengths"))
    found = found.withColumnRenamed("n_words", "median_words").withColumnRenamed("n_lines", "median_lines")
    verdicts = scratch.save(groups.drop("whole").join(found, "grp"), "verdicts")
    out = stats.join(F.broadcast(verdicts), where, "left") if _few(verdicts) else salted_join(stats, verdicts, where, "left")
    noise = _noise("least(cast(word_chars as double), median_words * exp(m0))", "least(n_words, median_words)", "least(n_lines, median_lines)")
    out = out.selectExpr("*", *noise, *_factor(_NOISE), *_inverse(), f"if(base_failed, null, {_distance([f'x{i}' for i in range(D)])}) as distance")
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row a row of docs: id, the statistics, base_failed, distance (null for base failures and languages too small to judge), kept."""
    out = _judged(docs, F.col(id_col), text_col, lang_col, source_col)
    return out.select(F.col("row").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")


def passing(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that pass, with their columns as they are."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return _judged(docs, whole, text_col, lang_col, source_col).where("kept").select("row.*")
