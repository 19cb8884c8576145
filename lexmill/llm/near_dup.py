"""MinHash near-duplicate detection by bottom-k sketches of one hash function.

1.  Every text becomes its set of distinct 5-word shingles (64-bit hashes); the k smallest are its sketch.
2.  Rows with equal sets form a class, which goes on as one node.
3.  Inverted lists of the retained values: a node goes on if enough of its retained values are held by other
    sketches for the overlap that a link implies.  Most texts end here.
4.  Lists of the remaining sets' values, rarest first, hold only the prefix in which two linked sets must meet,
    with each value's place.  Two sets of n and m values that first meet at places i and j have at most
    min(n - i, m - j) values in common, and a link needs percent (n + m) / (100 + percent) of them.  So the
    smaller of the two lies in the list's core, the members with (100 + percent) (n - i) >= 2 percent n; lists
    without a core are dropped, and members that could link with no core of their list leave it.  Pages of one
    template, which share most of their values but too few for a link, are dropped here before any pair is made.
5.  Lists are not expanded into pairs.  In each round a list's core offers a few pivots, those with the fewest
    values of their own first, and only members that are not yet in the pivot's component meet it, if the bound
    of step 4 allows a link; the number of pivots grows eightfold a round until a list either lies within one
    component or all its core has been pivots.  So no link between components is lost, and a group of thousands
    of copies costs about one comparison a member.  Only what stays open by that bound, yet links with no pivot,
    is compared with many.
6.  A pair goes on if the union sketch estimates a Jaccard of at least ESTIMATE, and becomes a link by its
    exact full-set Jaccard.
7.  Components by contraction to the smallest neighbour, of each round's new links between components only; each
    step is a written table.

A pair of exactly the threshold is lost in steps 3 and 6 with a chance below 1e-8 (an overlap of under
24 of 64 where 48 are expected); sets of up to 64 shingles are never lost.

Nulls, empty and blank texts have an empty set and link with nothing.  Rows that repeat a doc_id are one
document: their texts, equal or not, share a component (and n_shingles and class_id are each row's own).  A null
doc_id links with nothing, its component is null and it is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import skew
from .scratch import Scratch
from .skew import keyed_join
from .words import U64, combine, mix, slices, word_hashes

K = 64
ESTIMATE = 0.375
LEAST_SHARE = 0.375
PIVOT_GROWTH = 8


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, as int64."""
    hashes, counts = word_hashes(texts)
    runs = combine(hashes, width)
    at = 0
    for n in counts:
        if n >= width:
            found = runs[at : at + n - width + 1]
        elif n:
            found = mix(combine(hashes[at : at + n], n) + U64(n))
        else:
            found = runs[:0]
        at += n
        yield np.unique(found.view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(a) for a in arrays], dtype=np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))


def _sketcher(width: int, k: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                sets = list(shingle_sets(texts, width))
                one = [int(s.sum(dtype=np.int64)) for s in sets]
                two = [int(mix(s.view(U64)).sum(dtype=U64).view(np.int64)) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), _lists([s[:k] for s in sets])], ["id", "th", "n", "fp1", "fp2", "sketch"])

    return sketch


def _setter(width: int):
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(list(shingle_sets(texts, width)))], ["node", "shingles"])

    return full


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) for every end of an edge (a, b); root is the smallest node that can be reached."""
    spark = scratch.spark
    edges = scratch.save(edges.select("a", "b").where("a <> b").distinct(), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "parent")
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            jumped = scratch.save(parent.join(up, "root").select("node", F.col("higher").alias("root"), (F.col("higher") != F.col("root")).alias("moved")), "jump")
            parent = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        maps.append(parent)
        to_a, to_b = (parent.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        edges = scratch.save(edges.join(to_a, "a").join(to_b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct(), "edges")
    if not maps:
        return spark.createDataFrame([], "node long, root long")
    out = maps[0]
    for later in maps[1:]:
        higher = later.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        out = out.join(higher, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
    return scratch.save(out, "components")


def merged(scratch: Scratch, labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (node, root) after more links (a, b), of which only those between components are contracted."""
    if labels is None:
        return components(scratch, links)
    of = lambda c: labels.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    found = components(scratch, between)
    higher = found.select(F.col("node").alias("root"), F.col("root").alias("higher"))
    old = labels.join(higher, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
    return scratch.save(old.unionByName(found.join(labels.select("node"), "node", "left_anti")), "labels")


def _links(scratch: Scratch, listed: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame | None:
    """(node, root) of all linked nodes, from lists v, node, n, own, i, core, members, cores."""
    labels = None  # node -> component so far
    tested: list[DataFrame] = []
    pivots = 1
    salts = F.ceil(F.col("members") / skew.HOT_ROWS).cast("int")
    while True:
        if labels is None:
            members = listed.withColumn("root", F.col("node"))
        else:
            members = listed.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
            open_lists = members.groupBy("v").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("members").alias("many")).where("lo <> hi").select("v", "many")
            members = scratch.save(keyed_join(members, scratch.save(open_lists, "open"), ["v"], "many").drop("many"), "members")
            if members.isEmpty():
                return labels
        slot = F.when(F.col("cores") <= pivots, F.col("node")).otherwise(F.pmod(F.xxhash64("node"), F.lit(pivots))) if pivots > 1 else F.lit(0)
        central = F.struct((F.col("own") / F.col("n")).alias("o"), "node", "n", "root", "i")
        offered = members.where("core").groupBy("v", slot.alias("slot")).agg(F.min(central).alias("p"), F.max(salts).alias("salts"))
        offered = offered.select("v", F.col("p.node").alias("pnode"), F.col("p.n").alias("pn"), F.col("p.root").alias("proot"), F.col("p.i").alias("pi"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        common = F.least(F.col("n") - F.col("i"), F.col("pn") - F.col("pi"))
        salted = members.withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int"))
        met = salted.join(scratch.save(offered, "pivots"), ["v", "salt"]).where((F.col("root") != F.col("proot")) & ((100 + percent) * common >= percent * (F.col("n") + F.col("pn"))))
        if pivots == 1:  # each member tries the pivot that it meets most often
            often = met.groupBy("node", "pnode").agg(F.count(F.lit(1)).alias("c"))
            pairs = often.groupBy("node").agg(F.max_by("pnode", F.struct("c", -F.col("pnode"))).alias("pnode")).select(F.least("node", "pnode").alias("a"), F.greatest("node", "pnode").alias("b")).distinct()
        else:
            pairs = met.select(F.least("node", "pnode").alias("a"), F.greatest("node", "pnode").alias("b")).distinct()
            for done in tested:
                pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = scratch.save(pairs, "pairs")
        tested.append(pairs)
        found = _verified(scratch, pairs, sketches, sets, percent, k)
        if labels is None or not found.isEmpty():
            labels = merged(scratch, labels, found)
        if pivots > 1 and members.where(F.col("cores") > pivots).isEmpty():
            return labels
        pivots *= PIVOT_GROWTH


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, k: int = K) -> DataFrame:
    """One row a row of docs: id, n_shingles, class_id (smallest id with an equal set), component_id, kept;
    text_hash, and stays: true for one text of each group of linked texts (and for rows that link with nothing)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    signed = scratch.save(source.mapInArrow(_sketcher(width, k), "id long, th long, n long, fp1 long, fp2 long, sketch array<long>"), "signed")
    named = signed.where("n > 0 and id is not null")
    by_set = named.groupBy("fp1", "fp2").agg(F.min(F.struct("id", "th")).alias("rep"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = scratch.save(by_set.select("fp1", "fp2", F.col("rep.id").alias("rep"), F.col("rep.th").alias("rep_th"), "rows", "n", "sketch", F.monotonically_increasing_id().alias("node")), "classes")
    nodes = keyed_join(named.select("id", "th", "fp1", "fp2"), classes.select("fp1", "fp2", "node", "rows"), ["fp1", "fp2"], "rows").select("id", "th", "node")
    repeated = scratch.save(nodes.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("rows > 1"), "repeated")

    held = F.least(F.col("n"), F.lit(k))
    needed = F.greatest(F.lit(1), F.floor(held * LEAST_SHARE)).cast("int")
    values = classes.select("node", "n", F.explode("sketch").alias("v"))
    shared = scratch.save(values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
    wanted = scratch.save(keyed_join(values, shared, ["v"], "df").groupBy("node", "n").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= needed).select("node"), "wanted")
    sketches = scratch.save(classes.join(wanted, "node", "left_semi").select("node", "n", "rep", "rep_th", "sketch"), "sketches")
    texts = source.where("id is not null").join(sketches.select(F.col("rep").alias("id"), F.col("rep_th").alias("th"), "node"), ["id", "th"])
    if not repeated.isEmpty():
        texts = texts.dropDuplicates(["node"])
    sets = scratch.save(texts.select("node", "text").mapInArrow(_setter(width), "node long, shingles array<long>"), "sets")
    sketches = sketches.drop("rep", "rep_th")

    values = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("v"))
    shared = scratch.save(values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    listed = keyed_join(values, shared, ["v"], "df").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    listed = listed.withColumn("own", F.col("n") - F.size("vs")).withColumn("spare", (prefix - F.col("own")).cast("int")).where("spare > 0")
    listed = listed.select("node", "n", "own", F.posexplode(F.slice("vs", 1, F.col("spare"))).alias("i", "x")).select(F.col("x.v").alias("v"), "node", "n", "own", (F.col("own") + F.col("i")).alias("i"))
    listed = scratch.save(listed.withColumn("core", (100 + percent) * (F.col("n") - F.col("i")) >= 2 * percent * F.col("n")), "listed")
    bounds = listed.groupBy("v").agg(F.count(F.lit(1)).alias("members"), F.count(F.when(F.col("core"), 1)).alias("cores"), F.max(F.when(F.col("core"), F.col("n") - F.col("i"))).alias("most"), F.min(F.when(F.col("core"), F.col("n"))).alias("least"))
    bounds = scratch.save(bounds.where("members > 1 and cores > 0"), "bounds")
    may = F.col("core") | ((100 + percent) * F.least(F.col("n") - F.col("i"), F.col("most")) >= percent * (F.col("n") + F.col("least")))
    listed = scratch.save(keyed_join(listed, bounds, ["v"], "members").where(may).drop("most", "least"), "lists")

    labels = _links(scratch, listed, sketches, sets, percent, k)
    #: The smallest class of each group of linked texts; then groups joined by the documents that they share.
    heads = classes.select("node", "rep", "rep_th", "fp1", "fp2").join(labels, "node").groupBy("root").agg(F.min(F.struct("rep", "fp1", "fp2", "node")).alias("head")).select("root", F.col("head.node").alias("head"))
    heads = scratch.save(labels.join(heads, "root").select("node", "head"), "heads")
    several = repeated.where("lo <> hi")
    if not several.isEmpty():
        labels = merged(scratch, labels, keyed_join(nodes, several, ["id"], "rows").select(F.col("lo").alias("a"), F.col("node").alias("b")))
    least = classes.select("node", "rep").join(labels, "node").groupBy("root").agg(F.min("rep").alias("least"))
    known = classes.select("fp1", "fp2", "node", "rep", "rep_th", "rows").join(labels, "node", "left").join(least, "root", "left").join(heads, "node", "left")
    known = known.select("fp1", "fp2", "rows", "rep", F.coalesce("least", "rep").alias("least"), F.when(F.coalesce(F.col("head") == F.col("node"), F.lit(True)), F.struct("rep", "rep_th")).alias("stays"))
    known = scratch.save(known, "known")
    out = keyed_join(named.select("id", "th", "n", "fp1", "fp2"), known, ["fp1", "fp2"], "rows")
    stays = F.coalesce((F.col("stays.rep") == F.col("id")) & (F.col("stays.rep_th") == F.col("th")), F.lit(False))
    out = out.select("id", "th", "n", F.col("rep").alias("class_id"), F.col("least").alias("component_id"), stays.alias("stays"))
    alone = signed.where("n = 0 or id is null").select("id", "th", "n", F.col("id").alias("class_id"), F.col("id").alias("component_id"), F.lit(True).alias("stays"))
    if not several.isEmpty():  # an empty text of a document that also has words
        named_as = keyed_join(nodes, several, ["id"], "rows").select("id", "node").join(labels, "node").join(least, "root").groupBy("id").agg(F.min("least").alias("least"))
        alone = alone.join(named_as, "id", "left").withColumn("component_id", F.coalesce("least", "component_id")).drop("least")
    out = out.unionByName(alone)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", "component_id", kept.alias("kept"), F.col("th").alias("text_hash"), "stays")


def _verified(scratch: Scratch, pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs (a, b) whose union sketch allows a link and whose full sets make one."""
    of = lambda t, c, what: t.select(F.col("node").alias(c), F.col(what).alias(f"{what}_{c}"))
    near = pairs.join(of(sketches, "a", "sketch"), "a").join(of(sketches, "b", "sketch"), "b")
    union = F.slice(F.sort_array(F.array_union("sketch_a", "sketch_b")), 1, k)
    near = near.withColumn("u", union).where(F.size(F.array_intersect(F.array_intersect("u", "sketch_a"), F.col("sketch_b"))) >= ESTIMATE * F.size("u"))
    near = scratch.save(near.select("a", "b"), "estimated")
    both = near.join(of(sets, "a", "shingles"), "a").join(of(sets, "b", "shingles"), "b")
    both = both.select("a", "b", F.size(F.array_intersect("shingles_a", "shingles_b")).alias("i"), (F.size("shingles_a") + F.size("shingles_b")).alias("s"))
    return scratch.save(both.where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b"), "links")
