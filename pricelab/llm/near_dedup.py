"""MinHash near-duplicate detection with an LSH forest.

Method
------
1. One pass hashes every text's distinct ``shingle_words``-word shingles and keeps a MinHash
   signature of ``SIGNATURE`` values, the set's size and a 128-bit key of the set. Texts with
   equal sets are one *class* from here on (a group of copies is one row).
2. The forest: tree t orders all classes by the signature rotated by t * ``DEPTH`` values. Classes
   that share the first ``DEPTH`` values of an order form a region; regions of one class end here.
3. In every region each class is first held against one anchor (a linear number of pairs). Regions of one component
   are then done. In the others, neighbours in the sorted order - those with the longest common prefix - are held
   against each other up to ``NEIGHBOURS`` places apart where they are in different components; for this a region with
   over ``REGION`` classes is cut at a deeper prefix, as often as needed (adaptive depth). That compares a region of up to
   ``NEIGHBOURS`` + 1 classes wholly. The classes of larger regions (uncut) that still hold several components
   are joined exactly: a prefix-filter join on their shingles, rarest first, finds every pair of two components
   that can reach the similarity. Shingles of one component only drop out; a shingle's holders outside its largest
   component meet the holders of a similar set size (in bands of sizes), in salted blocks. Members of a family just
   below the similarity can still share a prefix, which costs its pairs.
4. Every candidate pair is confirmed on the full shingle sets: 100 * |a n b| >= 100 * similarity * |a u b|.
5. Components of the confirmed links come from large-star / small-star rounds on checkpointed tables.

A pair of similarity s shares no region with probability (1 - s ** DEPTH) ** (SIGNATURE / DEPTH): 2e-4 at 0.8,
4e-8 at 0.9. The links found therefore are exact, but a lone pair at the threshold can be missed at that rate.

Only class ids, signatures and the sets of classes in shared regions move; nothing is collected but
counts and one fixed-size bitmap of the classes whose sets the second pass has to send.

Rows: a null or empty text, or one without words, has an empty set and is linked with nothing. A null
doc_id is judged like any other; it never names a component that has another id (a component of null
ids only has a null component_id), and its ``kept`` is false. Repeated rows (equal doc_id and text)
give repeated result rows. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelab.llm import textbytes as tb
from pricelab.session import ensure_checkpoint_dir, release_unused

SIGNATURE = 64
DEPTH = 4
REGION = 4096
NEIGHBOURS = 8
HOLDERS = 1024  # of a shingle, for each salted block of the exact join
BITMAP_BITS = 1 << 23

_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(0, 1 << 32, SIGNATURE, dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, SIGNATURE, dtype=np.uint32)


def _distinct(h: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, ascending inside a text."""
    doc = np.repeat(np.arange(len(made)), made)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(made)).astype(np.int64)


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, offsets = tb.column_bytes(column)
    for i, j in tb.steps(offsets):
        part = tb.lower(buf[offsets[i]: offsets[j]])
        h, made = tb.shingles(*tb.words(part, offsets[i: j + 1] - offsets[i]), size)
        yield (i, j, *_distinct(h, made))


def _keys(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """128-bit keys of the sets: two sums of independent mixes, which no order changes."""
    ends = np.cumsum(n)
    out = np.zeros((len(n), 2), np.uint64)
    for k, salt in enumerate((0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.mix(h ^ np.uint64(salt)), dtype=np.uint64)])
        out[:, k] = tb.mix(sums[ends] - sums[ends - n] + n.astype(np.uint64))
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as one binary value."""
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tb.forget()
        for batch in batches:
            for i, j, h, n in _sets(batch.column("text"), size):
                sig = np.full((j - i, SIGNATURE), np.iinfo(np.uint32).max, np.uint32)
                some = np.flatnonzero(n)
                if len(some):
                    at = (np.cumsum(n) - n)[some]
                    low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
                    for k in range(SIGNATURE):
                        v = low * _MUL[k] + high * _ADD[k]
                        v ^= v >> np.uint32(15)
                        v *= np.uint32(0x2C1B3C6D)
                        v ^= v >> np.uint32(13)
                        sig[some, k] = np.minimum.reduceat(v, at)
                rid, ids = (batch.column(c).slice(i, j - i) for c in ("rid", "doc_id"))
                yield pa.RecordBatch.from_arrays(
                    [rid, ids, pa.array(n), _binary(_keys(h, n)), _binary(sig.astype(">u4"))],
                    ["rid", "doc_id", "n_shingles", "node", "sig"])

    return run


def _involved_sets(size: int, bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tb.forget()
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            for i, j, h, n in _sets(batch.column("text"), size):
                keys = _keys(h, n)
                slot = (keys[:, 0].byteswap() >> np.uint64(32)) % np.uint64(BITMAP_BITS)
                hit = np.flatnonzero((bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 & (n > 0))
                if not len(hit):
                    continue
                ends = np.cumsum(n)
                values = np.concatenate([h[ends[d] - n[d]: ends[d]] for d in hit]).view(np.int64)
                offsets = np.concatenate([[0], np.cumsum(n[hit])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [_binary(keys[hit]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["node", "items"])

    return run


def _slot(node):
    """The bitmap slot of a node: the first four bytes of its key, modulo the bitmap's size."""
    return F.conv(F.hex(F.substring(node, 1, 4)), 16, 10).cast("long") % BITMAP_BITS


def _bitmap(nodes: DataFrame) -> bytes:
    """A fixed-size bitmap (BITMAP_BITS / 8 bytes at any input size) of the nodes; false hits only cost work."""
    rows = (nodes.select(_slot(F.col("node")).alias("s"))
            .groupBy((F.col("s") / 32).cast("long").alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 32 as int))")).alias("b")).toArrow())
    out = np.zeros(BITMAP_BITS // 32, np.uint32)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy().astype(np.uint32)
    return out.astype("<u4").tobytes()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - common
    return both.filter(100 * common >= percent * union).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the component's smallest node.

    Large-star / small-star rounds until all edges (a, b), a > b, are stars: each joins every node to the smallest
    node that it knows. The number of rounds grows with the logarithm of a component's size; a round is two grouped
    minima and two joins. Shuffle files and checkpoints of the rounds before, and of the caller's steps, are let go.
    """
    spark = links.sparkSession
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    release_unused(spark)
    while not _are_stars(edges):
        both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.inline(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))))
        edges = small.filter("a <> b").distinct().checkpoint()
        release_unused(spark)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether no upper end of the distinct edges (a, b), a > b, is an end of another edge."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))))
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).filter("ups > 0 and n > 1").isEmpty()


def _regions(classes: DataFrame) -> DataFrame:
    """(tree, prefix, n, node) of the classes that share a region of n classes with another."""
    trees = SIGNATURE // DEPTH
    width = 4 * DEPTH
    flat = classes.select("node", F.posexplode(F.array(*[
        F.xxhash64(F.substring("sig", 1 + width * t, width)) for t in range(trees)])).alias("tree", "prefix"))
    shared = flat.groupBy("tree", "prefix").agg(F.count("*").alias("n")).filter("n > 1")
    return flat.join(shared, ["tree", "prefix"]).select("tree", "prefix", "n", "node").checkpoint()


def _ordered(regions: DataFrame, classes: DataFrame) -> DataFrame:
    """``regions`` with ``order``, the classes' signatures in the order of the tree."""
    width = 4 * DEPTH
    order = F.concat(F.expr(f"substring(sig, tree * {width} + 1, {4 * SIGNATURE})"), F.expr(f"substring(sig, 1, tree * {width})"))
    return regions.join(classes.select("node", "sig"), "node").withColumn("order", order).drop("sig")


def _cut(regions: DataFrame) -> DataFrame:
    """Cut regions with over REGION classes at deeper prefixes; classes with equal orders are cut by their key."""
    done, open_, depth = regions.filter(F.col("n") <= REGION), regions.filter(F.col("n") > REGION), DEPTH
    while not open_.isEmpty():
        depth *= 2
        if depth <= SIGNATURE:
            deeper = F.xxhash64("prefix", F.expr(f"substring(order, 1, {4 * depth})"))
        else:
            deeper = F.xxhash64("prefix", F.pmod(F.xxhash64("node"), F.greatest(F.lit(2), F.ceil(F.col("n") * 4 / REGION))))
        open_ = open_.withColumn("prefix", deeper)
        n = open_.groupBy("tree", "prefix").agg(F.count("*").alias("n"))
        open_ = open_.drop("n").join(n, ["tree", "prefix"]).select(*regions.columns).checkpoint()
        done = done.unionByName(open_.filter(F.col("n") <= REGION))
        open_ = open_.filter(F.col("n") > REGION)
    return done


def _in_components(regions: DataFrame, stars: DataFrame) -> DataFrame:
    return regions.join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _mixed(placed: DataFrame) -> DataFrame:
    """The regions (tree, prefix) that hold several components."""
    return placed.groupBy("tree", "prefix").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("tree", "prefix")


def _pairs(frame: DataFrame) -> DataFrame:
    return frame.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _exact_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Every pair (a, b) of ``nodes`` (node, root) with two roots that can be similar enough.

    A partner shares at least ``need`` shingles, all of them held under several roots; so of the m such
    shingles of a class, in one order for all, one of the first m - need + 1 is shared."""
    items = nodes.join(sets, "node").select("node", "root", F.size("items").cast("long").alias("n"), F.explode("items").alias("x"))
    held = (items.groupBy("x").agg(F.count("*").alias("holders"), F.min("root").alias("lo"), F.max("root").alias("hi"))
            .filter("lo <> hi").select("x", "holders"))
    own = Window.partitionBy("node")
    first = (items.join(held, "x").withColumn("i", F.row_number().over(own.orderBy("holders", "x")) - 1)
             .withColumn("m", F.count("*").over(own)).filter(f"i <= m - ({percent} * n + 99) div 100")
             .select("x", "node", "root", "n", "i", "m").checkpoint())
    # sets in bands of sizes: a partner's band is the same or a neighbouring one
    first = first.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(max(1.05, 100 / percent)) + 1e-9).cast("int"))
    near = first.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    by_root = near.groupBy("x", "band", "root").agg(F.count("*").alias("c"))
    lists = (by_root.groupBy("x", "band").agg(F.max_by("root", "c").alias("big"), F.sum("c").alias("c"), F.count("*").alias("roots"))
             .filter("roots > 1").select("x", "band", "big", F.ceil(F.col("c") / HOLDERS).cast("int").alias("blocks")))
    left = (first.join(lists, ["x", "band"]).filter("root <> big").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .select("x", "band", "block", *[F.col(c).alias(f"{c}_a") for c in ("node", "root", "n", "i", "m")]))
    asked = left.select("x", "band", "block").distinct()
    right = near.join(asked, ["x", "band"]).select("x", "band", "block", *[F.col(c).alias(f"{c}_b") for c in ("node", "root", "n", "i", "m")])
    # at the first shingle that a pair shares: that one and those after it; a similar pair stands this test there
    most = F.least(F.col("m_a") - F.col("i_a"), F.col("m_b") - F.col("i_b"))
    alike = ((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))) & (
        100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    met = left.join(right, ["x", "band", "block"]).filter((F.col("root_a") != F.col("root_b")) & alike)
    return _pairs(met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))


def link_classes(documents: DataFrame, similarity: float = 0.8, shingle_words: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, links, stars): rows has rid (the row's position), doc_id, n_shingles and node (the class) of every document,
    links the confirmed links (a, b) between classes that connect all components found, stars those components (node, root)."""
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    percent = round(100 * similarity)
    docs = documents.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = docs.mapInArrow(tb.frugal(_signatures(shingle_words)), "rid long, doc_id long, n_shingles long, node binary, sig binary").checkpoint()
    classes = rows.filter("n_shingles > 0").groupBy("node").agg(F.min("sig").alias("sig"))
    regions = _regions(classes)
    involved = regions.select("node").distinct().checkpoint()
    bitmap = spark.sparkContext.broadcast(_bitmap(involved))
    sets = (docs.select("text").mapInArrow(tb.frugal(_involved_sets(shingle_words, bitmap)), "node binary, items array<bigint>")
            .join(involved, "node", "left_semi").groupBy("node").agg(F.first("items").alias("items")).checkpoint())

    anchor = regions.groupBy("tree", "prefix").agg(F.min("node").alias("a"))
    tried = _pairs(regions.join(anchor, ["tree", "prefix"]).select("a", F.col("node").alias("b"))).checkpoint()
    links = _confirmed(tried, sets, percent).checkpoint()
    stars = components(links)
    # only regions of several components go on, and only from here on do they carry signatures
    placed = _in_components(regions, stars)
    mixed = _ordered(placed.join(_mixed(placed), ["tree", "prefix"], "left_semi"), classes).checkpoint()
    w = Window.partitionBy("tree", "prefix").orderBy("order", "node")
    near = F.array(*[F.struct(F.lag("node", k).over(w).alias("a"), F.lag("root", k).over(w).alias("r")) for k in range(1, NEIGHBOURS + 1)])
    found = (_cut(mixed).withColumn("near", near).select("node", "root", F.explode("near").alias("x"))
             .filter("x.a is not null and x.r <> root").select("x.a", F.col("node").alias("b")))
    fresh = _pairs(found).join(tried, ["a", "b"], "left_anti").checkpoint()
    new = _confirmed(fresh, sets, percent).checkpoint()
    links, stars = links.unionByName(new), _joined(stars, new)
    # larger regions than the round compares wholly
    wide = _in_components(regions.filter(F.col("n") > NEIGHBOURS + 1), stars)
    rest = wide.join(_mixed(wide), ["tree", "prefix"], "left_semi").select("node", "root").distinct().checkpoint()
    if not rest.isEmpty():
        more = _exact_pairs(rest, sets, percent).join(tried, ["a", "b"], "left_anti").join(fresh, ["a", "b"], "left_anti")
        more = _confirmed(more, sets, percent).checkpoint()
        links, stars = links.unionByName(more), _joined(stars, more)
    return rows.select("rid", "doc_id", "n_shingles", "node"), links, stars


def _joined(stars: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``stars`` (node, root) after further links."""
    if links.isEmpty():
        return stars
    return components(stars.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(links))


def _placed(rows: DataFrame, stars: DataFrame) -> DataFrame:
    """(node, root) of every class with shingles."""
    nodes = rows.filter("n_shingles > 0").select("node").distinct()
    return nodes.join(stars, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def near_duplicates(documents: DataFrame, similarity: float = 0.8, shingle_words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable), kept (doc_id = component_id) and
    class_links (confirmed links of its class) of every document."""
    rows, links, stars = link_classes(documents, similarity, shingle_words)
    degree = (links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("class_links")))
    nodes = rows.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    placed = nodes.join(_placed(rows, stars), "node")
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_node = (placed.join(least, "root").join(degree, "node", "left")
               .select("node", "component_id", F.coalesce("class_links", F.lit(0)).alias("class_links")))
    alone = (rows.filter("n_shingles = 0")
             .select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("class_links")))
    joined = (rows.filter("n_shingles > 0").join(by_node, "node")
              .select("doc_id", "n_shingles", "component_id", "class_links").unionByName(alone))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return joined.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "class_links")


def keep_one(documents: DataFrame, similarity: float = 0.8, shingle_words: int = 5) -> DataFrame:
    """``documents`` with one row of each group: the smallest doc_id's (null ids last), of repeated rows the first.

    ``documents`` must be a stable scan (such as a written table): rows are found again by their position."""
    rows, _, stars = link_classes(documents, similarity, shingle_words)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    kept = (rows.filter("n_shingles > 0").groupBy("node").agg(first.alias("first"))
            .join(_placed(rows, stars), "node").groupBy("root").agg(F.min("first").alias("first")).select("first.rid"))
    alone = rows.filter("n_shingles = 0").select("rid")
    taken = {c.lower() for c in documents.columns}
    rid = next(c for i in range(len(taken) + 1) if (c := f"__dedup_rid{i}") not in taken)
    at = documents.withColumn(rid, F.monotonically_increasing_id())
    wanted = kept.unionByName(alone).withColumnRenamed("rid", rid)
    return at.join(wanted, rid, "left_semi").select(*[F.col(f"`{c}`") for c in documents.columns])
