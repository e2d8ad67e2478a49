"""N-gram Jaccard join: documents whose sets of word n-grams are alike, by a MinHash LSH forest and exact verification.

1. A document's n-grams (five words) become a set of 64-bit hashes, its MinHash signature and a digest of the set. Equal sets are
   one class from here on, with a count of copies.
2. The signature is cut into trees; a tree's sorted prefixes make a trie, in which a class takes a node at some depth, and classes at one node have met.
   A prefix starts at the deepest level and is shortened as long as the node above is not crowded, at most to the depth
   at which every pair at the threshold meets often enough whatever the others do. Where so many of a class's nodes are crowded that its own chance
   to meet a neighbour at the threshold, over all its trees and their depths, stays below the target recall, its
   prefixes are shortened further, the least crowded first, until it is reached. So depths differ by document and by tree.
   Classes that meet hang on the least of their node, which makes stars instead of pairs; components of these are dealt out together.
3. A component's texts come together once, as one task. A large one is cut into blocks of classes that share prefixes, and a task gets of two blocks
   the classes that have met one of the other. A task counts the common
   n-grams of its pairs exactly, as sums over n-grams and matrix products, and returns for each class its number of links and
   its root; no pair leaves it. Roots from blocks are joined into components again.

The result has a row a document: class_id (least doc_id of the documents that links join), copy_id (least doc_id with
the same set), n_links (other documents at or above the threshold, copies included).

Words are runs of anything but space and U+0009 to U+000D. Very long texts are read whole. A text of fewer words than n is one n-gram of all its words. One without
words (or null) has no links and is its own class. Rows that share a doc_id are one document; if their texts differ, each counts. A document whose doc_id is null
gets a stand-in of 2**62 or more by its text, which names a class only if no member has an id. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import bounded, chained, groups, lean, mix, partitions_for, runs_hash, slices, table, utf8, written
from lectern.llm.components import components, with_least
from lectern.llm.substring_dedup import split

N = 5
THRESHOLD = 0.8
TREES = 28
DEEPEST = 8
RECALL = 0.9999
#: A trie node with more classes is crowded.
CROWDED = 256
#: A block holds about so many n-grams, and so many classes, at most.
BLOCK_GRAMS = 1 << 20
BLOCK_CLASSES = 1200
#: Documents without an id get stand-ins from here on, by a hash of their text, beyond all ids in use.
STAND_INS = 1 << 62


def doc_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(STAND_INS))


def depth(threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL) -> int:
    """The least depth that is needed: at which all trees together reach the target recall for a pair at the threshold."""
    d = deepest
    while d > 1 and 1 - (1 - threshold**d) ** trees < recall:
        d -= 1
    return d


def lowest(shortest: int) -> int:
    """The deepest level of the tries: DEEPEST, as far as 64 bits hold what is below the shortest prefix."""
    return min(max(DEEPEST, shortest), shortest + 4)


def prefixes(met: DataFrame, threshold: float, trees: int, shortest: int, recall: float, crowded: int) -> DataFrame:
    """(node, key, depth): the trie node that each class takes in each tree. met has node, label (of the prefix of the least depth), tail
    (the values below it, 16 bits a level) and n (classes with this label), for labels that several classes have."""
    deepest = lowest(shortest)
    plain = met.where(F.col("n") <= crowded).select("node", F.col("label").alias("key"), F.lit(shortest).alias("depth"))
    packed = met.where(F.col("n") > crowded)
    if deepest == shortest or packed.isEmpty():
        return plain.unionByName(packed.select("node", F.col("label").alias("key"), F.lit(shortest).alias("depth")))
    below = [F.struct(F.lit(d).alias("depth"), F.xxhash64("label", F.shiftright("tail", 16 * (deepest - d)), F.lit(d)).alias("key")) for d in range(shortest + 1, deepest + 1)]
    longer = packed.select("node", "label", "n", F.explode(F.array(*below)).alias("at")).select("node", "label", "n", "at.*")
    counts = longer.groupBy("key").agg(F.count("*").alias("there"))
    fits = F.min(F.when(F.col("there") <= crowded, F.struct("depth", "key")))
    chosen = longer.join(counts, "key").groupBy("node", "label", "n").agg(F.coalesce(fits, F.max(F.struct("depth", "key"))).alias("at")).select("node", "label", "n", "at.*")
    missed = F.log(1 - F.pow(F.lit(threshold), F.col("depth")))  # the chance to miss a neighbour at the threshold in one tree
    least = math.log(1 - threshold**shortest)
    own = Window.partitionBy("node")
    before = F.coalesce(F.sum(least - missed).over(own.orderBy("n", "label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    every = F.sum(missed).over(own) + (trees - F.count("*").over(own)) * F.lit(least)
    chosen = written(chosen.withColumn("short", every + before > math.log(1 - recall)), "prefixes")
    shortened = chosen.where("short").select("label").distinct().withColumn("shortened", F.lit(True))  # at a node, all or none
    chosen = chosen.join(shortened, "label", "left")
    chosen = chosen.select("node", F.when(F.col("shortened"), F.col("label")).otherwise(F.col("key")).alias("key"), F.when(F.col("shortened"), shortest).otherwise(F.col("depth")).alias("depth"))
    return plain.unionByName(chosen)


def gram_sets(column: pa.Array, n: int = N) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    raw, bounds = utf8(column)
    out: list[np.ndarray] = []
    first = 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + (1 << 20), side="right")) - 1)
        some = raw[bounds[first] : bounds[last]]
        ends = bounds[first : last + 1] - bounds[first]
        start, end = split(some, ends)
        words = runs_hash(some, start, end)
        cut = np.searchsorted(start, ends)
        code = chained(words, n)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a >= n:
                out.append(np.unique(code[a : b - n + 1]))
            else:
                out.append(chained(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
        first = last
    return out


def _signed(trees: int, shortest: int, n: int):
    drawn = np.random.default_rng(77)
    deepest = lowest(shortest)
    xor = drawn.integers(0, 1 << 32, trees * deepest, dtype=np.uint32)[:, None]
    times = drawn.integers(0, 1 << 32, trees * deepest, dtype=np.uint32)[:, None] | np.uint32(1)

    def signature(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each tree the label of its shortest prefix, and the values below it."""
        x = (grams >> np.uint64(32)).astype(np.uint32)
        least = np.full(trees * deepest, 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(x), 4096):
            least = np.minimum(least, ((x[at : at + 4096] ^ xor) * times).min(axis=1))
        label, tail = np.arange(1, trees + 1, dtype=np.uint64), np.zeros(trees, dtype=np.uint64)
        for level in range(deepest):
            values = least[level::deepest].astype(np.uint64)
            if level < shortest:
                label = mix(label * np.uint64(0x9E3779B97F4A7C15) + values)
            else:
                tail = tail << np.uint64(16) | mix(values) & np.uint64(0xFFFF)
        return label.view(np.int64), tail.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            sets = gram_sets(batch.column("text"), n)
            there = [i for i, s in enumerate(sets) if len(s)]
            some = [sets[i] for i in there]
            one = np.array([int(mix(s).sum(dtype=np.uint64)) for s in some], dtype=np.uint64).view(np.int64)
            two = np.array([int(mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)) for s in some], dtype=np.uint64).view(np.int64)
            signed = [signature(s) for s in some]
            ends = pa.array(np.arange(len(some) + 1) * trees, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([s[i] for s in signed]) if some else np.zeros(0, np.int64))) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(there, pa.int64())), pa.array(one), pa.array(two), pa.array([len(s) for s in some], pa.int64()), *lists], ["doc", "one", "two", "grams", "labels", "tails"])

    return run


def linked(sets: list[np.ndarray], block: np.ndarray, threshold: float) -> np.ndarray:
    """A matrix of which sets are alike; if there are two blocks, only between them."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes.astype(np.int64))
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    begin = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    count = np.diff(np.append(begin, len(flat)))
    common = np.zeros((m, m), dtype=np.float32)  # exact up to 2**24
    for c in np.unique(count[(count > 1) & (count <= 8)]).tolist():  # rare n-grams: pair by pair
        some = begin[count == c]
        for i in range(c):
            for j in range(i + 1, c):
                np.add.at(common, (owner[some + i], owner[some + j]), np.float32(1))
    common += common.T
    often = np.flatnonzero(count > 8)  # frequent ones: matrix products
    for at in range(0, len(often), 2048):
        x = np.zeros((m, min(2048, len(often) - at)), dtype=np.float32)
        for column, g in enumerate(often[at : at + 2048].tolist()):
            x[owner[begin[g] : begin[g] + count[g]], column] = 1
        common += x @ x.T
    alike = np.empty((m, m), dtype=bool)
    for i in range(m):
        alike[i] = common[i] / (sizes[i] + sizes - common[i]) >= threshold
    np.fill_diagonal(alike, False)
    if len(np.unique(block)) > 1:
        alike &= block[:, None] != block[None, :]
    return alike


def _verified(threshold: float, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, ...]] = []
        held = 0
        for group in groups(batches, "task"):
            group = group.combine_chunks()
            if group.num_rows > 1:  # a repeated row stands next to the other
                doc, text = (group.column(c).chunk(0) for c in ("doc", "text"))
                fresh = pc.or_(pc.not_equal(doc[1:], doc[:-1]), pc.not_equal(text[1:], text[:-1]))
                group = group.filter(pa.concat_arrays([pa.array([True]), fresh])).combine_chunks()
            node = group.column("doc").to_numpy()
            alike = linked(gram_sets(group.column("text").chunk(0), n), group.column("block").to_numpy(), threshold)
            links = alike @ group.column("copies").to_numpy()
            root = node.copy()
            while True:  # the least node that links lead to
                least = root.copy()
                for i in np.flatnonzero(links):
                    least[i] = min(least[i], root[alike[i]].min())
                if (least == root).all():
                    break
                root = least
            rows.append((node, links.astype(np.int64), root, group.column("blocks").to_numpy() > 1))
            held += len(node)
            if held > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], ["node", "links", "root", "parted"])
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], ["node", "links", "root", "parted"])

    return run


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, copy_id and n_links of each document; docs has doc_id and text."""
    texts = bounded(docs).select(doc_key().alias("doc"), "text")
    shortest = depth(threshold, trees, recall=recall)
    signed = texts.mapInArrow(lean(_signed(trees, shortest, n)), "doc long, one long, two long, grams long, labels array<long>, tails array<long>")
    signed = written(signed, "signatures")
    same = ["one", "two", "grams"]
    classes = signed.groupBy(*same).agg(F.min("doc").alias("node"), F.count("*").alias("copies"), F.any_value(F.struct("labels", "tails")).alias("signature"))
    classes = written(classes.select(*same, "node", "copies", "signature.*"), "classes")
    places = classes.select("node", F.explode(F.arrays_zip("labels", "tails")).alias("at")).select("node", F.col("at.labels").alias("label"), F.col("at.tails").alias("tail"))
    shared = places.groupBy("label").agg(F.count("*").alias("n")).where("n > 1")
    at = written(prefixes(written(places.join(shared, "label"), "met"), threshold, trees, shortest, recall, CROWDED).select("node", "key"), "trie")
    stars = with_least(at.select(F.col("key").alias("u"), F.col("node").alias("v")), at.count())
    met = components(stars.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")))
    members = met.unionByName(met.select(F.col("root").alias("node"), "root").distinct()).join(classes.groupBy("node").agg(F.max("grams").alias("grams"), F.sum("copies").alias("copies")), "node")
    full = F.ceil(F.greatest(F.sum("grams") / BLOCK_GRAMS, F.count("*") / BLOCK_CLASSES)).cast("int")
    members = written(members.join(members.groupBy("root").agg(full.alias("blocks")), "root"), "members")
    one = members.where("blocks = 1").select("root", F.col("node").alias("doc"), "copies", F.lit(0).alias("block"), "blocks", F.lit(0).alias("mate"))
    large = members.where("blocks > 1")
    if not large.isEmpty():
        # classes that share their least prefix are in a block, or in several if they are many
        at = at.join(large.select("node"), "node", "left_semi")
        large = large.join(at.groupBy("node").agg(F.min("key").alias("home")), "node")
        parts = large.groupBy("root", "home").agg(full.alias("parts"))
        block = F.pmod(F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("parts"))), F.col("blocks")).cast("int")
        large = written(large.join(parts, ["root", "home"]).withColumn("block", block).drop("home", "parts"), "blocks")
        placed = at.join(large.select("node", "block"), "node")
        mates = placed.join(placed.select("key", F.col("block").alias("mate")).distinct(), "key").select("node", "mate").distinct()
        mates = mates.unionByName(large.select("node", F.col("block").alias("mate"))).distinct()
        one = one.unionByName(large.join(mates, "node").select("root", F.col("node").alias("doc"), "copies", "block", "blocks", "mate"))
    spread = texts.join(one, "doc")
    task = F.xxhash64("root", F.least("block", "mate"), F.greatest("block", "mate"))
    spread = spread.select(task.alias("task"), "doc", "text", "copies", "block", "blocks")
    checked = spread.repartition(partitions_for(docs), "task").sortWithinPartitions("task", "doc", "text")
    checked = written(checked.mapInArrow(lean(_verified(threshold, n)), "node long, links long, root long, parted boolean"), "links")
    edges = checked.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"), "parted")
    parted = edges.where("parted")
    roots = edges.where("not parted").select(F.col("a").alias("node"), F.col("b").alias("root"))
    if not parted.isEmpty():
        roots = roots.unionByName(components(parted.select("a", "b")))
    found = checked.groupBy("node").agg(F.sum("links").alias("links")).join(roots.groupBy("node").agg(F.min("root").alias("root")), "node", "left")
    found = classes.select(*same, "node", "copies").join(found, "node", "left")
    rows = signed.select("doc", *same).join(found, same).groupBy("doc").agg(F.min(F.coalesce("root", "node")).alias("class"), F.min("node").alias("copy"), F.max(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = docs.select("doc_id", doc_key().alias("doc")).join(rows, "doc", "left")
    return rows.select("doc_id", F.coalesce("class", "doc").alias("class_id"), F.coalesce("copy", "doc").alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def first_of_each(docs: DataFrame, **options: float) -> DataFrame:
    """docs without near copies: of each class the document that names it stays, once."""
    keep = jaccard_join(docs.select("doc_id", "text"), **options).select(F.col("class_id").alias("doc")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), doc_key().alias("doc"), F.xxhash64("text").alias("text"))
    return rows.join(keep, "doc", "left_semi").dropDuplicates(["doc", "text"]).select("row.*")
