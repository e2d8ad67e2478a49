"""MinHash near-dedup: components of documents whose shingle sets are alike, by the chosen-path set similarity join.

1. A document's shingles (three words, A-Z in lower case) become a set of 64-bit hashes, and of that minwise tokens, one for each of a tree's
   coordinates. Equal sets are one class from here on, whatever their number.
2. A tree branches classes by minwise tokens: a node's children are the values of a coordinate that the node's path chooses, and,
   for as many nodes as make 1 / threshold children on average, of a second coordinate too. So a pair at the threshold keeps about one common
   node on its way down, while others part. A node of few classes is a leaf; a larger one branches on, down to a last level. Independent
   trees are repeated until a pair at the threshold meets in a leaf or on the last level with the target recall, whatever its company (``survival``).
3. Small nodes are compared exhaustively by their classes' sketches (a byte of some minwise tokens), which rule out only what is
   far below the threshold; nodes of the same members are compared once, in whatever tree. What may be alike makes clusters, and so does what shares
   a node that is still large on the last level. A task tells only edges that span its clusters.
4. A cluster's texts come together once, and full sets decide on all its pairs. In a cluster of too many classes or shingles for a task, first each class is
   checked with the least one of a node that it may be like: these stars give components, as a center's text comes once to each part of its members,
   which pass by one after the other. Only classes outside of the most frequent component then meet all of the cluster, in blocks. No pair leaves a task.

Result: a row for each row of docs: n_shingles, component_id (the least doc_id that links lead to) and kept (doc_id names its component).

Words are runs of anything but space and U+0009 to U+000D. A text of fewer words than n is one shingle of all of them. One without words (or
null) has an empty set and is linked with nothing. Very long texts are read whole. Rows that share a doc_id are judged each by its own text. Rows whose doc_id
is null are told apart by their text; they give a component no id (null if no member has one), and of a component without ids one text's rows are kept.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import bounded, chained, groups, lean, mix, partitions_for, runs_hash, slices, table, utf8, written
from lectern.llm.components import HUB, MOST_HUBS, components
from lectern.llm.jaccard_join import BLOCK_CLASSES, BLOCK_GRAMS, STAND_INS, doc_key, linked
from lectern.llm.substring_dedup import split

N = 3
PERCENT = 85
TREES = 16
#: Levels at which a tree branches; nodes are looked at on the second, and then on each STEP-th and the last.
LEVELS = 6
FIRST_LEVEL = 2
#: So many levels are branched at once from there on.
STEP = 2
#: A node of more classes branches on.
LEAF = 64
#: A node's classes are held in arrays of about so many at most.
PACK = 1 << 15
#: About so many of a star's members are a task.
STAR = 256
#: Sketches rule out a pair that agrees in fewer places than one at the threshold would, by so many standard deviations.
DEVIATIONS = 6


def more_children(threshold: float) -> float:
    """The share of nodes that branch by a second coordinate."""
    return min(1.0, 1 / threshold - 1)


def survival(similarity: float, threshold: float = PERCENT / 100, levels: int = LEVELS) -> float:
    """The chance that a pair shares a node of a tree's last level."""
    q, twice = 1.0, more_children(threshold)
    for _ in range(levels):
        q = (1 - twice) * similarity * q + twice * (1 - (1 - similarity * q) ** 2)
    return q


def shingle_sets(column: pa.Array, n: int = N) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, bounds = utf8(column)
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    start, end = split(raw, bounds)
    words = runs_hash(raw, start, end)
    code = chained(words, n)
    cut = np.searchsorted(start, bounds).tolist()
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        out.append(np.unique(code[a : b - n + 1]) if b - a >= n else chained(words[a:b], max(b - a, 1)))
    return out


def _signed(trees: int, levels: int, n: int):
    coordinates = 2 * trees * levels
    drawn = np.random.default_rng(131)
    xor = drawn.integers(0, 1 << 32, coordinates, dtype=np.uint32)[:, None]
    times = drawn.integers(0, 1 << 32, coordinates, dtype=np.uint32)[:, None] | np.uint32(1)

    def tokens(grams: np.ndarray) -> np.ndarray:
        """A minwise token for each coordinate, 16 bits of it."""
        x = (grams >> np.uint64(32)).astype(np.uint32)
        least = np.full(coordinates, 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(x), 4096):
            least = np.minimum(least, ((x[at : at + 4096] ^ xor) * times).min(axis=1))
        return mix(least.astype(np.uint64)).astype("<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), n)
            one = np.array([int(mix(s).sum(dtype=np.uint64)) for s in sets], dtype=np.uint64).view(np.int64)
            two = np.array([int(mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)) for s in sets], dtype=np.uint64).view(np.int64)
            signed = [tokens(s) if len(s) else None for s in sets]
            paths = pa.array([None if x is None else x.tobytes() for x in signed], pa.binary())
            # of each tree's first coordinates, a byte
            sketches = pa.array([None if x is None else x.reshape(trees, 2, levels)[:, 0].astype(np.uint8).tobytes() for x in signed], pa.binary())
            columns = [*(batch.column(c) for c in ("doc", "known", "h")), pa.array(one), pa.array(two), pa.array([len(s) for s in sets], pa.int64()), paths, sketches]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "known", "h", "one", "two", "grams", "tokens", "sketch"])

    return run


SIGNED = "doc long, known boolean, h long, one long, two long, grams long, tokens binary, sketch binary"
SAME = ["one", "two", "grams"]


def with_total(rows: DataFrame, total: DataFrame, keys: list[str], many: int) -> DataFrame:
    """rows with total's columns; total has a row a key, and n, the rows of that key. Rows of keys that are frequent (over HUB rows and a MOST_HUBS-th of
    all, so fewer than MOST_HUBS keys) meet a broadcast table of them where they are."""
    bound = max(HUB, many // MOST_HUBS)
    hubs = total.where(F.col("n") > bound)
    few = rows.join(F.broadcast(hubs.select(*keys)), keys, "left_anti").join(total.where(F.col("n") <= bound), keys)
    return few.unionByName(rows.join(F.broadcast(hubs), keys))


def by_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The columns of classes (c among them), and ``at``: an array of the rows of each class c. A class is joined as one row, however many trees, nodes or
    tasks name it; ``each`` lists them again."""
    return rows.groupBy("c").agg(F.collect_list(F.struct(*(x for x in rows.columns if x != "c"))).alias("at")).join(classes, "c")


def each(rows: DataFrame) -> DataFrame:
    """A row for each of the rows in ``at``, with the other columns."""
    return rows.withColumn("at", F.explode("at")).select(*(x for x in rows.columns if x != "at"), "at.*")


def _children(level: int, levels: int, threshold: float) -> Column:
    """The nodes below ``node`` that a class with these tokens (of its tree) goes to."""
    token = lambda i: F.substring("own", 2 * i + 1, 2)
    first, second = F.xxhash64("node", token(level), F.lit(1)), F.xxhash64("node", token(levels + level), F.lit(2))
    twice = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * more_children(threshold))
    return F.explode(F.when(twice, F.array(first, second)).otherwise(F.array(first)))


def tree_nodes(classes: DataFrame, trees: int, levels: int, threshold: float, leaf: int) -> tuple[DataFrame, DataFrame]:
    """(task, c) of the leaves, and (node, c, n, head) of what is larger on the last level; head is the node's least class.

    A node's classes meet its size as arrays of PACK at most, not as a row each, and their tokens as a row a class. Leaves of the same members are one."""
    own = lambda tree: F.substring("tokens", tree * 4 * levels + 1, F.lit(4 * levels))
    pack = F.pmod(F.xxhash64("c"), F.lit(math.ceil(max(1, classes.count()) / PACK))).alias("pack")
    at = classes.select("c", "tokens", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    at = at.select("c", "tree", own(F.col("tree")).alias("own"), F.xxhash64("tree", F.lit(0)).alias("node"))
    for level in range(FIRST_LEVEL):
        at = at.select("c", "tree", "own", _children(level, levels, threshold).alias("node"))
    small = []
    level = FIRST_LEVEL
    while True:
        packs = written(at.groupBy("node", "tree", pack).agg(F.collect_list("c").alias("members")).select("node", "tree", "members"), "nodes")
        total = packs.groupBy("node").agg(F.sum(F.size("members")).alias("n"), F.min(F.array_min("members")).alias("head"))
        total = written(total.where("n > 1"), "node-sizes")
        many = packs.agg(F.sum(F.size("members"))).first()[0] or 0
        nodes = written(with_total(packs, total, ["node"], many), "node-members")
        members = F.array_sort(F.flatten(F.collect_list("members"))).alias("members")
        small.append(nodes.where(F.col("n") <= leaf).groupBy("node").agg(members))
        large = nodes.where(F.col("n") > leaf)
        if level == levels or large.isEmpty():
            break
        at = each(by_class(large.select("tree", "node", F.explode("members").alias("c")), classes)).select("c", "tree", own(F.col("tree")).alias("own"), "node")
        for below in range(level, min(level + STEP, levels)):
            at = at.select("c", "tree", "own", _children(below, levels, threshold).alias("node"))
        level = min(level + STEP, levels)
    once = small[0]
    for more in small[1:]:
        once = once.unionByName(more)
    once = once.groupBy("members").agg(F.min("node").alias("task"))
    leaves = written(once.select("task", F.explode("members").alias("c")), "leaves")
    dense = written(large.select("node", F.explode("members").alias("c"), "n", "head"), "dense")
    return leaves, dense


def _compared(agree: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []

        def batch() -> pa.RecordBatch:
            a, b, star = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(star)], ["a", "b", "star"])

        for group in groups(batches, "task"):
            c, grams = group.column("c").to_numpy(), group.column("grams").to_numpy()
            m = len(c)
            sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), dtype=np.uint8).reshape(m, -1)
            least = np.arange(m)  # the least class that each may be like
            top = np.arange(m)  # the first of those that this leads to
            for i in range(m):
                near = np.flatnonzero(100 * np.minimum(grams[:i], grams[i]) >= percent * np.maximum(grams[:i], grams[i]))
                near = near[np.count_nonzero(sketch[near] == sketch[i], axis=1) >= agree]
                if len(near):
                    least[i] = near[0]
                    tops = np.unique(top[near])
                    top[i] = tops[0]
                    if len(tops) > 1:
                        top[np.isin(top, tops)] = tops[0]
            stars = np.flatnonzero(least < np.arange(m))
            ties = np.flatnonzero((least == np.arange(m)) & (top < np.arange(m)))
            if len(stars):
                found.append((c[least[stars]], c[stars], np.ones(len(stars), dtype=bool)))
                found.append((c[top[ties]], c[ties], np.zeros(len(ties), dtype=bool)))
            if sum(len(x[0]) for x in found) > 20_000:
                yield batch()
        if found:
            yield batch()

    return run


def compared(rows: DataFrame, classes: DataFrame, agree: int, percent: int, parts: int) -> DataFrame:
    """(a, b, star), a < b, that span what the sketches of each task's classes leave: stars are pairs that may be alike, and others tie stars together. Tasks may find the same ones. rows: task, c."""
    rows = each(by_class(rows, classes.select("c", "grams", "sketch"))).repartition(parts, "task").sortWithinPartitions("task", "c")
    return rows.mapInArrow(lean(_compared(agree, percent)), "a long, b long, star boolean")


def _linked(percent: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, "task"):
            group = group.combine_chunks()
            c = group.column("c").to_numpy()
            alike = linked(shingle_sets(group.column("text").chunk(0), n), group.column("outer").to_numpy(zero_copy_only=False), percent / 100)
            root = c.copy()
            some = np.flatnonzero(alike.any(axis=1))
            while True:  # the least class that links lead to
                least = root.copy()
                for i in some:
                    least[i] = min(least[i], root[alike[i]].min())
                if (least == root).all():
                    break
                root = least
            at = np.flatnonzero(root != c)
            yield pa.RecordBatch.from_arrays([pa.array(root[at]), pa.array(c[at])], ["a", "b"])

    return run


def exhaustive(rows: DataFrame, classes: DataFrame, texts: DataFrame, percent: int, n: int, parts: int) -> DataFrame:
    """(a, b) that span the links within each task, or (if some of its rows are outer) between these and the others. rows: task, c, outer."""
    rows = with_texts(rows, classes, texts).select("task", "c", "outer", "text").repartition(parts, "task").sortWithinPartitions("task")
    return written(rows.mapInArrow(lean(_linked(percent, n)), "a long, b long"), "links")


def with_texts(rows: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """rows with a text of their class c; each text once, however often its row is repeated."""
    rows = written(by_class(rows, classes.select("c", "doc", "h")), "asked")
    asked = rows.select("doc", "h").distinct().hint("merge")  # it grows with the input, so it isn't broadcast at any size
    own = texts.join(asked, ["doc", "h"], "left_semi").groupBy("doc", "h").agg(F.any_value("text").alias("text"))
    return each(rows.join(own, ["doc", "h"]))


def _checked(percent: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, centers = None, []
        for batch in slices(batches, 200):
            out: list[tuple[int, int]] = []
            sets = shingle_sets(batch.column("text"), n)
            for key, center, c, own in zip(batch.column("task").to_pylist(), batch.column("center").to_pylist(), batch.column("c").to_pylist(), sets, strict=True):
                if key != task:
                    task, centers = key, []
                if c == center:
                    centers.append(own)
                    continue
                for other in centers:
                    small, large = (own, other) if len(own) < len(other) else (other, own)
                    if 100 * len(small) < percent * len(large):
                        continue
                    at = np.searchsorted(large, small)
                    at[at == len(large)] = 0
                    common = int((large[at] == small).sum())
                    if 100 * common >= percent * (len(own) + len(other) - common):
                        out.append((center, c))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], ["a", "b"])

    return run


def thinned(edges: DataFrame) -> DataFrame:
    """Fewer edges (a, b) that connect the same: each b with the least a, and that with the others, which many b share. Some are there more than once."""
    rows = edges.join(edges.groupBy("b").agg(F.min("a").alias("m")), "b")
    return rows.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b")


def checked(pairs: DataFrame, classes: DataFrame, texts: DataFrame, percent: int, n: int, parts: int) -> DataFrame:
    """Those of the pairs (a, b; distinct) that are alike by their full sets. Members of a are dealt to tasks, each of which gets a's text once."""
    stars = with_total(pairs, written(pairs.groupBy("a").agg(F.count("*").alias("n")), "stars"), ["a"], pairs.count())
    stars = stars.select(F.col("a").alias("center"), F.col("b").alias("c"), F.xxhash64("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / STAR))).alias("task"))
    asked = stars.unionByName(stars.select("center", F.col("center").alias("c"), "task").distinct())
    rows = with_texts(asked, classes, texts).withColumn("member", F.col("c") != F.col("center"))
    rows = rows.repartition(parts, "task").sortWithinPartitions("task", "center", "member").select("task", "center", "c", "text")
    return written(rows.mapInArrow(lean(_checked(percent, n)), "a long, b long"), "links")


def blocks(members: DataFrame) -> DataFrame:
    """(task, c, outer) for clusters that are compared in blocks. members: cluster, c, grams, label (what c is known to be linked with).

    Only classes outside of a cluster's most frequent component are outer, and meet all of the cluster."""
    kinds = members.groupBy("cluster", "label").agg(F.count("*").alias("n"), F.sum("grams").alias("grams"))
    size = lambda n, grams: F.ceil(F.greatest(n / BLOCK_CLASSES, grams / BLOCK_GRAMS)).cast("int")
    clusters = kinds.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("grams").alias("grams"), F.max(F.struct("n", "label", "grams")).alias("most"))
    clusters = clusters.select("cluster", "n", F.col("most.label").alias("major"), size(F.col("n"), F.col("grams")).alias("every"), size(F.col("n") - F.col("most.n"), F.col("grams") - F.col("most.grams")).alias("few"))
    rows = with_total(members, written(clusters.where("few > 0"), "clusters"), ["cluster"], members.count())
    inner, outer = F.pmod(F.xxhash64("c"), F.col("every")), F.pmod(F.xxhash64("c", F.lit(5)), F.col("few"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    both = rows.select("cluster", "c", upto("few").alias("i"), inner.cast("int").alias("j"), F.lit(False).alias("outer"))
    both = both.unionByName(rows.where("label <> major").select("cluster", "c", outer.cast("int").alias("i"), upto("every").alias("j"), F.lit(True).alias("outer")))
    return both.select(F.xxhash64("cluster", "i", "j").alias("task"), "c", "outer")


def near_dedup(docs: DataFrame, percent: int = PERCENT, n: int = N, trees: int = TREES, levels: int = LEVELS, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row; docs has doc_id and text. Links have 100 * intersection >= percent * union."""
    threshold, parts, places = percent / 100, partitions_for(docs), trees * levels
    agree = max(0, math.ceil(threshold * places - DEVIATIONS * math.sqrt(threshold * (1 - threshold) * places)))
    texts = bounded(docs).select(doc_key().alias("doc"), F.col("doc_id").isNotNull().alias("known"), F.xxhash64("text").alias("h"), "text")
    signed = written(texts.mapInArrow(lean(_signed(trees, levels, n)), SIGNED), "signatures")
    rep = F.min(F.struct((~F.col("known")).alias("none"), "doc", "h")).alias("rep")  # a row with an id, if there is one
    classes = signed.where("grams > 0").groupBy(*SAME).agg(rep, F.count("*").alias("n"), F.any_value(F.struct("tokens", "sketch")).alias("at"))
    classes = written(classes.select(*SAME, "n", "rep.*", F.col("rep.doc").alias("c"), "at.*"), "classes")
    twice = classes.groupBy("c").agg(F.count("*").alias("same_c")).where("same_c > 1")
    if not twice.isEmpty():  # rows that share an id and differ in text: classes of their own
        own_name = F.when(F.col("same_c").isNull(), F.col("c")).otherwise(-F.xxhash64(*SAME).bitwiseAND(F.lit((1 << 61) - 1)) - F.lit(STAND_INS))
        classes = written(classes.join(twice, "c", "left").withColumn("c", own_name).drop("same_c"), "classes")
    texts = texts.select("doc", "h", "text")
    leaves, dense = tree_nodes(classes.select("c", "tokens"), trees, levels, threshold, leaf)
    chunk = F.xxhash64("node", F.pmod(F.xxhash64("c", "node"), F.ceil(F.col("n") / leaf)))
    edges = compared(leaves.unionByName(dense.select(chunk.alias("task"), "c")), classes, agree, percent, parts)
    heads = dense.where("c <> head").select(F.col("head").alias("a"), F.col("c").alias("b"), F.lit(False).alias("star"))  # what shares a node of the last level may be alike
    edges = written(edges.unionByName(heads).groupBy("a", "b").agg(F.max("star").alias("star")), "edges")
    clusters = components(thinned(edges.select("a", "b"))).select(F.col("node").alias("c"), F.col("root").alias("cluster"))
    clusters = written(clusters.unionByName(clusters.select(F.col("cluster").alias("c"), "cluster").distinct()).join(classes.select("c", "grams"), "c"), "clusters")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("grams").alias("all_grams"))
    large = written(sizes.where((F.col("n") > BLOCK_CLASSES) | (F.col("all_grams") > BLOCK_GRAMS)).select("cluster", "n"), "large")
    small = clusters.join(large, "cluster", "left_anti").select(F.col("cluster").alias("task"), "c", F.lit(False).alias("outer"))
    links = exhaustive(small, classes, texts, percent, n, parts)
    if not large.isEmpty():
        members = written(with_total(clusters, large, ["cluster"], clusters.count()).drop("n"), "members")
        pairs = written(edges.where("star").join(members.select(F.col("c").alias("a")), "a", "left_semi").select("a", "b"), "pairs")
        stars = checked(pairs, classes, texts, percent, n, parts)
        known = components(stars).select(F.col("node").alias("c"), F.col("root").alias("label"))
        members = written(members.join(known, "c", "left").withColumn("label", F.coalesce("label", "c")), "members")
        stars = known.select(F.col("label").alias("a"), F.col("c").alias("b"))  # they connect the same
        links = links.unionByName(stars).unionByName(exhaustive(blocks(members), classes, texts, percent, n, parts))
    roots = components(links).select(F.col("node").alias("c"), "root")
    found = written(classes.drop("tokens", "sketch").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c")), "rooted")
    least = written(found.groupBy("root").agg(F.min(F.struct("none", "doc")).alias("least"), F.count("*").alias("members")).select("root", "least", F.col("members").alias("n")), "least")
    found = with_total(found.withColumnRenamed("n", "copies"), least, ["root"], found.count()).drop("n").select(*SAME, "least", F.col("copies").alias("n"))
    rows = signed.where("grams > 0").select("doc", "known", *SAME)
    rows = with_total(rows, written(found, "classes-found"), SAME, signed.count()).select("doc", "known", "grams", "least")
    empty = signed.where("grams = 0").select("doc", "known", "grams", F.struct((~F.col("known")).alias("none"), "doc").alias("least"))
    rows = rows.unionByName(empty)
    return rows.select(
        F.when(F.col("known"), F.col("doc")).alias("doc_id"), F.col("grams").alias("n_shingles"),
        F.when(~F.col("least.none"), F.col("least.doc")).alias("component_id"), (F.col("doc") == F.col("least.doc")).alias("kept"),
    )


def op13_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
