"""Approximate nearest neighbours: a graph by NN-descent, greedy search in it.

Equal vectors are one node with its smallest ids (as many as an answer can need). To make inner products behave like nearness, vectors
get one more component that lifts all to the same length. A code holds by how much it stays below the greatest length, so that one long vector
doesn't swallow the others' digits. Graph and search score the original vectors in double
precision, so that close but unequal vectors stay apart. What is returned is scored again in one order of summation: all nodes of the beam
whose score lies within the rounding error of the k-th.

Building. Random projections sort the nodes into blocks, in which exact neighbours start the lists. Then, round by round: each node tells
all in its list about itself (its code and its worst score); at each of these, all that told it are neighbours of a
neighbour to one another, are scored as pairs in one matrix product, and those that would improve a list are sent there; lists are merged.
Both steps are joins by node. A node hears ``FAN`` of those that would tell it, chosen by hash among their ids before any code is sent, so that a hub costs no more than other nodes.

Search. A query starts from its own node's list, keeps a beam of its best nodes, and in each round asks the best ``WIDTH`` not yet asked for
those that have them in their lists. The index holds every list entry, hubs in parts of ``FAN`` entries: each row is found from any of its
``LIST`` neighbours. It is dealt out by node once, as a bucketed table, so that rounds exchange only questions and answers; questions to a node
that very many queries ask are dealt over copies of its parts. The number of rounds follows the number of nodes, and ends when nothing is left to ask.

The lists are fitted on all rows. Vectors that are null, zero, or hold null or non-finite components, and
rows without an id, take no part. Shorter vectors count as filled with zeros. Rows that repeat id and vector are one. Fewer candidates than k are
all returned, ties go to the smaller id, and an empty table gives no rows. Recall at 20, measured against brute force, is in the README and held at 0.9 or more by tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lectern.llm.common import bounded, new_path, partitions, range_bucket, table, written

LIST = 32
FAN = 48
ROUNDS = 5
BLOCK = 1024
PROJECTIONS = 2
WIDTH = 64
#: At up to 2**16 nodes; two more for each doubling.
SEARCH_ROUNDS = 8
#: A query's beam holds all that it can ask, and so many more.
SPARE = 128
#: Questions that a node gets in one task.
POPULAR = 20_000

ENTRY = np.dtype([("id", "<i8"), ("score", "<f8")])
BEST = np.dtype([("id", "<i8"), ("score", "<f8"), ("asked", "u1")])


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): v as array of double."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return rows.where(~bad & F.exists("v", lambda x: x != 0))


def _packed(array: np.ndarray) -> list[bytes]:
    """Rows of a two-dimensional array as bytes."""
    array = np.ascontiguousarray(array)
    raw, size = array.tobytes(), array.itemsize * array.shape[1]
    return [raw[i * size : (i + 1) * size] for i in range(len(array))]


def _coded(dims: int, longest: float, kind: str):
    """Vectors to codes: what the lifting component lacks to the greatest length, in double precision, and the others as in the table; with projections to sort by."""
    drawn = np.random.default_rng(5).normal(size=(dims + 1, PROJECTIONS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((batch.num_rows, dims + 1))
            for i, v in enumerate(batch.column("v").to_pylist()):
                x[i, : len(v)] = v
            squares = (x * x).sum(axis=1)
            x[:, dims] = squares / (longest + np.sqrt(np.maximum(0.0, longest * longest - squares)))
            raw = [a + b for a, b in zip(_packed(x[:, dims:].astype("<f8")), _packed(x[:, :dims].astype(kind)), strict=True)]
            sides = x @ drawn
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(raw, pa.binary()), *[pa.array(sides[:, t]) for t in range(PROJECTIONS)]], ["node", "code", *[f"side{t}" for t in range(PROJECTIONS)]])

    return run


def decoded(codes: list[bytes], kind: str, size: int | None = None) -> np.ndarray:
    """Codes, or (size) one block of codes of this size, to vectors."""
    raw = np.frombuffer(b"".join(codes) if size is None else codes[0], dtype=np.uint8).reshape(-1, size or len(codes[0]))
    return np.hstack((np.ascontiguousarray(raw[:, 8:]).view(kind).astype(np.float64), np.ascontiguousarray(raw[:, :8]).view("<f8")))


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Products of all pairs of lifted vectors, less the square of their length."""
    low = x[:, -1]
    return x @ x.T - longest * (low[:, None] + low)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The k best entries, each id once, equals by id."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    _, first = np.unique(ids, return_index=True)
    keep = np.sort(first)[:k]
    out = np.empty(len(keep), dtype=ENTRY)
    out["id"], out["score"] = ids[keep], scores[keep]
    return out


def _blocks(kind: str, longest: float):
    """Exact neighbours inside blocks of the sorted nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list[int] = []
        codes: list[bytes] = []

        def solved() -> pa.RecordBatch:
            x, ids = decoded(codes, kind), np.array(nodes)
            scores = lifted(x, longest)
            np.fill_diagonal(scores, -np.inf)
            some = min(LIST, len(ids) - 1)
            near = np.argpartition(-scores, some - 1, axis=1)[:, :some] if some else np.zeros((len(ids), 0), np.int64)
            out = [best(ids[n], s[n], LIST).tobytes() for n, s in zip(near, scores, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([None] * len(ids), pa.binary()), pa.array(out, pa.binary())], ["node", "code", "entries"])

        for batch in batches:
            nodes += batch.column("node").to_pylist()
            codes += batch.column("code").to_pylist()
            while len(nodes) >= 2 * BLOCK:  # the last block is not smaller than the others
                rest = nodes[BLOCK:], codes[BLOCK:]
                del nodes[BLOCK:], codes[BLOCK:]
                yield solved()
                nodes, codes = rest
        if nodes:
            yield solved()

    return run


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, of): each node to all in its list."""
    for batch in batches:
        lists = [np.frombuffer(raw, dtype=ENTRY)["id"] for raw in batch.column("entries").to_pylist()]
        if lists:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)), pa.array(np.repeat(batch.column("node").to_numpy(), list(map(len, lists))))], ["node", "of"])


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node to all that it shall tell: itself, its code and the score that an entry has to beat."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            to, places, of, code, worst = [], [], [], [], []
            for node, own, raw, tells in zip(*[part.column(c).to_pylist() for c in ("node", "code", "entries", "tells")], strict=True):
                e = np.frombuffer(raw, dtype=ENTRY)
                to += [t["to"] for t in tells]
                places += [t["part"] for t in tells]
                of += [node] * len(tells)
                code += [own] * len(tells)
                worst += [float(e["score"].min()) if len(e) >= LIST else -np.inf] * len(tells)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(places, pa.int32()), pa.array(of, pa.int64()), pa.array(code, pa.binary()), pa.array(worst, pa.float64())], ["node", "part", "of", "code", "worst"])


def _told(graph: DataFrame, turn: int, whole: bool) -> DataFrame:
    """What each node hears, in parts of FAN rows at most: the first part alone or the whole. Ids are numbered by node, in order of a hash, before codes are sent."""
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("node", "of", F.lit(turn)), "of"))
    edges = graph.select("node", "entries").mapInArrow(_edges, "node long, of long").withColumn("place", place)
    if not whole:
        edges = edges.where(F.col("place") <= FAN)
    part = ((F.col("place") - 1) / FAN).cast("int")
    tells = edges.groupBy("of").agg(F.collect_list(F.struct(F.col("node").alias("to"), part.alias("part"))).alias("tells"))  # LIST rows at most
    told = graph.join(tells.withColumnRenamed("of", "node"), "node").select("node", "code", "entries", "tells").mapInArrow(_tell, "node long, part int, of long, code binary, worst double")
    return told.repartition(partitions(graph.sparkSession), "node", "part").sortWithinPartitions("node", "part")


def _runs(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Runs of rows with equal node (and part, where there is one), whole: node and the columns as lists."""
    node, held = None, [[] for _ in columns]
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("node").to_numpy()
        parts = batch.column("part").to_numpy() if "part" in batch.schema.names else np.zeros(len(ids), np.int32)
        values = [batch.column(c).to_pylist() for c in columns]
        cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]) | (parts[1:] != parts[:-1])) + 1).tolist(), len(ids)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if node is not None and (ids[a], parts[a]) != node:
                yield (node[0], *held)
                held = [[] for _ in columns]
            node = (ids[a], parts[a])
            for h, v in zip(held, values, strict=True):
                h += v[a:b]
    if node is not None:
        yield (node[0], *held)


def _introduce(kind: str, longest: float):
    """At a node, those that told it about themselves are scored with one another; what improves a list goes there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to: list[int] = []
        out: list[bytes] = []
        for _, of, code, worst in _runs(batches, "of", "code", "worst"):
            if len(of) > 1:
                ids = np.array(of)
                scores = lifted(decoded(code, kind), longest)
                np.fill_diagonal(scores, -np.inf)
                good = scores > np.array(worst, dtype=np.float64)[:, None]
                for i in np.flatnonzero(good.any(axis=1)).tolist():
                    e = np.empty(int(good[i].sum()), dtype=ENTRY)
                    e["id"], e["score"] = ids[good[i]], scores[i][good[i]]
                    to.append(int(ids[i]))
                    out.append(e.tobytes())
            if len(to) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array([None] * len(to), pa.binary()), pa.array(out, pa.binary())], ["node", "code", "entries"])
                to, out = [], []
        if to:
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array([None] * len(to), pa.binary()), pa.array(out, pa.binary())], ["node", "code", "entries"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A node's code and the best of all entries sent to it."""
    rows: list[tuple] = []
    for node, code, entries in _runs(batches, "code", "entries"):
        own = next((c for c in code if c is not None), None)
        if own is None:
            continue
        e = np.frombuffer(b"".join([x for x in entries if x]), dtype=ENTRY)
        rows.append((int(node), own, best(e["id"], e["score"], LIST).tobytes()))
        if len(rows) == 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["node", "code", "entries"])
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["node", "code", "entries"])


STATE = "node long, code binary, entries binary"


def _by_node(df: DataFrame) -> DataFrame:
    return df.repartition(partitions(df.sparkSession), "node").sortWithinPartitions("node")


def build(coded: DataFrame, kind: str, scale: float = 1.0, rounds: int = ROUNDS) -> DataFrame:
    """(node, code, side0, ...) to the graph (node, code, entries). scale: the length of the vectors."""
    n = max(1, min(partitions(coded.sparkSession), coded.count() // BLOCK))  # no task with less than a block
    state = coded.select("node", "code", F.lit(None).cast("binary").alias("entries"))
    for t in range(PROJECTIONS):
        sides = coded.select("node", "code", F.col(f"side{t}").alias("side"), (F.col(f"side{t}") * 1e9 / F.lit(scale)).cast("long").alias("place"))
        blocks = sides.repartitionById(n, range_bucket(sides, "place", n)[0](F.col("place"), F.xxhash64("node"))).sortWithinPartitions("side", "node")
        state = state.unionByName(blocks.select("node", "code").mapInArrow(_blocks(kind, scale), STATE))
    graph = written(_by_node(state).mapInArrow(_merge, STATE), "graph")
    for turn in range(rounds):
        better = _told(graph, turn, False).mapInArrow(_introduce(kind, scale), STATE)
        graph = written(_by_node(graph.unionByName(better)).mapInArrow(_merge, STATE), "graph")
    return graph


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a node answers in a search, part by part: ids and codes of those that have it in their lists."""
    rows: list[tuple] = []
    for node, of, code in _runs(batches, "of", "code"):
        rows.append((int(node), np.array(of, dtype="<i8").tobytes(), b"".join(code)))
        if len(rows) == 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["node", "ids", "codes"])
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["node", "ids", "codes"])


def _ask(beam: int):
    """Each query to the best nodes that it hasn't asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query, code, raw in zip(*[batch.column(c).to_pylist() for c in ("node", "code", "entries")], strict=True):
                e = np.frombuffer(raw, dtype=BEST)
                at = np.flatnonzero(e["asked"] == 0)[:WIDTH]
                if len(at):
                    worst = e["score"].min() if len(e) >= beam else -np.inf
                    yield pa.RecordBatch.from_arrays([pa.array(e["id"][at]), pa.array(np.full(len(at), query)), pa.array([code] * len(at), pa.binary()), pa.array(np.full(len(at), worst, dtype=np.float64))], ["node", "query", "code", "worst"])

    return run


def _answer(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, x = None, None, None
        for batch in batches:
            to, out = [], []
            codes = batch.column("codes")
            for i, (node, query, code, worst, raw) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("node", "query", "code", "worst", "ids")], strict=True)):
                if (node, raw) != last:  # a node may answer in parts
                    every = codes[i].as_buffer()
                    ids = np.frombuffer(raw, dtype="<i8")
                    size = len(every) // len(ids)
                    x = decoded([every], kind, size)
                    last = (node, raw)
                scores = x[:, :-1] @ decoded([code], kind)[0][:-1]
                good = (scores > worst) & (ids != query)
                if good.any():
                    e = np.zeros(int(good.sum()), dtype=BEST)
                    e["id"], e["score"] = ids[good], scores[good]
                    to.append(query)
                    out.append(e.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array([None] * len(to), pa.binary()), pa.array(out, pa.binary())], ["node", "code", "entries"])

    return run


def _gather(beam: int):
    """A query's beam with the answers it got; what it held before counts as asked as far as it asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for node, code, entries in _runs(batches, "code", "entries"):
            own, parts = None, []
            for c, raw in zip(code, entries, strict=True):
                e = np.frombuffer(raw, dtype=BEST)
                if c is not None:
                    own, e = c, e.copy()
                    e["asked"][np.flatnonzero(e["asked"] == 0)[:WIDTH]] = 1
                parts.append(e)
            e = np.concatenate(parts)
            e = e[np.lexsort((e["id"], -e["asked"].astype(np.int8)))]  # of entries for the same node, one that was asked
            e = e[np.unique(e["id"], return_index=True)[1]]
            e = e[np.lexsort((e["id"], -e["score"]))][:beam]
            rows.append((int(node), own, e.tobytes()))
            if len(rows) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["node", "code", "entries"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["node", "code", "entries"])

    return run


def _seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A query's beam to start with: its own node's list."""
    for batch in batches:
        out = []
        for raw in batch.column("entries").to_pylist():
            e = np.frombuffer(raw, dtype=ENTRY)
            b = np.zeros(len(e), dtype=BEST)
            b["id"], b["score"] = e["id"], e["score"]
            out.append(b.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("code"), pa.array(out, pa.binary())], ["node", "code", "entries"])


def _met(asked: DataFrame, index: DataFrame) -> DataFrame:
    """Questions with the parts of the nodes that they ask."""
    columns = ["node", "query", "code", "worst", "ids", "codes"]
    popular = written(asked.groupBy("node").agg(F.ceil(F.count("*") / POPULAR).cast("int").alias("copies")).where("copies > 1"), "popular")
    if popular.isEmpty():
        return asked.hint("merge").join(index, "node").sortWithinPartitions("node").select(columns)
    few = asked.join(popular, "node", "left_anti").hint("merge").join(index, "node").sortWithinPartitions("node").select(columns)
    copies = index.join(popular, "node").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    many = asked.join(popular, "node").withColumn("copy", F.pmod(F.xxhash64("query"), F.col("copies")).cast("int"))
    return few.unionByName(many.hint("merge").join(copies, ["node", "copy"]).sortWithinPartitions("node").select(columns))


def search(graph: DataFrame, queries: DataFrame, kind: str, rounds: int) -> DataFrame:
    """Beams (node, code, entries) of the query nodes."""
    spark = graph.sparkSession
    beam = WIDTH * rounds + SPARE
    path = new_path(spark, "index")
    name = path.rpartition("/")[2].replace("-", "_")
    lists = _told(graph, -1, True).mapInArrow(_lists, "node long, ids binary, codes binary")
    n = partitions(spark)
    lists.repartition(n, "node").write.bucketBy(n, "node").sortBy("node").option("path", path).option("compression", "zstd").saveAsTable(name)
    index = spark.table(name)
    beams = written(graph.join(queries, "node", "left_semi").mapInArrow(_seed, STATE), "beams")
    for _ in range(rounds):
        asked = written(beams.mapInArrow(_ask(beam), "node long, query long, code binary, worst double"), "asked")
        if asked.isEmpty():
            break
        answers = _met(asked, index).mapInArrow(_answer(kind), STATE)
        beams = written(_by_node(beams.unionByName(answers)).mapInArrow(_gather(beam), STATE), "beams")
    spark.sql(f"DROP TABLE {name}")
    return beams


def _chosen(k: int, longest: float, kind: str):
    """(query node, node) to score again: those that rounding may place among the k best; the query's own node too, for other rows with its vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to, of = [], []
            for node, code, raw in zip(*[batch.column(c).to_pylist() for c in ("node", "code", "entries")], strict=True):
                e = np.frombuffer(raw, dtype=BEST)
                if len(e) > k:
                    q = decoded([code], kind)[0][:-1]
                    error = 4 * (len(q) + 2) * np.finfo(np.float64).eps * longest * np.sqrt(q @ q)  # of two sums of products
                    e = e[e["score"] >= e["score"][k - 1] - error]
                of.append(np.append(e["id"], node))
                to.append(np.full(len(e) + 1, node))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to) if to else [], pa.int64()), pa.array(np.concatenate(of) if of else [], pa.int64())], ["query_node", "node"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each query; vectors: vec_id and embedding; queries: vec_id, a part of them."""
    rows = valid(bounded(vectors))
    # a node: equal vectors, with the k + 1 smallest ids; the limit is applied before rows are exchanged
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    some = rows.distinct().withColumn("place", place).where(F.col("place") <= k + 1)
    nodes = written(some.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("node"), "ids", "v"), "nodes")
    kind = "<f4" if vectors.schema["embedding"].dataType == ArrayType(FloatType(), vectors.schema["embedding"].dataType.containsNull) else "<f8"
    dims, longest = nodes.agg(F.max(F.size("v")), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    coded = written(nodes.select("node", "v").mapInArrow(_coded(dims or 0, longest or 0.0, kind), "node long, code binary, " + ", ".join(f"side{t} double" for t in range(PROJECTIONS))), "codes")
    graph = build(coded, kind, longest or 1.0)
    asked = rows.join(queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    asked = asked.join(nodes.select("v", "node"), "v").select(F.col("vec_id").alias("query_id"), F.col("node").alias("query_node"))
    rounds = SEARCH_ROUNDS + 2 * max(0, nodes.count().bit_length() - 16)
    beams = search(graph, asked.select(F.col("query_node").alias("node")).distinct(), kind, rounds)
    pairs = beams.mapInArrow(_chosen(k, longest or 0.0, kind), "query_node long, node long")
    pairs = pairs.join(nodes, "node").join(nodes.select(F.col("node").alias("query_node"), F.col("v").alias("q")), "query_node")
    score = F.aggregate(F.zip_with("v", "q", lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    found = pairs.select("query_node", F.struct((-score).alias("order"), "ids").alias("near"))
    found = found.groupBy("query_node").agg(F.sort_array(F.collect_list("near")).alias("near"))  # a beam and a node at most
    every = F.flatten(F.transform("near", lambda x: F.transform(x["ids"], lambda i: F.struct(x["order"].alias("order"), i.alias("vec_id")))))
    found = found.select("query_node", every.alias("near"))
    answers = asked.join(found, "query_node").withColumn("near", F.slice(F.sort_array(F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))), 1, k))
    out = answers.select("query_id", F.posexplode("near").alias("rank", "n"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("n.vec_id").alias("vec_id"), (-F.col("n.order")).alias("score"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0").select("vec_id"))
