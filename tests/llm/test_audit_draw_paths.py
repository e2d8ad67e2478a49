"""Filter audit, importance resampling and chosen-path near-dedup against plain versions of themselves."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import chosen_path, common, filter_audit, importance

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
SIGN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Columns with names that the operators use themselves.
CLASH = "doc_id long, text string, lang string, part string, mask int, n long, key string, id string, c string, label int, h long, score double, rank int"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def some_texts(n, seed=4):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeXYZé日") for _ in range(r.randint(1, 7))) for _ in range(200)]
    texts = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.choice((3, 15, 40, 150)))]
        if i % 4 == 1 and texts[-1]:
            words = texts[-1].split()
            words[r.randrange(len(words))] = "other"
        texts.append(r.choice((" ", " ", "\n", "\t ")).join(words) + r.choice(("", "", "", " 100% & more")))
        if i % 7 == 3:
            texts.append(texts[-1])
    return [*texts, "", None, " \t\n", "one", "two words", "TWO WORDS", "ALL CAPITALS HERE", "\x0b\x0c", "word " * 400, "z" * 5000 + " " + "y" * 70 + " end", "日本語。テキスト　です x", "a\x00b\x1cc"]


def frame(spark, texts, seed=9):
    r = random.Random(seed)
    rows = [(i * 3 - 20, t, r.choice(("en", "de", None, ""))) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (rows[5][0], "the same id, another text", "en"), (None, "no id", "en"), (None, texts[2], None), (None, None, "de")]
    return spark.createDataFrame([(*x, "p", 1, 2, "k", "i", "c", 3, 4, 5.0, 6) for x in rows], CLASH).repartition(3)


def plain(df, *columns):
    return [tuple(x) for x in df.select(*columns).collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, some_texts(90)).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i * 3 - 20, i % 3 == 0, i % 5 == 0) for i in range(0, 80, 2)] + [(-20, 0, 1), (-14, 1, 0), (None, 1, 1)]
    return spark.createDataFrame([(a, int(b), int(c), "p") for a, b, c in rows], "doc_id long, quality int, toxic int, part string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASH)


def plain_audit(rows, marks):
    """Order by order, document by document."""
    least = {}
    for i, t, _ in rows:
        place = (i is None, i or 0)
        least[t or ""] = min(least.get(t or "", place), place)
    good, toxic = {i for i, q, _ in marks if q == 1 and i is not None}, {i for i, _, x in marks if x == 1 and i is not None}
    seen = []
    for i, t, lang in rows:
        t = t or ""
        w = SPACE_WORD.findall(t)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), (i is None, i or 0) > least[t]]
        seen.append((lang or "", "".join(c for c, f in zip("ABCDE", fails, strict=True) if f), i in good, i in toxic))
    out = {}
    for part in {s[0] for s in seen}:
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = [s for s in seen if s[0] == part]
            gone = []
            for step, c in enumerate(order, 1):
                here = [s for s in left if c in s[1]]
                out[part, "".join(order), step] = [len(left) - len(here), len(here), sum(c in s[1] for s in gone), sum(s[1] == c for s in seen if s[0] == part), sum(s[2] for s in here), sum(s[3] for s in here)]
                shapley[c] += len(here)
                gone += here
                left = [s for s in left if c not in s[1]]
        for order in permutations("ABCDE"):
            for step, c in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[c])
    return out


def test_audit(docs, labels):
    rows = filter_audit.audit(docs, labels, filter_audit.five_filters()).collect()
    got = {(x["part"], x["filter_order"], x["step"]): list(x)[3:] for x in rows}
    assert len(rows) == len(got)
    assert got == plain_audit(plain(docs, "doc_id", "text", "lang"), plain(labels, "doc_id", "quality", "toxic"))


def test_audit_by_sql(docs, labels):
    con = duckdb.connect()
    for name, df in (("documents", docs.select("doc_id", "text", "lang")), ("labels", labels)):
        con.register(name, df.toArrow())
    rows = filter_audit.audit(docs, labels, filter_audit.five_filters())
    assert sorted(map(tuple, rows.collect())) == sorted(con.sql(filter_audit.ORACLE).fetchall())


def test_audit_of_nothing_and_of_other_filters(spark, docs, none, labels):
    assert filter_audit.audit(none, labels, filter_audit.five_filters()).collect() == []
    rows = filter_audit.audit(docs, labels.where("false"), {"S": F.col("n_chars") < 50, "W": F.col("n_words") < 5}).collect()
    assert {(x["filter_order"], x["step"]) for x in rows} == {(o, s) for o in ("SW", "WS") for s in (1, 2)}
    assert not any(x["good_lost"] or x["toxic_lost"] for x in rows)
    texts = [x[0] or "" for x in plain(docs, "text")]
    first = sum(x["removed"] for x in rows if x["filter_order"] == "WS" and x["step"] == 1)
    assert first == sum(len(SPACE_WORD.findall(t)) < 5 for t in texts)
    with pytest.raises(ValueError):
        filter_audit.audit(docs, labels, {})


def test_audit_counts_copies_without_a_row_each(spark):
    """A third of all rows is one text: its rows are gathered before they meet."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the copy").otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit("en").alias("lang"))
    rows = filter_audit.audit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"), filter_audit.five_filters())
    assert {x["removed"] for x in rows.where("filter_order like 'E%' and step = 1").collect()} == {999}


def plain_features(text):
    w = SIGN_WORD.findall(lower(text))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_scores(rows, target, buckets=10_000, percent=5):
    coded = [(i, *plain_features(t)) for i, t in rows]
    code = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(code(f) for x in coded for f in x[2]), Counter(code(f) for x in target for f in plain_features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for i, n, fs in coded:
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[code(f)] for f in fs)
        out.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2], x[3]))
    for rank, x in enumerate(able[: percent * len(able) // 100], 1):
        x[5] = rank
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("percent", [5, 60, 100])
def test_resampling(spark, docs, percent):
    target = spark.createDataFrame([("a passage of benchmark text",), (some_texts(5)[0],), (None,)], "text string")
    got = importance.resample(docs, target, percent=percent).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == plain_scores(plain(docs, "doc_id", "text"), [x[0] for x in plain(target, "text")], percent=percent)


def test_resampling_of_nothing(spark, docs, none):
    assert importance.resample(none, docs).collect() == []
    rows = importance.resample(docs, none).collect()
    assert len(rows) == docs.count()


def test_codes_of_features():
    texts = [*some_texts(40, seed=8), "q" * 64 + " " + "r" * 65 + " " + "s" * 63 + " t", "x" * 100_000, "Ünï çödé ÅÄÖ", "a", None, "b"]
    codes, places, first = importance.features(pa.array(texts))
    for i, text in enumerate(texts):
        got = [int(c) for code, at in zip(codes, places, strict=True) for c in code[np.searchsorted(at, first[i]) : np.searchsorted(at, first[i + 1])]]
        assert got == [zlib.crc32(f.encode()) for f in plain_features(text)[1]]


def test_places_are_numbered_over_ranges(spark):
    rows = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("score"), "id").repartition(7)
    got = importance.numbered(rows, [F.col("score").desc(), F.col("id")]).collect()
    order = sorted(got, key=lambda x: (-x["score"], x["id"]))
    assert [x["place"] for x in order] == list(range(1, 5001))


def shingles(text, n=3):
    w = SPACE_WORD.findall(lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def plain_components(rows, percent=85):
    """doc_id, n_shingles, component_id, kept of each row, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        ids[find(i)] += [] if doc is None else [doc]
    return [(doc, len(sets[i]), min(ids[find(i)], default=None)) for i, (doc, _) in enumerate(rows)]


def near_texts(r, n=60, groups=6, size=40):
    """Texts of their own and groups around one text each, with one to many words changed."""
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    texts = [" ".join(word() for _ in range(r.randint(1, 80))) for _ in range(n)]
    for g in range(groups):
        base = [word() for _ in range(100)]
        for _ in range(size):
            some = list(base)
            for _ in range(r.randint(0, 2 + g)):
                some[r.randrange(100)] = word()
            texts.append(" ".join(some))
    return texts


@pytest.mark.parametrize("leaf,levels,block", [(64, 6, 1200), (4, 3, 10), (16, 2, 25)])
def test_near_dedup(spark, monkeypatch, leaf, levels, block):
    monkeypatch.setattr(chosen_path, "BLOCK_CLASSES", block)
    df = frame(spark, [*near_texts(random.Random(leaf)), *some_texts(30), "Mixed CASE words here", "mixed case WORDS here"])
    rows = plain(df, "doc_id", "text")
    got = chosen_path.near_dedup(df, leaf=leaf, levels=levels, trees=24).collect()
    assert sorted((tuple(x)[:3] for x in got), key=str) == sorted(plain_components(rows), key=str)
    for x in got:
        if x["component_id"] is not None:
            assert x["kept"] == (x["doc_id"] == x["component_id"])


def test_near_dedup_of_odd_tables(spark, none):
    assert chosen_path.near_dedup(none).collect() == []
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \t"), (None, None), (None, "a b c d"), (None, "A B C D"), (4, "x"), (5, "X"), (6, "x y")], "doc_id long, text string")
    got = sorted(chosen_path.near_dedup(df).collect(), key=str)
    assert sorted((tuple(x)[:3] for x in got), key=str) == sorted(plain_components(plain(df, "doc_id", "text")), key=str)
    assert sum(x["kept"] for x in got if x["n_shingles"] == 2) == 1  # of the component without ids


def test_a_group_of_copies_costs_stars(spark, monkeypatch):
    """What a large group asks for grows with it, not with its square."""
    monkeypatch.setattr(chosen_path, "BLOCK_CLASSES", 100)
    r = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(600):
        some = list(base)
        some[r.randrange(300)] = f"v{r.random()}"
        texts.append(" ".join(some))
    seen = []
    check = chosen_path.checked
    monkeypatch.setattr(chosen_path, "checked", lambda pairs, *more: (seen.append(pairs.count()), check(pairs, *more))[1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = chosen_path.near_dedup(df).collect()
    assert {x["component_id"] for x in got} == {0} and len(got) == 600
    assert 600 <= sum(seen) < 600 * 24 * 2


def test_survival():
    assert 1 - (1 - chosen_path.survival(0.85)) ** chosen_path.TREES > 1 - 1e-5
    assert chosen_path.survival(0.4) < 0.02


def thue_morse(n):
    a = np.array([0], np.uint8)
    while len(a) < n:
        a = np.concatenate((a, 1 - a))
    return a[:n]


def test_hashes_of_runs():
    r = np.random.default_rng(5)
    raw = r.integers(0, 3, 3000).astype(np.uint8)
    start = r.integers(0, 2900, 2000)
    end = start + r.integers(0, 90, 2000)
    got = common.runs_hash(raw, start, end)
    names = {}
    for h, a, b in zip(got.tolist(), start.tolist(), end.tolist(), strict=True):
        assert names.setdefault(raw[a:b].tobytes(), h) == h
    assert len(set(names.values())) == len(names)
    assert (common.runs_hash(raw, start, end, seed=1) != got).all()
    for n in (8, 64, 1024, 2048, 4096):
        a = thue_morse(n) + 97
        both = np.concatenate((a, 195 - a))
        one, two = common.runs_hash(both, np.array([0, n]), np.array([n, 2 * n])).tolist()
        assert one != two


def test_large_nodes_name_their_least_class(spark):
    """What shares a node of the last level meets its sizes, and by them its least class, in one join."""
    tokens = bytes(4 * 2 * 3)
    classes = spark.createDataFrame([(i, bytearray(tokens)) for i in range(5, 25)], "c long, tokens binary")
    _, dense = chosen_path.tree_nodes(classes, 2, 3, 0.85, 4)
    assert {(r["head"], r["n"]) for r in dense.select("head", "n").collect()} == {(5, 20)}


@pytest.mark.parametrize("pack", [7, 1 << 15])
def test_a_large_node_meets_its_size_in_few_rows(spark, monkeypatch, pack):
    """A node's classes come to the join with its size as arrays, so that a large group makes no row a class there; leaves and last nodes stay whole."""
    monkeypatch.setattr(chosen_path, "PACK", pack)
    classes, met = 300, []
    join = chosen_path.with_total
    monkeypatch.setattr(chosen_path, "with_total", lambda rows, *more: (met.append(rows.count()), join(rows, *more))[1])
    tokens = spark.createDataFrame([(i, bytearray(4 * 2 * 3)) for i in range(classes)], "c long, tokens binary")
    leaves, dense = chosen_path.tree_nodes(tokens, 2, 3, 0.85, 4)
    nodes = dense.groupBy("node").agg(F.count_distinct("c").alias("classes"), F.count("*").alias("rows")).collect()
    assert leaves.count() == 0 and {(r["classes"], r["rows"]) for r in nodes} == {(classes, classes)}
    assert max(met) <= 16 * -(-classes // pack) < 16 * classes / 5
    leaves, dense = chosen_path.tree_nodes(tokens, 2, 3, 0.85, classes)  # all nodes have the same members: one leaf
    assert dense.count() == 0 and sorted(r["c"] for r in leaves.collect()) == list(range(classes))


def test_a_class_in_many_nodes_is_joined_once(spark, monkeypatch):
    """What a large group sends to joins by class is a row a class, not one for each tree, node or task that names it, and no row is lost."""
    met, frames = [], type(spark.range(1))
    join = frames.join
    monkeypatch.setattr(frames, "join", lambda self, other, on=None, how=None: (on == "c" and met.append(self.count()), join(self, other, on, how))[1])
    many, trees = 300, 8
    every = [(i, bytearray(4 * 6 * trees), 10, bytearray(6 * trees), i, i) for i in range(many)]
    classes = spark.createDataFrame(every, "c long, tokens binary, grams long, sketch binary, doc long, h long")
    _, dense = chosen_path.tree_nodes(classes.select("c", "tokens"), trees, 6, 0.85, 4)
    rows = dense.select(F.col("node").alias("task"), "c")
    assert rows.count() >= trees * many and rows.select("c").distinct().count() == many
    stars = chosen_path.compared(rows, classes, 10, 85, 4).collect()
    assert {(x["a"], x["b"]) for x in stars} == {(0, i) for i in range(1, many)}
    texts = classes.select("doc", "h", F.concat(F.lit("text "), "c").alias("text"))
    got = chosen_path.with_texts(rows.withColumn("outer", F.lit(False)), classes, texts).select("task", "c", "outer", "text").collect()
    assert Counter((x["task"], x["c"]) for x in got) == Counter(map(tuple, rows.collect())) and all(x["text"] == f"text {x['c']}" for x in got)
    assert len(met) >= 4 and max(met) <= many
