"""Each operator against a plain version of itself, and its defined results for odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lectern.llm import bpe, common, html_text, jaccard_join, langid, mixing, nn_descent, order_minhash, repeats, substring_dedup, suffix_dedup, token_store
from lectern.llm.common import new_path, range_bucket, utf8, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, key string, spans string, size string, score string, part int"


def vocabulary(n=300, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghiklmnoprstuvwz") for _ in range(r.randint(2, 9))) for _ in range(n)]


def corpus(n=120, seed=2):
    """Texts with copies, near copies, shared passages, repeats inside a text, and odd ones."""
    r, v = random.Random(seed), vocabulary()
    passage = [r.choice(v) for _ in range(70)]
    texts = []
    for i in range(n):
        w = [r.choice(v) for _ in range(r.randint(1, 120))]
        if i % 5 == 0:
            at = r.randint(0, 30)
            w[r.randint(0, len(w)) : 0] = passage[at : at + r.randint(20, 40)]
        if i % 17 == 3:
            w = w + w
        if i % 11 == 4 and texts:
            w = (texts[-1] or "").split()
            if w:
                w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
        if i % 9 == 2:
            texts.append(texts[-1])
    texts += ["", None, " ", "x", "é" * 300, "ab " * 150, "...", "日本語 " * 60, "a\tb\nc\x0bd"]
    return texts


def frame(spark, texts, repeat=True):
    rows = [(i, t, "en" if i % 3 else "de", None if i % 7 == 6 else f"s{i % 4}", len(t or ""), "d", "k", "s", "z", "c", 1) for i, t in enumerate(texts)]
    rows += [(None, "a null id", None, None, 9, "d", "k", "s", "z", "c", 1)]
    if repeat:
        rows += [rows[5], rows[5]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


# -- shared helpers


def test_words_and_bytes():
    raw, bounds = utf8(pa.array(["a b", None, "  ç\n", ""]))
    assert bounds.tolist() == [0, 3, 3, 8, 8]
    start, end = words(raw)
    assert [raw[a:b].tobytes().decode() for a, b in zip(start, end)] == ["a", "b", "ç"]
    sliced = pa.array(["xx", "yy", "zz"]).slice(1, 1)
    assert utf8(sliced)[0].tobytes() == b"yy"


def least(i):
    return -(1 << 63) if i is None else i


@pytest.mark.parametrize("ids", [[None if i % 10 == 0 else i * i for i in range(1000)], [*range(999), 1 << 61], [None] * 500 + [-(1 << 63)] * 200 + list(range(300)), [-(1 << 63), -5, 7, (1 << 63) - 1] * 250])
def test_range_bucket_is_ordered_and_even(spark, ids):
    rows = spark.createDataFrame([(k,) for k in ids], "k long").repartition(3).selectExpr("k", "xxhash64(k, rand(3)) as h")
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    deal, _ = range_bucket(rows, "k", 5)
    got = sorted(rows.withColumn("b", deal(F.col("k"), F.col("h"))).collect(), key=lambda r: (r["k"] is not None, least(r["k"]), r["h"]))
    assert [r["b"] for r in got] == sorted(r["b"] for r in got) and 0 <= got[0]["b"] and got[-1]["b"] <= 4
    assert max(Counter(r["b"] for r in got).values()) <= 520


def test_wide_and_uneven_ids(spark):
    ids = [-(1 << 63), -(1 << 63) + 1, -3, 0, 1, 2, 3, (1 << 63) - 1, *range(100, 130), None, None]
    rows = [(i, f"text of {i} number {n}") for n, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    where = new_path(spark, "store")
    token_store.write_tokens(docs, where, path("byte_bpe_50k.json"))
    starts = sorted(token_store.read_tokens(spark, where).collect(), key=lambda r: r["start"])
    order = [i for i, _ in sorted(rows, key=lambda r: (r[0] is not None, least(r[0])))]
    assert [r["doc_id"] for r in starts] == order
    by = dict(rows)
    got = {r["doc_id"]: r["edited_sha256"] for r in order_minhash.against_next(docs).collect()}
    down = sorted([i for i in ids if i is not None], reverse=True)
    for i, j in zip(down, down[1:]):
        third = len(by[i]) // 3
        assert got[i] == hashlib.sha256((by[i][: len(by[i]) - third] + by[j][:third]).encode()).hexdigest()


# -- 1 token store


def test_token_store(spark, docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    where = new_path(spark, "store")
    token_store.write_tokens(docs, where, path("byte_bpe_50k.json"), shards=3)
    got = [(r["doc_id"], r["start"], r["n_tokens"], list(r["tokens"])) for r in token_store.read_tokens(spark, where).collect()]
    order = sorted(plain(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    want, start = [], 0
    for doc_id, text in order:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), ids))
        start += len(ids)
    assert sorted(got, key=lambda x: x[1]) == want
    sums = token_store.read_tokens(spark, where).mapInArrow(token_store._checksums, "doc_id long, start long, n_tokens long, ids_crc32 long").collect()
    by_start = {w[1]: w for w in want}
    assert all(r["ids_crc32"] == zlib.crc32(np.array(by_start[r["start"]][3], dtype="<u4").tobytes()) for r in sums)
    token_store.write_tokens(none, where + "-none", path("byte_bpe_50k.json"))
    assert token_store.read_tokens(spark, where + "-none").count() == 0


def test_token_store_format(spark, docs):
    where = new_path(spark, "store")
    token_store.write_tokens(docs, where, path("byte_bpe_50k.json"), shards=2)
    files = ds.dataset(f"{where.removeprefix('file:')}/tokens", format="parquet").files
    last = -1
    for f in sorted(files):
        meta = pq.ParquetFile(f).metadata
        columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
        assert "RLE_DICTIONARY" in columns["tokens.list.element"].encodings
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())
        shards = pq.read_table(f, columns=["shard"])["shard"].to_pylist()
        assert len(set(shards)) <= 1 and last < shards[0]
        last = shards[0]


@pytest.mark.parametrize("bits", [4, 10])
def test_a_full_memory_grows(monkeypatch, bits):
    monkeypatch.setattr(token_store, "SLOT_BITS", bits)
    memory = token_store.Memory()
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype("u8")
    for at in range(0, 5000, 17):
        part = keys[at : at + 17]
        memory.add(part, part ^ np.uint64(7), np.ones(len(part), dtype=int), np.arange(at, at + len(part)))
    found = memory.find(keys, keys ^ np.uint64(7))
    assert (memory.ids[memory.starts[found]] == np.arange(5000)).all() and (memory.find(keys, keys) == -1).all()
    memory.clear()
    assert (memory.find(keys, keys ^ np.uint64(7)) == -1).all()


def test_pieces_of_one_hash(monkeypatch):
    """Two pieces with one hash: the texts with the second one are encoded whole."""
    encoder = token_store.PieceEncoder(path("byte_bpe_50k.json"))
    texts = ["some words here", "other words there and here", "", "more of them"]
    want = encoder.direct(texts)
    whole = token_store.runs_hash
    # keys of two bits, checks as they are
    monkeypatch.setattr(token_store, "runs_hash", lambda raw, a, b, seed=0: whole(raw, a, b, seed) if seed else whole(raw, a, b) % np.uint64(4))
    raw, bounds = utf8(pa.array(texts))
    counts, ids = encoder.encode(raw, bounds)
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == np.concatenate(want).tolist()


def test_pieces_equal_the_library():
    encoder = token_store.PieceEncoder(path("byte_bpe_50k.json"))
    r = random.Random(4)
    texts = ["".join(r.choice("aabé  \n\t.,'s1$\x1c  <|x…字🎉") for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["<|endoftext|> a<|endoftext|>", "", " ", "can't've", "a\nb c\nd", "\na", "a ", "x" * 5000]
    for part in (texts, texts[::-1]):  # cold and warm
        counts, ids = encoder.encode(*utf8(pa.array(part)))
        cuts = np.concatenate(([0], np.cumsum(counts)))
        assert all(ids[a:b].tolist() == e.tolist() for a, b, e in zip(cuts[:-1], cuts[1:], encoder.direct(part)))


# -- 2 suffix-array dedup


def removed_bytes(rows, window, mode):
    """(rows' bytes to keep). all: rows are places; later: by id and text, repeats of a row are one."""
    seen = defaultdict(set)
    places = []
    for n, (doc_id, text) in enumerate(rows):
        raw = (text or "").encode()
        place = n if mode == "all" else (doc_id is not None, doc_id or 0)
        places.append((place, raw))
        for i in range(len(raw) - window + 1):
            seen[raw[i : i + window]].add((place, i))
    out = []
    for place, raw in places:
        gone = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            same = seen[raw[i : i + window]]
            if (len(same) > 1) if mode == "all" else min(same) < (place, i):
                gone[i : i + window] = b"\1" * window
        out.append(bytes(b for b, g in zip(raw, gone) if not g))
    return out


@pytest.mark.parametrize("window", [40, 200])
def test_suffix_dedup_all(docs, window):
    from lectern.llm.repeats import with_spans

    rows = plain(docs)
    want = Counter(zip([r[0] for r in rows], [hashlib.sha256(k).hexdigest() for k in removed_bytes(rows, window, "all")]))
    got = with_spans(docs, suffix_dedup.search("all", window, k=min(64, window // 2))).mapInArrow(suffix_dedup._digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()
    assert Counter((r["doc_id"], r["kept_sha256"]) for r in got) == want
    assert all(r["n_removed"] <= r["n_bytes"] and (r["n_spans"] == 0) == (r["n_removed"] == 0) for r in got)


def test_suffix_dedup_keeps_the_first(docs, none):
    rows = plain(docs)
    want = Counter(zip([r[0] for r in rows], [k.decode("utf-8", "ignore") for k in removed_bytes(rows, 200, "later")]))
    out = suffix_dedup.dedup(docs)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["text"] or "") for r in out.collect()) == want
    assert suffix_dedup.dedup(none).collect() == []


def test_suffix_solver_on_tiny_alphabets():
    r = random.Random(6)
    for _ in range(150):
        window = r.choice([3, 8, 12])
        pieces = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 6))]
        symbols = np.frombuffer(b"".join(pieces), dtype="u1")
        bounds = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
        seen = defaultdict(list)
        for i, p in enumerate(pieces):
            for o in range(len(p) - window + 1):
                seen[p[o : o + window]].append(bounds[i] + o)
        for mode in ("all", "later"):
            want = np.zeros(len(symbols), dtype=bool)
            for v in seen.values():
                if len(v) > 1:
                    want[v if mode == "all" else v[1:]] = True
            assert (suffix_dedup.solve(symbols, bounds, np.arange(len(symbols)), window, mode) == want).all()
            assert (substring_dedup.solve(symbols.astype("u8"), bounds, np.arange(len(symbols)), window, mode) == want).all()


def test_longest_previous_factors():
    """The array itself: for every place, the longest match with an earlier place, each piece by itself."""
    r = random.Random(8)
    for _ in range(200):
        window = r.choice([1, 2, 5])
        pieces = [bytes(r.choice(b"abc") for _ in range(r.randint(1, 25))) for _ in range(r.randint(1, 5))]
        pieces += [pieces[0]] * r.randint(0, 2)
        symbols, ends = np.frombuffer(b"".join(pieces), dtype="u1"), np.cumsum([len(p) for p in pieces])
        bounds = np.concatenate(([0], ends))
        places = np.array(r.sample(range(1000), len(symbols)))
        end = np.repeat(ends, np.diff(bounds))
        share = lambda i, j: next((n for n in range(min(end[i] - i, end[j] - j)) if symbols[i + n] != symbols[j + n]), min(end[i] - i, end[j] - j))
        order, lcp = suffix_dedup.suffix_array(symbols, bounds, places, window)
        assert [symbols[i : end[i]].tobytes() for i in order] == sorted(symbols[i : end[i]].tobytes() for i in order)
        assert all(n == share(a, b) for a, b, n in zip(order, order[1:], lcp[1:]))
        got = dict(zip(order.tolist(), suffix_dedup.longest_previous(places[order], lcp).tolist())) if len(order) else {}
        for i in range(len(symbols)):
            want = max([share(i, j) for j in range(len(symbols)) if places[j] < places[i]], default=0)
            assert got.get(i, 0) == want if want >= window else got.get(i, 0) < window


def test_null_ids_are_told_apart_by_whole_hashes():
    """Texts without an id are one document but for the hash of their text, which has 64 bits."""
    assert dict(repeats.FIELDS)["text"] == "<i8" and "key long" in repeats.SPANS and "key long" in repeats.PIECES


def test_many_null_ids(spark):
    r = random.Random(3)
    passage = "".join(r.choice("abcdefgh ") for _ in range(260))
    texts = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(150, 400))) + (passage if i % 50 == 0 else "") for i in range(600)]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(4)
    got = suffix_dedup.dedup(docs, mode="all").collect()
    assert sorted(len(r["text"]) for r in got) == sorted(len(x) for x in removed_bytes([(None, t) for t in texts], 200, "all"))


@pytest.mark.parametrize("mode", ["all", "later"])
def test_whole_pieces(mode):
    """Of pieces that are equal as a whole, solvers say which have another (an earlier) one; the hash alone decides nothing."""
    pieces = [b"ab ab cd", b"xx yy", b"ab ab cd", b"ab ab ce", b"xx yy", b"ab ab cd"]
    symbols, bounds = np.frombuffer(b"".join(pieces), dtype="u1"), np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
    places = np.arange(len(symbols))[::-1].copy() + 100 * np.repeat(np.arange(6)[::-1], np.diff(bounds))
    want = [0, 1, 2, 4, 5] if mode == "all" else [0, 1, 2]
    assert np.flatnonzero(suffix_dedup.solve(symbols, bounds, places, 3, mode, True)).tolist() == bounds[want].tolist()
    assert np.flatnonzero(substring_dedup.solve(symbols.astype("u8"), bounds, places, 3, mode, True)).tolist() == bounds[want].tolist()


# -- 3 order MinHash


def test_order_minhash(docs, none):
    rows = plain(docs)
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] or ""))
    want = Counter()
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        a, b, c = (order_minhash.fingerprint(x) for x in (text, edited, after))
        want[(doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), order_minhash.likeness(a, b), order_minhash.likeness(a, c))] += 1
    assert Counter(tuple(r) for r in order_minhash.against_next(docs).collect()) == want
    assert order_minhash.against_next(none).collect() == []
    one = docs.where("doc_id = 7")
    (row,) = order_minhash.against_next(one).collect()
    assert row["near_next"] == 1.0  # its own next


def plain_fingerprint(text, k=order_minhash.K):
    """Order MinHash in plain Python, k-mer by k-mer."""
    if not text:
        return [0] * order_minhash.FUNCTIONS
    k = min(k, len(text))
    seen, codes, marks = Counter(), [], []
    for i in range(len(text) - k + 1):
        code = 0
        for c in text[i : i + k]:
            code = (code * 0x100000001B3 + ord(c)) % 2**64
        code = plain_mix((code + k) % 2**64)
        codes.append(code)
        marks.append(plain_mix((code + seen[text[i : i + k]] * 0x9E3779B97F4A7C15) % 2**64) >> 32)
        seen[text[i : i + k]] += 1
    out = []
    for f, (x, m) in enumerate(zip(order_minhash._XOR[:, 0].tolist(), order_minhash._MULTIPLY[:, 0].tolist())):
        least = sorted(range(len(marks)), key=lambda i: ((marks[i] ^ x) * m % 2**32, i))[: order_minhash.TUPLE]
        mark = f + 1
        for i in sorted(least):
            mark = plain_mix((mark * 0x100000001B3 + codes[i]) % 2**64)
        out.append(max(mark >> 32, 1))
    return out


def test_order_minhash_against_a_plain_version(monkeypatch):
    r = random.Random(4)
    texts = ["", "a", "abcdefg", "abcdefgh", "ab" * 60, "aaaaaaaaaaaaaaaaaa", "日本語 " * 30, "".join(r.choice("abc d") for _ in range(3000))]
    for cells in (order_minhash.CELLS, 5000):  # a long text goes through some functions at a time
        monkeypatch.setattr(order_minhash, "CELLS", cells)
        for text in texts:
            assert order_minhash.fingerprint(text).tolist() == plain_fingerprint(text)


def test_order_minhash_is_about_order_and_edits():
    v, r = vocabulary(), random.Random(8)
    text = " ".join(r.choice(v) for _ in range(300))
    half = len(text) // 2
    near = order_minhash.likeness(*(order_minhash.fingerprint(x) for x in (text, text.replace(text[100:110], "##########"))))
    swapped = order_minhash.likeness(*(order_minhash.fingerprint(x) for x in (text, text[half:] + text[:half])))
    other = order_minhash.likeness(*(order_minhash.fingerprint(x) for x in (text, " ".join(r.choice(v) for _ in range(300)))))
    assert near > 0.8 > swapped > other
    assert order_minhash.fingerprint("").tolist() == [0] * order_minhash.FUNCTIONS
    assert (order_minhash.fingerprint("ab") == order_minhash.fingerprint("ab")).all() and (order_minhash.fingerprint("ab") != order_minhash.fingerprint("ac")).any()


def test_numbered_kmers():
    points = np.array([ord(c) for c in "abcabcabcab"], dtype=np.uint32)
    code = order_minhash.kmers(points, 3)
    assert [code.tolist().index(x) for x in code.tolist()] == [0, 1, 2, 0, 1, 2, 0, 1, 2]
    assert len(set(order_minhash.numbered(code).tolist())) == len(code)


# -- 4 HTML


PAGE = "<html><head><title>t</title><style>p{{}}</style></head><body class=has-sidebar><nav><a>Home</a></nav><div class='cookie-notice'>We use <b>cookies</b></div>{top}{body}<div id=comments><p>first!</p></div><footer>f</footer><script>var a='</p>'</script></body></html>"


def test_html_by_markup(spark):
    body = "<article><header><h1>A &amp; B</h1></header><p>one  two<br>three<p>four <i>fi</i>ve<aside>no</aside><ul><li>x<li>y</ul><form>q</form></article>"
    rows = [(1, "http://h/a/1", PAGE.format(top="", body=body)), (2, None, None), (3, "http://h/a/2", ""), (1, "http://h/a/1", PAGE.format(top="", body=body))]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = "A & B\none two three\nfour five\nx\ny"
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in got) == [(1, text, len(text)), (1, text, len(text)), (2, "", 0), (3, "", 0)]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string, range string")).collect() == []


def test_html_by_neighbour(spark):
    """Pages without an article: lines shared with the page nearest by path go, whatever they are marked as."""
    rows, want = [], {}
    for i in range(60):
        host = f"h{i % 3}"
        lines = [f"story {i} line {k}" for k in range(1 + i % 4)]
        body = f"<div>Site {host}</div><div>Menu of {host}</div>" + "".join(f"<div>{x}</div>" for x in lines) + f"<div>Imprint {host}</div>"
        rows.append((i, f"https://{host}/blog/{i:03d}?x=1", PAGE.format(top="", body=body)))
        want[i] = "\n".join(lines)
    rows.append((99, "https://alone/x", PAGE.format(top="", body="<div>all of it</div>")))
    want[99] = "all of it"
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in got.collect()} == want
    one = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).repartition(1))
    assert {r["page_id"]: r["text"] for r in one.collect()} == want


@pytest.mark.parametrize("attributes,named", [(" class='cookie-notice x'", True), (" id=siteFooter", True), (' class="post comments-open has-sidebar"', False), (" class=main-nav", True), (" hidden", True), (" data-class='ad'", False), (" class=adventure", False), (" role=navigation", True), (" id=header", True), (" class=site-header", True), (" class=entry-header", False), (" class='market-share-table'", False)])
def test_names_of_elements(attributes, named):
    assert html_text.is_named(attributes) is named


def test_quotes_open_values_only_after_an_equals_sign():
    of = lambda page: [text for text, _, ruled_out in html_text.lines_of(page) if not ruled_out]
    assert of("<p title=don't>Hello</p><p>it's fine</p><p>end</p>") == ["Hello", "it's fine", "end"]
    assert of("""<p title="a > b" data-x='<p>'>x</p><p "odd>y</p><p class = "ad">z</p>""") == ["x", "y"]
    assert of("<p title='class=ad'>kept</p>a < b <p>c</p>" + "<p a='b' " * 40) == ["kept", "a < b", "c", " ".join(["<p a='b'"] * 40)]
    assert of("<p>one <span class=share>Share!</span>two <b>th</b>ree</p>") == ["one two three"]


def plain_template(page, near):
    """Differencing in plain Python: LCS by the whole table, with the nearest page that is no copy; articles are exempt."""

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
        out, i, j = set(), 0, 0
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                out, i, j = out | {i}, i + 1, j + 1
            elif t[i + 1][j] >= t[i][j + 1]:
                i += 1
            else:
                j += 1
        return out

    same = [lcs([x[0] for x in page], [x[0] for x in other]) for other in near]
    inside = {i for i, x in enumerate(page) if x[1]}
    copy = [len(s & inside) * 2 >= len(inside) if inside else len(s) >= 0.8 * len(page) for s in same]
    gone = set()
    if same:
        gone = ([s for s, c in zip(same, copy) if not c] or same)[0] - inside
    return gone


def test_differencing_against_a_plain_version(spark):
    """Pairing by path, alignment and deletion of all pages of some hosts, with and without articles, against plain Python."""
    r = random.Random(9)
    rows = []
    for i in range(80):
        host = f"h{i % 3}.example"
        story = [f"story {i} line {k}" for k in range(r.randint(1, 6))]
        if i % 9 == 8:
            story = [f"story {i - 3} line {k}" for k in range(6)]
        story = [f"Head of {host}"] * (i % 2) + story + [f"Rights of {host}"]
        body = "".join(f"<p>{x}</p>" for x in story)
        body = f"<article>{body}</article>" if host != "h2.example" else body
        rows.append((i, f"https://{host}/{r.choice('ab')}/{r.choice('xyz')}/{i}", f"<body><p>Menu of {host}</p><p class=ad>ad {i}</p>{body}<div>Imprint {host}</div></body>"))
    pages = sorted((html_text.split_url(u), i, html_text.lines_of(h)) for i, u, h in rows)
    want, by_differencing = {}, 0
    for k, ((host, where), i, lines) in enumerate(pages):
        near = [pages[j] for j in (k - 1, k + 1) if 0 <= j < len(pages) and pages[j][0][0] == host]
        near = [x[2] for x in sorted(near, key=lambda x: -html_text.common_start(x[0][1], where))]
        gone = plain_template(lines, near)
        assert gone == html_text.template(lines, near)
        article = any(x[1] and not x[2] for x in lines)
        kept = [j for j, x in enumerate(lines) if not x[2] and (x[1] or not article)]
        left = [j for j in kept if j not in gone] or kept
        by_differencing += left != kept
        want[i] = "\n".join(lines[j][0] for j in left)
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert {x["page_id"]: x["text"] for x in got} == want and by_differencing > 15


def test_lcs():
    def brute(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = random.Random(3)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
        got = sorted(html_text.shared(a, b))
        assert len(got) == brute(a, b)
        it = iter(b)
        assert all(a[i] in it for i in got)
        found = set()
        html_text.by_halves(a, b, 0, found)
        it = iter(b)
        assert len(found) == len(got) and all(a[i] in it for i in sorted(found))
    many = ["x", "y"] * 20_000  # 10**9 pairs of equal lines
    assert len(html_text.shared(["a", *many, "b"], ["c", *many[1:], "d"])) == 39_999


# -- 5 language ID


def test_language(spark):
    r = random.Random(5)
    syllables = {"aa": "ka lo mi ne ru so ta".split(), "bb": "sch ein ung ber tz ch".split(), "cc": "eau ion ent que oir ai".split()}
    rows = []
    for i in range(400):
        lang = r.choice(list(syllables))
        rows.append((i, " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 60))), lang, 0.5))
    rows += [(1000, None, "aa", 0.5), (1001, "", "aa", 0.5), (1002, "123 !?", "bb", 0.5), (1003, "日本", None, 0.5), (None, "kalomi neru", "aa", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    profiles = langid.learn(docs.where(~langid.held_out(docs["doc_id"])))
    assert sorted(profiles) == ["aa", "bb", "cc"]
    got = {r["doc_id"]: r for r in langid.identify(docs, profiles).collect()}
    held = [x for x in rows if x[0] is not None and x[0] < 400 and zlib.crc32(str(x[0]).encode()) % 4 == 2]
    assert len(held) > 60 and sum(got[x[0]]["lang_pred"] == x[2] for x in held) / len(held) > 0.97
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert got[1003]["lang_pred"] in profiles and got[None]["lang_pred"] == "aa"
    assert all(0 <= x["score"] <= 1 for x in got.values())
    kept = langid.in_a_language(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in kept.collect()} == {1000, 1001, 1002, 1003}  # the last is far from all profiles
    assert all(r["score"] == 0.5 for r in kept.collect())
    empty = spark.createDataFrame([], docs.schema)
    assert langid.learn(empty) == {} and langid.in_a_language(empty).collect() == []


# -- 6 BPE


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % 2**64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def spark_hash(x):
    import struct

    import xxhash

    h = xxhash.xxh64(struct.pack("<Q", x), seed=42).intdigest()
    return h - (h >> 63 << 64)


def plain_ranks(texts, most, tie=plain_mix):
    """n-grams of 1 to 3 letters by falling frequency, in plain Python; equals by a hash."""
    import unicodedata

    counts = Counter()
    for text in texts:
        out = " "
        for c in text + " ":
            low = c.lower() if len(c.lower()) == 1 else c
            c = low if c.isalpha() else c if unicodedata.category(c)[0] == "M" else " "
            out += "" if c == " " and out[-1] == " " else c
        for n in (1, 2, 3):
            for i in range(len(out) - n + 1):
                gram = out[i : i + n]
                if gram.strip() and " " not in gram[1:-1]:
                    counts[gram] += 1

    def code(gram):
        x = ord(gram[0])
        for n, c in enumerate(gram[1:], 2):
            x = (x * 0x100000001B3 + ord(c) + (n << 40)) % 2**64
        return x

    return sorted(counts, key=lambda g: (-counts[g], tie(code(g))))[:most]


def test_language_against_a_plain_version(spark):
    r = random.Random(15)
    letters = {"aa": "abcde fgh", "bb": "defgh ijéÀ", "cc": "жзи клмé"}
    make = lambda lang, n: "".join(r.choice(letters[lang] + "  1!.") for _ in range(n))
    rows = [(i, make(lang, r.choice([3, 40, 700])), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 25)]
    rows += [(100, "a" * 60_000 + " cb" * 20_000, None), (101, "é", None), (102, "ab ab", None), (103, "ab ab", None), (104, "İstanbul ǅ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.learn(docs)
    plain_profiles = {lang: plain_ranks([t for _, t, of in rows if of == lang], langid.PROFILE, spark_hash) for lang in letters}
    length = max(map(len, plain_profiles.values()))
    got = {x["doc_id"]: x for x in langid.identify(docs, profiles).collect()}
    for i, text, _ in rows:
        own = plain_ranks([text], langid.DOCUMENT)
        away = {}
        for lang, grams in plain_profiles.items():
            rank = {g: k for k, g in enumerate(grams)}
            away[lang] = sum(min(abs(rank[g] - k), length) if g in rank else length for k, g in enumerate(own))
        if own:
            best = min(away, key=lambda x: (away[x], x))
            assert got[i]["lang_pred"] == best and got[i]["score"] == pytest.approx(1 - away[best] / length / len(own))
        else:
            assert got[i]["lang_pred"] == "und"


def test_language_ties_and_nothing_to_learn(spark):
    same = [(i, "abc abd", lang) for i, lang in enumerate(["zz", "bb"] * 4)]
    docs = spark.createDataFrame(same, "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify(docs, langid.learn(docs)).collect()} == {"bb"}
    unlabelled = spark.createDataFrame([(i, t, None) for i, t in enumerate(["some words", "a", "", None, "12 ?", "日本"])], "doc_id long, text string, lang string")
    assert langid.learn(unlabelled) == {}
    assert {r["lang_pred"] for r in langid.identify(unlabelled, {}).collect()} == {"und"}
    assert sorted(r["doc_id"] for r in langid.in_a_language(unlabelled).collect()) == [0, 1, 5]


def test_language_by_blocks_of_any_number_of_languages(spark, monkeypatch):
    names = [f"l{i:04d}" for i in range(1200)]  # one row each: none is left out
    word = lambda i: "".join(chr(0x4E00 + 7 * i + k) for k in range(5))
    rows = [(i, word(i), lang, i) for i, lang in enumerate(names)] + [(2000, word(3) + " " + word(1100), None, 0), (2001, "abc", None, 0), (2002, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, share long")
    monkeypatch.setattr(langid, "HELD_GRAMS", 100)
    profiles = langid.learn(docs)
    assert list(profiles) == names
    whole = {x["doc_id"]: x for x in langid.identify(docs, profiles).collect()}
    assert all(whole[i]["lang_pred"] == lang for i, lang in enumerate(names)) and whole[2001]["lang_pred"] == "l0000" and whole[2002]["lang_pred"] == "und"
    monkeypatch.setattr(langid, "BLOCK_LANGS", 500)
    parts = langid.identify(docs, profiles)
    assert parts.columns == [*docs.columns, "lang_pred", "score"] and {x["doc_id"]: x for x in parts.collect()} == whole
    letterless = spark.createDataFrame([(1, "12 !", "aa")], "doc_id long, text string, lang string")
    assert langid.learn(letterless) == {}


def test_language_learns_from_rows_without_ids(spark):
    r = random.Random(2)
    rows = [(None, "".join(r.choice("abcdef ") for _ in range(30)), "en") for _ in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few = langid.learn(docs, rows_per_lang=40)["en"]
    counts = Counter(langid.grams(" ".join(t for _, t, _ in rows)).tolist())
    assert 0 < len(few) < len(counts)  # a part of the rows: neither none nor all


def test_bpe_equals_the_library(spark, docs, none):
    from tokenizers import Tokenizer

    name = path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(name)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    r = random.Random(9)
    texts = ["".join(r.choice("aabbéßΣİ  \n\t.'s1²字कि🎉\x1c<|startoftext|>") for _ in range(r.randint(0, 50))) for _ in range(3000)]
    texts += ["a" * 3000, "abc" * 1000, "<|endoftext|>x<|startoftext|>", "", " ", "the quick brown fox", "ΑΣ ΑΣΑ"]
    model = bpe.WordBpe(name)
    coded = model.encode(texts)
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert coded == want
    assert [x.decode() for x in model.decode(coded)] == [tokenizer.decode(np.frombuffer(x, "<u4").tolist(), skip_special_tokens=False) for x in want]
    got = Counter(tuple(r) for r in bpe.round_trip(docs, name).collect())
    expected = Counter()
    for doc_id, text in plain(docs):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        expected[(doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert got == expected
    assert bpe.round_trip(none, name).collect() == [] and bpe.encode(none, name).columns == ["doc_id", "n_tokens", "ids"]


def test_merges_of_overlapping_pairs():
    model = bpe.WordBpe(path("word_bpe_49k.json"))
    assert [model.encode(["a" * n])[0] == model.encode(["a" * n + " b"])[0][: len(model.encode(["a" * n])[0])] for n in range(1, 40)] == [True] * 39


# -- 7 Jaccard join


def gram_set(text, n=5):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def test_jaccard_join(spark, none):
    r, v = random.Random(12), vocabulary()
    texts = corpus(60)
    for _ in range(25):
        w = [r.choice(v) for _ in range(r.randint(40, 120))]
        texts.append(" ".join(w))
        for _ in range(r.randint(1, 3)):
            x = list(w)
            for _ in range(r.randint(0, 2)):
                x[r.randrange(len(x))] = r.choice(v)
            texts.append(" ".join(x))
    docs = frame(spark, texts, repeat=False)
    rows = [(i, t) for i, t in plain(docs) if i is not None]
    sets = {i: gram_set(t) for i, t in rows}
    links, parent = Counter(), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_join(docs).collect()}
    assert len(got) == len(rows) + 1
    assert {i: (got[i]["class_id"], got[i]["n_links"]) for i in sets} == {i: (root(i), links[i]) for i in sets}
    assert got[None]["class_id"] >= jaccard_join.STAND_INS and got[None]["n_links"] == 0
    kept = jaccard_join.first_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([None, *{root(i) for i in sets}])
    assert jaccard_join.jaccard_join(none).collect() == []


def test_jaccard_join_of_large_groups(spark, monkeypatch):
    """A group that takes several blocks: links between blocks count once, roots join."""
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", 12)
    r, v = random.Random(13), vocabulary()
    base = [r.choice(v) for _ in range(200)]
    texts = []
    for _ in range(50):
        x = list(base)
        x[r.randrange(len(x))] = r.choice(v)
        texts.append(" ".join(x))
    docs = frame(spark, texts, repeat=True)
    sets = [gram_set(t) for t in texts]
    want = [sum(len(a & b) / len(a | b) >= 0.8 for j, b in enumerate(sets) if j != i) + (2 if i == 5 else 0) + (2 * (i != 5 and len(a & sets[5]) / len(a | sets[5]) >= 0.8)) for i, a in enumerate(sets)]
    got = [r for r in jaccard_join.jaccard_join(docs).collect() if r["doc_id"] is not None]
    assert len(got) == 52 and {(r["class_id"]) for r in got} == {0}
    assert {r["doc_id"]: r["n_links"] for r in got} == dict(enumerate(want))


def test_forest_depths_differ_by_document(spark):
    """Crowded trie nodes are left for deeper ones, but not where a class would miss the target recall by that."""
    trees, recall, short = 28, 0.9999, 5
    r = random.Random(3)
    rows = []
    for node in range(100):
        for tree in range(trees):
            # 0 to 39: crowded in every tree, told apart by one more value; 40 to 69: crowded in four trees; others in none
            crowded = node < 40 or node < 70 and tree < 4
            label = tree if crowded else 1000 + tree * 1000 + node // 2
            rows.append((node, label, (node // 5 << 32) + r.randrange(3) if crowded else 7, (70 if tree < 4 else 40) if crowded else 2))
    met = spark.createDataFrame(rows, "node long, label long, tail long, n long").repartition(3)
    got = jaccard_join.prefixes(met, 0.8, trees, short, recall, crowded=8).collect()
    assert len(got) == len(rows)
    depths = defaultdict(list)
    for x in got:
        depths[x["node"]].append(x["depth"])
    assert all(1 - np.prod([1 - 0.8**d for d in depths[i]]) >= recall for i in range(100))
    assert all(set(depths[i]) == {5} for i in range(70, 100)) and all(len(set(depths[i])) > 1 for i in range(70))
    assert sorted(depths[10]) != sorted(depths[60]) and max(depths[60]) > 5
    # at a node of the trie all depths are one: classes that share a key share the prefix
    assert len({(x["key"], x["depth"]) for x in got}) == len({x["key"] for x in got})


@pytest.mark.parametrize("crowded", [2, 10])
def test_jaccard_join_with_crowded_prefixes(spark, monkeypatch, crowded):
    monkeypatch.setattr(jaccard_join, "CROWDED", crowded)
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", 9)
    r, v = random.Random(14), vocabulary()
    boiler = [r.choice(v) for _ in range(60)]  # a third of most texts, which makes none of them alike
    texts = [" ".join(boiler + [r.choice(v) for _ in range(120)]) for _ in range(40)]
    base = [r.choice(v) for _ in range(150)]
    for _ in range(40):
        x = list(base)
        for _ in range(r.randint(0, 3)):
            x[r.randrange(len(x))] = r.choice(v)
        texts.append(" ".join(x))
    sets = [gram_set(t) for t in texts]
    want = {i: sum(len(a & b) / len(a | b) >= 0.8 for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)}
    got = jaccard_join.jaccard_join(frame(spark, texts, repeat=False)).collect()
    assert {x["doc_id"]: x["n_links"] for x in got if x["doc_id"] is not None} == want and sum(want.values()) > 300


def test_jaccard_join_of_clashing_columns(spark):
    rows = [(1, "a b c d e f", "x", "y", 5), (2, "a b c d e f", "z", "y", 6), (3, None, "x", "y", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __doc string, __text string, node long")
    assert sorted(tuple(x) for x in jaccard_join.first_of_each(docs).collect()) == [rows[0], rows[2]]


def test_forest_depth():
    assert jaccard_join.depth(0.8, 28, 8, 0.9999) == 5
    assert jaccard_join.depth(0.5, 4, 8, 0.999) == 1
    for t in (0.6, 0.8, 0.9):
        d = jaccard_join.depth(t, 28, 8, 0.999)
        assert d == 1 or 1 - (1 - t**d) ** 28 >= 0.999


# -- 8 substring dedup


def test_substring_dedup(docs, none):
    rows = sorted({(i is not None, i or 0, t or "") for i, t in plain(docs)})
    seen, want = set(), {}
    for there, doc_id, text in rows:
        w = WORD.findall(text)
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            window = tuple(w[i : i + 20])
            if window in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(window)
        want[doc_id if there else None] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    got = substring_dedup.dedup(docs).mapInArrow(substring_dedup._digests, "doc_id long, n_words long, n_removed long, kept_sha256 string").collect()
    assert len(got) == docs.count() and sum(w[1] for w in want.values()) > 100
    assert all(want[r["doc_id"]] == (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got)
    assert substring_dedup.dedup(none).collect() == []


def test_fm_index():
    from lectern.llm.fm_index import FmIndex, WaveletMatrix

    r = np.random.default_rng(2)
    for _ in range(20):
        x = r.integers(0, 5, r.integers(2, 200))
        matrix = WaveletMatrix(x, 4)
        at = r.integers(0, len(x) + 1, 50)
        symbol = r.integers(0, 5, 50)
        low, high = matrix.rank(symbol, np.zeros(50, np.int64), at)
        assert (high == [np.count_nonzero(x[:i] == s) for s, i in zip(symbol, at)]).all()
        symbols, before = matrix.access(np.arange(len(x)))
        assert (symbols == x).all() and (before == [np.count_nonzero(x[:i] == x[i]) for i in range(len(x))]).all()
        index = FmIndex(x, step=3)
        order = index.locate(np.arange(len(x)))
        assert [tuple(x[i:]) for i in order] == sorted(tuple(x[i:]) for i in range(len(x)))
        assert len(index.places) == (len(x) + 2) // 3
        ends = np.arange(3, len(x) + 1)
        length, low, high = index.matching(x, ends, np.full(len(ends), 3))
        for e, n, a, b in zip(ends, length, low, high):
            same = [i for i in range(len(x) - 2) if tuple(x[i : i + 3]) == tuple(x[e - 3 : e])]
            assert (n == 3) == (len(same) > 1)
            if n == 3:
                assert sorted(index.locate(np.arange(a, b))) == same
        assert index.matching(x, np.array([len(x)]), np.array([len(x)]))[0][0] == max([n for n in range(1, len(x)) if sum((x[i : i + n] == x[len(x) - n :]).all() for i in range(len(x) - n + 1)) > 1], default=0)


# -- 9 nearest neighbours


def test_nearest(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 16)) * r.uniform(0.5, 2, (1500, 1))
    x[7:40] = x[7]
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    rows += [(5000, None, 1), (5020, [0.0] * 16, 1), (5040, [float("nan")] * 16, 1), (5060, [1.0, None] * 8, 1), (5080, [float("inf")] * 16, 1), (None, rows[3][1], 1), rows[11]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(3)
    got = defaultdict(list)
    for q, k, v, s in sorted(nn_descent.nearest(df, df.where("vec_id % 20 = 0")).collect()):
        assert k == len(got[q]) + 1
        got[q].append((v, s))
    assert sorted(got) == list(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        scores = x @ x[q]
        scores[q] = -np.inf
        order = np.lexsort((np.arange(1500), -np.round(scores, 9)))[:20]
        assert len(found) == 20 and np.allclose([s for _, s in found], [scores[v] for v, _ in found])
        hits += len({v for v, _ in found} & set(order.tolist()))
    assert hits / (20 * len(got)) >= 0.9
    few = df.where("vec_id in (0, 1, 2)")
    assert Counter(r["query_id"] for r in nn_descent.nearest(few, few.where("vec_id = 0")).collect()) == {0: 2}
    assert nn_descent.nearest(df.where("false"), df.where("false")).collect() == []


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def recall(spark, x, k=20):
    """Recall of every 20th row's k nearest among all rows of x."""
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(set)
    for r in nn_descent.nearest(df, df.where("vec_id % 20 = 0"), k).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = []
    for q in range(0, len(x), 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits.append(len(got[q] & set(np.argsort(-scores)[:k].tolist())) / k)
    return np.array(hits)


def test_nearest_in_a_group_of_near_duplicates(spark):
    r = np.random.default_rng(3)
    x = unit(r.normal(size=(2400, 64)))
    x[:800] = unit(x[0] + 0.001 * unit(r.normal(size=(800, 64))))
    hits = recall(spark, x)
    assert hits.mean() >= 0.9 and hits[:40].mean() >= 0.9


def test_nearest_around_hubs(spark, monkeypatch):
    """Clusters of mixed spread, whose centres are in very many lists: no list entry is left out of the index, nodes that many ask answer in copies."""
    monkeypatch.setattr(nn_descent, "POPULAR", 20)
    r = np.random.default_rng(7)
    centres = unit(r.normal(size=(12, 32)))
    x = np.concatenate([c + s * r.normal(size=(200, 32)) for c, s in zip(centres, r.uniform(0.02, 0.5, 12))])
    hits = recall(spark, x)
    assert hits.mean() >= 0.95 and hits.min() >= 0.5
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("index_")]


def test_all_list_entries_are_in_the_index(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "FAN", 4)
    r = np.random.default_rng(2)
    entries = {i: np.array([(j, 0.5) for j in {0, *r.integers(0, 50, 6).tolist()} - {i}], dtype=nn_descent.ENTRY) for i in range(50)}
    graph = spark.createDataFrame([(i, b"code%02d" % i, e.tobytes()) for i, e in entries.items()], nn_descent.STATE).repartition(3)
    rows = nn_descent._told(graph, -1, True).mapInArrow(nn_descent._lists, "node long, ids binary, codes binary").collect()
    assert max(len(x["ids"]) for x in rows) <= 32 and sum(x["node"] == 0 for x in rows) > 10  # node 0, which all list, in parts
    assert sorted((x["node"], i) for x in rows for i in np.frombuffer(x["ids"], "<i8").tolist()) == sorted((j, i) for i, e in entries.items() for j in e["id"].tolist())
    assert all(x["codes"] == b"".join(b"code%02d" % i for i in np.frombuffer(x["ids"], "<i8").tolist()) for x in rows)
    heard = Counter(x["node"] for x in nn_descent._told(graph, 1, False).collect())
    assert max(heard.values()) == 4


@pytest.mark.parametrize("norms", ["outlier", "lognormal"])
def test_nearest_of_spread_norms(spark, norms):
    r = np.random.default_rng(3)
    x = unit(r.normal(size=(2400, 64)))
    if norms == "outlier":
        x[1200] *= 100
    else:
        x *= r.lognormal(0, 1.5, (2400, 1))
    assert recall(spark, x).mean() >= 0.9


# -- 10 mixing


def test_names_of_ours_in_the_input(spark):
    """Columns named as the operators' own keep their values."""
    names = ["doc_id", "text", "source", "__key", "__cut", "__spans", "___cut", "size", "lang", "lang_pred", "score", "__score"]
    rows = [(i, f"word{i} some more words {i % 3} and a tail", f"s{i % 2}", *[f"{c}{i}" for c in names[3:8]], "en", *[f"{c}{i}" for c in names[9:]]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"`{c}` string" for c in names[1:]))
    for out in (mixing.mixed(docs), langid.in_a_language(docs), suffix_dedup.dedup(docs), jaccard_join.first_of_each(docs)):
        assert out.columns == names
        got = out.collect()
        assert got and all([r[c] for c in names[3:8]] == [f"{c}{r['doc_id']}" for c in names[3:8]] for r in got)


def test_partitions_follow_the_input(spark, tmp_path, monkeypatch):

    where = str(tmp_path / "t")
    spark.range(50_000).selectExpr("id", "uuid() as text").write.parquet(where)
    docs = spark.read.parquet(where)
    assert common.partitions_for(docs) == common.partitions(spark) == common.partitions_for(spark.createDataFrame([(1,)], "a int"))
    monkeypatch.setattr(common, "PARTITION_BYTES", 100_000)
    assert 10 < common.partitions_for(docs) < 100


def test_water_filling(spark):
    def filled(sizes, weights, cap):
        targets, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
        while open_:
            level = left / sum(weights[i] for i in open_)
            over = [i for i in open_ if level * weights[i] >= cap * sizes[i]]
            if not over:
                for i in open_:
                    targets[i] = level * weights[i]
                break
            for i in over:
                targets[i] = float(cap * sizes[i])
                left -= cap * sizes[i]
                open_.discard(i)
        return targets

    r = random.Random(4)
    for _ in range(5):
        sizes = [r.choice([0, 1, 5, 10, 100, 1000]) for _ in range(r.randint(1, 9))]
        names = sorted(f"s{i:02d}" for i in range(len(sizes)))
        rows = list(zip([*names[:-1], None], sizes))
        got = {x["source"]: x["target"] for x in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
        want = filled(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 3)
        assert [got[s] for s, _ in rows] == pytest.approx(want)


def test_mixing(docs, none):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count()
    taken, target = Counter(), {}
    for r in rows:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] == r["repeats"] * r["size"] + r["part"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) < 8 for s in target)
    assert sorted(map(str, mixing.mix_sources(docs.repartition(5)).select("doc_id", "taken").collect())) == sorted(map(str, [r for r in mixing.mix_sources(docs).select("doc_id", "taken").collect()]))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and {r["size"] for r in out.collect()} <= {"z"}
    words_out = Counter()
    for r in out.collect():
        words_out[r["source"]] += len(WORD.findall(r["text"] or ""))
    assert words_out == taken
    assert mixing.mix_sources(none).collect() == [] and mixing.mixed(none).collect() == []


@pytest.mark.parametrize("hot", [1, 3, 1024])
def test_hot_anchors_give_the_same(docs, hot):
    from dataclasses import replace

    rows = plain(docs)
    for mode in ("all", "later"):
        got = repeats.with_spans(docs, replace(suffix_dedup.search(mode, 60, k=20), hot=hot)).mapInArrow(suffix_dedup._digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()
        want = Counter(zip([r[0] for r in rows], [hashlib.sha256(k).hexdigest() for k in removed_bytes(rows, 60, mode)]))
        assert Counter((r["doc_id"], r["kept_sha256"]) for r in got) == want


def test_token_store_reads_selectively(spark, docs):
    where = new_path(spark, "store")
    token_store.write_tokens(docs, where, path("byte_bpe_50k.json"), shards=2)
    plan = lambda df: df._jdf.queryExecution().toString()
    metadata = plan(token_store.read_tokens(spark, where, tokens=False))
    assert "tokens:array" not in metadata.split("ReadSchema")[-1]
    some = token_store.read_tokens(spark, where).where("doc_id in (3, 4)")
    assert "In(doc_id, [3,4])" in plan(some) and some.count() == 2


def test_anchors_of_texts_beyond_the_place_width(monkeypatch):
    search = suffix_dedup.search("all", 40, k=10)
    tail = np.random.default_rng(4).integers(97, 123, 200).astype("u1")
    raw = np.concatenate((np.random.default_rng(5).integers(97, 123, 1500).astype("u1"), tail, [32, 33], tail)).astype("u1")
    symbols, bounds = suffix_dedup.byte_symbols(raw), np.array([0, len(raw)])
    want = repeats.anchors(symbols, bounds, search)
    monkeypatch.setattr(repeats, "PLACE_BITS", 8)
    got = repeats.anchors(symbols, bounds, search)
    # every window holds an anchor, also those past the width
    assert got[0].max() > 1800 and np.diff(got[0]).max() <= 31 and (np.diff(got[0]) > 0).all()
    # each window belongs to one piece, which holds its anchor
    assert got[2][0] == 0 and (got[2][1:] + 39 == got[3][:-1]).all() and got[3][-1] == len(raw) and (got[2] <= got[0]).all() and (got[0] + 10 <= got[3]).all()
    # a passage's two copies have the same anchors wherever they stand
    inner = lambda at, begin: {p - begin for p in at.tolist() if begin + 40 <= p < begin + 150}
    assert inner(got[0], 1500) == inner(got[0], 1702) and inner(got[0], 1500)
    assert got[0].shape == want[0].shape and (got[0] == want[0]).all()


def test_anchors_of_a_text_of_more_than_2_to_the_24():
    n = (1 << 24) + 3000
    symbols = suffix_dedup.byte_symbols(np.random.default_rng(6).integers(97, 123, n).astype("u1"))
    at = repeats.anchors(symbols, np.array([0, n]), suffix_dedup.search("all"))[0]
    assert at[-1] > 1 << 24 and (np.diff(at) > 0).all()


def test_functions_for_workers_take_no_tables_along():
    from pyspark import cloudpickle

    common.powers(1 << 20)
    sent = [repeats._cut(suffix_dedup.search("later", 200), 4), jaccard_join._signed(28, 5, 5), jaccard_join._verified(0.8, 5), token_store._encode_shards("x", 0), nn_descent._answer("<f4")]
    assert all(len(cloudpickle.dumps(common.lean(f))) < 100_000 for f in sent)


@pytest.mark.parametrize("hub", [1, 3, 1000])
def test_components_with_hubs(spark, monkeypatch, hub):
    from lectern.llm import components

    monkeypatch.setattr(components, "HUB", hub)
    rng = random.Random(hub)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(150)] + [(500, i) for i in range(501, 560)] + [(i, i + 1) for i in range(600, 640)] + [(559, 700), (7, 7)]
    least = {i: i for e in edges for i in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in found} == {i: r for i, r in least.items() if i != r} and len(found) == len({r["node"] for r in found})


@pytest.fixture(scope="module")
def unlike():
    """A Thue-Morse string of letters and its complement, which sums over places modulo 2**64 don't tell apart."""
    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_unlike_words_are_told_apart(spark, unlike):
    """Token ids, removed words and links of texts that differ in one such word."""
    tail = " ".join(f"w{i}" for i in range(19))
    rows = [(2 * i + j, text.format(x)) for i, text in enumerate(("see {} end", "{} " + tail)) for j, x in enumerate(unlike)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    encoder = token_store.PieceEncoder(path("byte_bpe_50k.json"))
    counts, ids = encoder.encode(*utf8(pa.array([t for _, t in rows])))
    want = encoder.direct([t for _, t in rows])
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == np.concatenate(want).tolist()
    assert not any(r["spans"] for r in substring_dedup.dedup(df).collect())
    assert {r["n_links"] for r in jaccard_join.jaccard_join(df).where("doc_id < 2").collect()} == {0}


def test_unlike_windows_of_many_bytes(spark, unlike):
    from lectern.llm.repeats import with_spans

    a, b = unlike
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["x" + a + "y", "z" + b + "q", "copy " + a[:1500], "none"])], "doc_id long, text string")
    got = with_spans(df, suffix_dedup.search("all", 1024, k=64)).mapInArrow(suffix_dedup._digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()
    rows = plain(df)
    assert {r["doc_id"]: r["kept_sha256"] for r in got} == {i: hashlib.sha256(k).hexdigest() for (i, _), k in zip(rows, removed_bytes(rows, 1024, "all"))}
