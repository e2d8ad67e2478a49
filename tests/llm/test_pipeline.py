"""The pipeline's stages against plain versions, on the smallest tables."""

from collections import Counter

import corpus_pipeline
from test_operators import WORD, gram_set, path, removed_bytes

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(90_001, None, "en", "src1", 0), (90_002, "12 34", "en", None, 5), (90_003, "", None, None, 0)], docs.schema)
    docs = docs.unionByName(odd)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    columns, frames = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        frames[name] = docs.collect()
        if name != names[-1]:
            assert docs.columns == columns
    language = {r["doc_id"]: r["text"] for r in frames[names[0]]}
    assert not {90_001, 90_002, 90_003} & set(language) and len(language) == spark.read.parquet(f"{SF}/documents.parquet").count()
    sets = {i: gram_set(t) for i, t in language.items()}
    parent = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] & sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = a, b
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                parent[max(x, y)] = min(x, y)
    near = {r["doc_id"]: r["text"] for r in frames[names[1]]}
    assert set(near) == {i for i in parent if parent[i] == i} and len(near) == len(frames[names[1]])
    rows = sorted(near.items())
    cut = {r["doc_id"]: r for r in frames[names[2]]}
    assert {i: cut[i]["text"] for i in near} == {i: k.decode("utf-8", "ignore") for (i, _), k in zip(rows, removed_bytes(rows, 200, "later"))}
    assert all(len(r["text"]) == r["n_chars"] for r in cut.values())
    sizes = Counter()
    for r in cut.values():
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    mixed = Counter()
    for r in frames[names[3]]:
        mixed[r["source"]] += len(WORD.findall(r["text"]))
    assert abs(sum(mixed.values()) - sum(sizes.values())) <= 2 * len(sizes) and all(mixed[s] <= 3 * sizes[s] for s in sizes)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = Counter((r["doc_id"], tuple(tokenizer.encode(r["text"], add_special_tokens=False).ids)) for r in frames[names[3]])
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in frames[names[4]]) == want


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and out.count() > 0


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(__spark_entry__.oracle_sql()) <= set(names)
