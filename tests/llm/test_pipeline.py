"""The pipeline over the small tables: each stage against what it must leave."""

import re
import zlib

import corpus_pipeline as cp
from orderlytics.llm import scratch

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "exact_dedup", "ngram_join", "substring_dedup", "packing"]
    kept = {}
    for name, stage in cp.STAGES:
        docs = scratch.table(stage(spark, docs, DIR))
        kept[name] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    first = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    toxic = {r["doc_id"]: r["text"] for r in kept["toxicity"].collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    held = {i for i in labels if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all(i in toxic for i in first if labels.get(i) == 0 and i in held)
    groups = {}
    for i, t in toxic.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    exact = {r["doc_id"]: r["text"] for r in kept["exact_dedup"].collect()}
    assert exact.keys() == {min(g) for g in groups.values()}
    near = {r["doc_id"]: r["text"] for r in kept["ngram_join"].collect()}
    sets = {i: _shingles(t) for i, t in near.items()}
    for i in near:
        for j in near:
            if i < j and sets[i] and sets[j]:
                assert 100 * len(sets[i] & sets[j]) < 80 * len(sets[i] | sets[j])
    cut = {r["doc_id"]: r for r in kept["substring_dedup"].collect()}
    assert cut.keys() <= near.keys() and all(r["n_chars"] == len(r["text"]) for r in cut.values())
    packed = kept["packing"].collect()
    assert {r["doc_id"] for r in packed} == cut.keys()


def test_copies_with_one_id_or_none(spark):
    rows = [(1, "a  b", "en"), (1, "a b", "en"), (1, "a b", "en"), (2, "a\nb", "de"), (None, "a b", "de"), (None, "c", "x"),
            (None, "c", "x"), (3, "d", "y"), (3, "e", "y"), (4, "e", "y"), (5, None, "z"), (6, "", "z")]
    rows += [(None, "hot", "h")] * 400 + [(i, "hot", "h") for i in (9, 9, 8, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = cp.drop_copies(spark, docs, DIR)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], (r["text"] or "").split(), r["lang"]) for r in out.collect()), key=str) == sorted(
        [(1, ["a", "b"], "en"), (None, ["c"], "x"), (3, ["d"], "y"), (3, ["e"], "y"), (5, [], "z"), (8, ["hot"], "h")], key=str)


def _shingles(text):
    w = re.sub(r"[A-Z]", lambda m: m.group().lower(), text or "").encode().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
