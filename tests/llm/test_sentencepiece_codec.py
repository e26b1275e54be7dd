import random
import zlib

import numpy as np
import public_tokenizers as P
import sentencepiece

from orderlytics.llm import registry, sentencepiece_codec as codec

PATH = P.path("piece_bpe_32k.model")


def texts():
    rng = random.Random(4)
    out = [None, "", " ", "  ", "a", " a b ", "Hello  world\n\tx ﬁ é <s>", "\U0001f600 \x00b<0x41>", "aaaaaaaaaaaaaaa",
           "▁▁x", "x" * 3000, "the the the", "ababababab", "   lead", "trail   ", "日本語"]
    abc = "abcdeinorst .,\néü0123ABC-"
    out += ["".join(rng.choice(abc) for _ in range(rng.randrange(60))) for _ in range(300)]
    return out


def test_same_ids_as_the_processor(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = list(enumerate(texts())) + [(None, "again"), (3, "  ")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    out = codec.encode(df, PATH)
    got = sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist(), r["n_tokens"]) for r in out.collect())
    want = [model.encode(t) if t else [] for _, t in rows]
    assert got == sorted((str(i), w, len(w)) for (i, _), w in zip(rows, want))
    back = {r["doc_id"]: r["text"] for r in codec.decode(out, PATH, ["doc_id"]).collect()}
    for i, t in rows:
        assert back[i] == (t or "").replace("▁", " ")  # the mark stands for a blank
    assert codec.encode(df.limit(0), PATH).collect() == []


def test_query(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in registry.op1_sentencepiece(spark, "/root/testdata/sf0.001").collect():
        t = docs[r["doc_id"]] or ""
        assert r["ids_crc32"] == zlib.crc32(np.array(model.encode(t), "<u4").tobytes())
        assert r["decoded_crc32"] == zlib.crc32(t.encode()) and r["decoded_chars"] == len(t)


def test_words_are_encoded_together():
    rng = random.Random(7)
    words = ["▁the", "▁▁x", "▁\U0001f600a\x00\x07", "\n\n▁▁▁", "▁é日\U0001f600\U0001f601", "▁internationalization", "▁" + "ab" * 200]
    words += ["▁" + "".join(rng.choice("abcdeinorst\x01é日\U0001f600") for _ in range(rng.randrange(1, 30))) for _ in range(500)]
    p = codec.load(PATH)
    names, ranks = codec._ids(p), codec._ranks(p)
    got = codec.encode_words(p, words)
    assert len(got) == len(words)
    for word, ids in zip(words, got):
        by_the_book = codec.merge(list(word), ranks)
        want = [i for s, _ in by_the_book for i in ([names[s]] if s in names else p.byte[list(s.encode())].tolist())]
        assert np.frombuffer(ids, "<u4").tolist() == want


def test_pairs_are_found_by_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 30, 5000))
    table, held = codec.hashed(keys, keys + 1)
    assert (codec.look_up(table, held, keys) == keys + 1).all()
    others = np.setdiff1d(rng.integers(0, 1 << 30, 20000), keys)
    assert (codec.look_up(table, held, others) == 1 << 60).all()
    none = codec.hashed(keys[:0], keys[:0])
    assert (codec.look_up(*none, keys) == 1 << 60).all()


def test_decodes_odd_ids(spark):
    p = codec.load(PATH)
    a, the = codec._ids(p)["a"], codec._ids(p)["▁the"]
    rows = [(1, [the, the]), (2, []), (3, None), (4, [int(p.byte[0xFF]), a]), (5, [int(p.byte[32]), the]), (6, [1, the, a]), (7, [the])]
    rows = [(i, None if x is None else bytearray(np.array(x, "<u4").tobytes())) for i, x in rows]
    want = {1: "the the", 2: "", 3: None, 4: "\ufffda", 5: " the", 6: "thea", 7: "the"}
    for some in (rows, [r for r in rows if r[0] not in (4, 6)], rows[1:3]):
        df = spark.createDataFrame(some, "doc_id long, ids binary").coalesce(1)
        assert {r["doc_id"]: r["text"] for r in codec.decode(df, PATH, ["doc_id"]).collect()} == {i: want[i] for i, _ in some}
