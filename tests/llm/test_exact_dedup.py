import hashlib
import re

from orderlytics.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, norm string, sha string, salt int"


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for norm, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda x: (x is None, x or 0))):
            out.append((i, keep, len(ids), k == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", None, 1) for i, t in rows], SCHEMA)
    out = exact_dedup(df, **kw)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


AWKWARD = [(5, "a b"), (3, "a \t\n b"), (9, "a\x0bb"), (1, None), (2, ""), (4, "  "), (6, " "),
           (7, "A b"), (8, "a\xa0b"), (None, "a b"), (None, "alone"), (10, "ä" * 70_000),
           (11, "ä" * 70_000), (12, "ä" * 69_999), (5, "a b"), (13, "alone"), (14, "\r\n")]


def test_awkward_rows(spark):
    assert run(spark, AWKWARD) == expected(AWKWARD)


def test_hot_groups_are_cut_and_put_together(spark):
    rows = AWKWARD + [(100 + i, "hot  text" if i % 3 else "other hot text") for i in range(900)]
    assert run(spark, rows, least_hot=5) == expected(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
