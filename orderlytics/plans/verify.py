"""Compare a registered Spark query with its DuckDB oracle: row count, column names and
types, the multiset of rows, and, of queries that sort, the sequence of their sort key."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame

from orderlytics.sources.testdata import TABLES


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


SPARK_TO_KIND = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int",
                 "double": "float", "float": "float", "string": "str", "date": "date",
                 "timestamp_ntz": "ts", "timestamp": "ts", "boolean": "bool"}
DUCK_TO_KIND = {"BIGINT": "int", "INTEGER": "int", "HUGEINT": "int", "SMALLINT": "int",
                "TINYINT": "int", "DOUBLE": "float", "FLOAT": "float", "VARCHAR": "str",
                "DATE": "date", "TIMESTAMP": "ts", "BOOLEAN": "bool"}


def _kind(t: str, table: dict) -> str:
    t = str(t)
    if t.startswith("decimal") or t.startswith("DECIMAL"):
        return "decimal"
    if t.startswith("array") or t.endswith("[]"):
        return "list"
    return table.get(t, t)


def compare(df: DataFrame, sql: str, con, sort_key: str | None = None) -> dict:
    """``sort_key``: the column by which both sides sort. Rows with equal keys may come in
    any order; the keys, NULLs among them, must come in the same."""
    spark_cols = [f.name for f in df.schema.fields]
    spark_kinds = {f.name: _kind(f.dataType.simpleString(), SPARK_TO_KIND) for f in df.schema.fields}
    rows = [tuple(_norm(v) for v in r) for r in df.collect()]
    rel = con.sql(sql)
    duck_cols = list(rel.columns)
    duck_kinds = {c: _kind(t, DUCK_TO_KIND) for c, t in zip(rel.columns, rel.types)}
    drows = [tuple(_norm(v) for v in r) for r in rel.fetchall()]
    out = {"spark_rows": len(rows), "oracle_rows": len(drows),
           "columns_match": sorted(spark_cols) == sorted(duck_cols),
           "types_match": spark_kinds == duck_kinds}
    if out["columns_match"]:
        order = sorted(spark_cols)
        si = [spark_cols.index(c) for c in order]
        di = [duck_cols.index(c) for c in order]
        a = Counter(tuple(r[i] for i in si) for r in rows)
        b = Counter(tuple(r[i] for i in di) for r in drows)
        out["values_match"] = a == b
        if a != b:
            out["only_spark"] = list((a - b).elements())[:5]
            out["only_oracle"] = list((b - a).elements())[:5]
    else:
        out["values_match"] = False
        out["spark_cols"], out["oracle_cols"] = spark_cols, duck_cols
    if not out["types_match"]:
        out["spark_types"], out["oracle_types"] = spark_kinds, duck_kinds
    out["ok"] = (out["values_match"] and out["types_match"]
                 and out["spark_rows"] == out["oracle_rows"])
    if sort_key is not None:
        i, j = spark_cols.index(sort_key), duck_cols.index(sort_key)
        out["order_match"] = [r[i] for r in rows] == [r[j] for r in drows]
        out["ok"] = out["ok"] and out["order_match"]
    return out
