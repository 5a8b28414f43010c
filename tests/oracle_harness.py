"""Local stand-in for the driver's correctness gate: run a registered Spark
query and its DuckDB oracle on the same parquet folder and compare row
count, column names and an order-insensitive value hash."""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(data_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    norm = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(norm).encode()).hexdigest(), norm


def compare(spark, name, data_dir, con=None):
    from __spark_entry__ import oracle_sql, queries
    q = queries()[name]
    sql = oracle_sql().get(name)
    t0 = time.time()
    sdf = q(spark, data_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    ts = time.time() - t0
    if sql is None:
        return {"name": name, "rows": len(srows), "oracle": None, "spark_s": round(ts, 2)}
    con = con or duck(data_dir)
    t0 = time.time()
    res = con.sql(sql)
    dcols = res.columns
    drows = res.fetchall()
    td = time.time() - t0
    hs, ns = digest(scols, srows)
    hd, nd = digest(dcols, drows)
    ok = sorted(scols) == sorted(dcols) and len(srows) == len(drows) and hs == hd
    out = {"name": name, "ok": ok, "rows": len(srows), "oracle_rows": len(drows),
           "cols_equal": sorted(scols) == sorted(dcols), "hash_equal": hs == hd,
           "spark_s": round(ts, 2), "duck_s": round(td, 2)}
    if not ok:
        out["scols"], out["dcols"] = scols, dcols
        a, b = set(ns), set(nd)
        out["only_spark"] = sorted(a - b)[:3]
        out["only_duck"] = sorted(b - a)[:3]
    return out


def main(argv):
    sys.path.insert(0, ".")
    from topicflow.session import get_spark
    from __spark_entry__ import queries
    data_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or sorted(queries())
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck(data_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, data_dir, con)
        except Exception as e:  # report and continue
            r = {"name": n, "error": repr(e)[:600]}
        if r.get("ok") is False or "error" in r:
            bad += 1
        print(r, flush=True)
    print("BAD", bad)


if __name__ == "__main__":
    main(sys.argv)
