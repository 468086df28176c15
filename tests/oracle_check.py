"""Run registered queries in Spark and their oracle SQL in DuckDB; compare
row counts, column names and the multiset of row values.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir).toPandas()
    t1 = time.time()
    if sql is None:
        return dict(name=name, ok=None, rows=len(sdf), spark_s=round(t1 - t0, 2))
    ddf = con.execute(sql).fetchdf()
    t2 = time.time()
    sc, sr = rows_of(sdf)
    dc, dr = rows_of(ddf)
    ok = sc == dc and len(sr) == len(dr) and sr == dr
    info = dict(name=name, ok=ok, rows=len(sr), oracle_rows=len(dr), spark_s=round(t1 - t0, 2),
                duck_s=round(t2 - t1, 2))
    if not ok:
        info["cols"] = (sc, dc)
        if sc == dc:
            diff = [r for r in sr if r not in set(dr)][:3]
            diff2 = [r for r in dr if r not in set(sr)][:3]
            info["spark_only"] = diff
            info["oracle_only"] = diff2
    return info


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    import __spark_entry__ as E
    from rankforge.session import get_session
    spark = get_session("local[8]", 8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        try:
            info = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as exc:  # report and go on
            info = dict(name=name, ok=False, error=str(exc)[:400])
        bad += info.get("ok") is False
        print(str(info)[:1500], flush=True)
    print("FAILED" if bad else "ALL OK", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
