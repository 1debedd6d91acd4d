"""Run registered queries and their check SQL side by side: ``python -m catalog.compare [prefix ...]``."""
from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

from palaver.session import SINGLE_NODE, build_session


def canonical(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def main(argv: list[str]) -> int:
    import catalog

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("compare", "local[8]", 8, SINGLE_NODE)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    failed = []
    for name, query in catalog.QUERIES.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            got = [tuple(r) for r in df.collect()]
            spent = time.time() - start
            sql = catalog.ORACLES.get(name)
            if sql is None:
                print(f"{name:45s} rows={len(got)} {spent:.1f}s (rows only)", flush=True)
                continue
            start = time.time()
            ref = con.execute(sql)
            cols = [d[0] for d in ref.description]
            want = ref.fetchall()
            duck = time.time() - start
            kinds = {c: t for c, t in df.dtypes}
            duck_kinds = {d[0]: str(d[1]) for d in ref.description}
            same = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
            odd = [f"{c}:{kinds.get(c)}/{duck_kinds[c]}" for c in cols
                   if same.get(kinds.get(c), kinds.get(c)) != duck_kinds[c]]
            a, b = rows_of(df.columns, got), rows_of(cols, want)
            ok = sorted(df.columns) == sorted(cols) and a == b
            print(f"{name:45s} {'ok' if ok else 'DIFF'} rows={len(got)}/{len(want)} {spent:.1f}s duck={duck:.1f}s "
                  f"{'types ' + ','.join(odd) if odd else ''}", flush=True)
            if not ok:
                failed.append(name)
                print("   cols", sorted(df.columns), sorted(cols))
                print("   spark only", list(set(a) - set(b))[:2])
                print("   duck only ", list(set(b) - set(a))[:2])
        except Exception as e:  # noqa: BLE001
            failed.append(name)
            print(f"{name:45s} ERROR {str(e)[:900]}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
