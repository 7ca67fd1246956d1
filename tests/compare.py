"""Run registered queries beside their SQL twins.

    python tests/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


SAME_TYPE = {"int": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT", "double": "DOUBLE",
             "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
             "timestamp_ntz": "TIMESTAMP"}


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v, digits=None):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if digits is not None:
            v = float(f"{v:.{digits}g}")
        return v + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return datetime.datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, digits) for x in v)
    return v


def rows_of(cols, rows, digits):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    out = [tuple(norm(r[k], digits) for k in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark_df, con, sql):
    """'EXACT', 'CLOSE' or a message saying what differs."""
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    scols, srows = spark_df.columns, [tuple(r) for r in spark_df.collect()]
    if sorted(scols) != sorted(dcols):
        return f"COLUMNS spark={sorted(scols)} duck={sorted(dcols)}"
    if len(srows) != len(drows):
        return f"ROWS spark={len(srows)} duck={len(drows)}"
    stypes = dict(spark_df.dtypes)
    dtypes = {r[0]: str(r[1]) for r in con.execute("DESCRIBE " + sql).fetchall()}
    for c in scols:
        if SAME_TYPE.get(stypes[c]) != dtypes[c]:
            return f"TYPE {c}: spark={stypes[c]} duck={dtypes[c]}"
    for digits, word in ((None, "EXACT"), (9, "CLOSE")):
        a, b = rows_of(scols, srows, digits), rows_of(dcols, drows, digits)
        if a == b:
            return word
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    cols = sorted(scols)
    first = [(c, p, q) for c, p, q in zip(cols, *bad[0]) if p != q]
    return f"VALUES {len(bad)}/{len(a)} differ; first {first[:3]} in row {bad[0][0][:6]}"


if __name__ == "__main__":
    args = [a for a in sys.argv[1:]]
    sf = "0.01"
    if "--sf" in args:
        k = args.index("--sf")
        sf = args[k + 1]
        del args[k:k + 2]
    from tillwise.session import get_session
    import __spark_entry__ as entry

    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8",
                                              "spark.ui.enabled": "false",
                                              "spark.ui.showConsoleProgress": "false",
                                              "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/sf{sf}"
    con, q, o = duck(folder), entry.queries(), entry.oracle_sql()
    names = [n for n in q if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1]))
                                             for a in args)]
    bad = 0
    for n in names:
        t = time.time()
        try:
            if n in o:
                word = compare(q[n](spark, folder), con, o[n])
            else:
                word = f"ROWSONLY {q[n](spark, folder).count()}"
        except Exception as e:  # noqa: BLE001
            word = "ERROR " + str(e).strip()[:600]
        bad += not word.startswith(("EXACT", "ROWSONLY"))
        print(f"{n:34s} {time.time() - t:6.2f}s {word}", flush=True)
    print(f"{len(names)} queries, {bad} not exact")
