"""Runs a query and its SQL over the same tables and compares rows without regard to order."""

import math
from decimal import Decimal
from pathlib import Path


def views(folder):
    import duckdb

    con = duckdb.connect()
    for f in sorted(Path(folder).glob("*.parquet")):
        src = f"{f}/*.parquet" if f.is_dir() else str(f)
        con.execute(f"create view {f.stem} as select * from read_parquet('{src}')")
    return con


def plain(x):
    if isinstance(x, (float, Decimal)):
        return "nan" if math.isnan(x) else round(float(x), 6) + 0.0
    return x


def rows(names, got):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(repr(plain(r[i])) for i in order) for r in got])


def differences(spark, folder, query, sql):
    """None if equal, else a short text."""
    df = query(spark, folder)
    a = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = views(folder).execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    b = rows(names, rel.fetchall())
    if a == b:
        return None
    only_a, only_b = [x for x in a if x not in set(b)], [x for x in b if x not in set(a)]
    return f"{len(a)} and {len(b)} rows; only here {only_a[:3]}; only in SQL {only_b[:3]}"
