"""Compare a query with its SQL in DuckDB over the same tables."""

import datetime as dt
import decimal
import os

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def there() -> bool:
    return os.path.isdir(FOLDER)


def plain(x):
    if isinstance(x, float):
        return None if x != x else float(f"{x:.9g}")
    if isinstance(x, decimal.Decimal):
        return float(f"{float(x):.9g}")
    if isinstance(x, list | tuple):
        return [plain(y) for y in x]
    return str(x) if isinstance(x, dt.datetime | dt.date) else x


def compare(spark, run, sql):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{FOLDER}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = run(spark, FOLDER)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    found = con.execute(sql)
    order = [[c[0] for c in found.description].index(c) for c in names]
    assert len(order) == len(found.description)
    assert got == sorted(repr([plain(r[i]) for i in order]) for r in found.fetchall())
