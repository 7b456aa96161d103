"""Compare registered queries with their oracle in DuckDB: python tests/check.py [-s sf] [name-prefix ...]"""

import datetime
import decimal
import sys
import time
import traceback
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def session(cores=8, **conf):
    b = (SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "8g").config("spark.log.level", "ERROR").config("spark.ui.showConsoleProgress", "false"))
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def duck(path):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    rows = [tuple(r) for r in df.collect()]
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    other = rel.fetchall()
    if sorted(df.columns) != sorted(names):
        return len(rows), f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = bag(df.columns, rows), bag(names, other)
    if a != b:
        l, r = list((a - b).items())[:4], list((b - a).items())[:4]
        return len(rows), f"rows {len(rows)} vs {len(other)}; {sum((a-b).values())} differ\n   spark {l}\n   duck  {r}"
    return len(rows), None


def main(argv):
    sf = "0.01"
    if argv[:1] == ["-s"]:
        sf, argv = argv[1], argv[2:]
    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    spark, path = session(), f"/root/testdata/sf{sf}"
    con, bad = duck(path), []
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in queries:
        if argv and not any(name.startswith(p) for p in argv):
            continue
        start = time.time()
        try:
            df = queries[name](spark, path)
            if name in sql:
                n, err = compare(df, con, sql[name])
            else:
                n, err = len(df.collect()), None
        except Exception as e:
            n, err = -1, "".join(traceback.format_exception_only(e))[:700]
        mark = "ok " if err is None else "BAD"
        kind = "sql " if name in sql else "rows"
        print(f"{mark} {kind} {name:38} {n:7} rows {time.time()-start:6.2f}s {err or ''}", flush=True)
        if err:
            bad.append(name)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main(sys.argv[1:])
