"""Runs queries on Spark and DuckDB and compares their rows; also a small command line tool."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(cores: str = "8", **conf):
    from pyspark.sql import SparkSession

    b = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8")
    b = b.config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
    b = b.config("spark.ui.showConsoleProgress", "false")
    for k, v in conf.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, dict):
        return tuple(sorted((k, _cell(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _cell(x)) for k, x in v.asDict().items()))
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p}/*.parquet')" if Path(p).is_dir() else f"create view {t} as select * from read_parquet('{p}')")
    return con


def _kind(name: str) -> str:
    name = name.lower().split("(")[0]
    if name in ("bigint", "int", "integer", "long", "smallint", "tinyint"):
        return "int"
    return {"float": "double", "varchar": "string", "bool": "boolean"}.get(name, name)


def differences(df, sql: str, sf_dir: str) -> str:
    """Empty when both give the same rows."""
    cur = duck(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    want, got = bag(names, cur.fetchall()), bag(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    theirs = {d[0]: _kind(str(d[1])) for d in cur.description}
    kinds = [(c, t, theirs[c]) for c, t in df.dtypes if _kind(t) != theirs[c] and "timestamp" not in t]
    if kinds:
        return f"types {kinds}"
    if want == got:
        return ""
    return f"{sum(got.values())} rows against {sum(want.values())}; only Spark {list((got - want).items())[:2]}; only DuckDB {list((want - got).items())[:2]}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as e

    d = sys.argv[1]
    spark = session()
    q, o = e.queries(), e.oracle_sql()
    for name in [x for x in q if not sys.argv[2:] or any(x.startswith(a) for a in sys.argv[2:])]:
        t = time.time()
        try:
            said = differences(q[name](spark, d), o[name], d) if name in o else f"no oracle, {q[name](spark, d).count()} rows"
        except Exception as x:  # noqa: BLE001
            said = f"ERROR {str(x)[:1500]}"
        print(f"{time.time() - t:6.1f} {name} {'ok' if not said else said}", flush=True)
