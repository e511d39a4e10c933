"""Run registered queries and their SQL side by side: python tests/compare.py [sf_dir] [names...]"""

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as E  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), na_position="first").reset_index(drop=True)


def difference(spark_frame, con, sql):
    """None when both agree, else a short text."""
    a, b = canonical(spark_frame.toPandas()), canonical(con.execute(sql).df())
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} / {list(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    for c in a.columns:
        x, y = a[c], b[c]
        if x.dtype != y.dtype and not (x.dtype == object or y.dtype == object or "str" in str(x.dtype) + str(y.dtype)):
            if not (x.isna().any() or y.isna().any()):
                return f"type of {c}: {x.dtype} / {y.dtype}"
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            i = int(np.argmin(same.to_numpy()))
            return f"{(~same).sum()} of {len(a)} differ in {c}: {a.iloc[i].to_dict()} / {b.iloc[i].to_dict()}"
    return None


def main(sf_dir, names):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = E.oracle_sql()
    for name, query in E.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            frame = query(spark, sf_dir)
            rows = frame.count() if name not in sqls else None
            t1 = time.time()
            note = f"rows only: {rows}" if name not in sqls else difference(frame, con, sqls[name]) or "ok"
        except Exception as error:  # noqa: BLE001
            t1 = time.time()
            note = "ERROR " + str(error)[:900]
        print(f"{name:28s} {t1 - t:6.1f}s +{time.time() - t1:6.1f}s  {note}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:])
