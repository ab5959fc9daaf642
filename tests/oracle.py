"""Rows of a query in Spark and of its SQL in DuckDB, made comparable."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(cols, data):
    order = sorted(cols)
    at = [cols.index(c) for c in order]
    return order, sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at) for r in map(tuple, data)), key=repr)


def of_spark(df):
    return rows(df.columns, df.collect())


def of_sql(sql, sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cur = c.execute(sql)
    return rows([x[0] for x in cur.description], cur.fetchall())
