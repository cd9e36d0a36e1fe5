"""Comparing Spark rows with DuckDB's, in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        return None if v is None or v != v else round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=lambda r: tuple((x is not None, str(x)) for x in r))


def same(df, con, sql):
    got, want = df.collect(), con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())
