"""A query's rows beside those of its SQL in DuckDB, on the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _normal(pdf):
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf:
        if pdf[c].dtype == float:
            pdf[c] = pdf[c].round(6) + 0.0
    return pdf.astype(str).sort_values(list(pdf.columns)).reset_index(drop=True)


def assert_same(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    mine, theirs = _normal(query(spark, sf_dir).toPandas()), _normal(con.sql(sql).df())
    assert list(mine.columns) == list(theirs.columns) and len(mine) == len(theirs)
    assert mine.equals(theirs), (mine[(mine != theirs).any(axis=1)].head(), theirs[(mine != theirs).any(axis=1)].head())
