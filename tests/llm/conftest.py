import duckdb
import pytest


@pytest.fixture
def against_sql():
    """Rows of a query and of its check SQL over the same folder, both sorted."""
    def both(df, sql, root):
        con = duckdb.connect()
        for name in ("documents", "embeddings", "labels", "benchmark"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
        result = con.execute(sql)
        names = sorted(d[0] for d in result.description)
        at = [[d[0] for d in result.description].index(n) for n in names]
        return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr), sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=repr)
    return both
