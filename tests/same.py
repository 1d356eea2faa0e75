"""Compares the rows of a Spark frame with those of SQL in DuckDB, regardless of order."""


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(repr([_plain(v) for v in r]) for r in df.select(*cols).collect())


def same_rows(df, con, sql):
    cols, got = rows_of(df)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    want = sorted(repr([_plain(v) for v in r]) for r in rel.select(*cols).fetchall())
    assert got == want
