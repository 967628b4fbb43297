"""Results of Spark and of SQL in one shape: columns in order of name, rows sorted."""


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def rows_of(df):
    """Columns in order of name, and the rows sorted."""
    columns = sorted(df.columns)
    return columns, sorted((tuple(_plain(v) for v in r) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=repr)


def rows_of_sql(con, sql):
    columns = sorted(con.sql(sql).columns)
    names = ", ".join(f'"{c}"' for c in columns)
    return columns, sorted((tuple(_plain(v) for v in r) for r in con.sql(f"SELECT {names} FROM ({sql})").fetchall()), key=repr)
