"""Spark rows against the rows of a SQL string."""


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return float(value)
    return value.item() if hasattr(value, "item") else str(value) if not isinstance(value, int | bool | str) else value


def same_rows(frame, con, sql):
    """Compare a Spark frame with the rows of a SQL string, columns by name, rows in any order."""
    got = [tuple(plain(r[c]) for c in sorted(frame.columns)) for r in frame.collect()]
    cursor = con.execute(sql)
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    order = [names.index(c) for c in sorted(names)]
    want = [tuple(plain(r[i]) for i in order) for r in cursor.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    norm = lambda rows: sorted([tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r) for r in rows], key=key)
    assert norm(got) == norm(want)
