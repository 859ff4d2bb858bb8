"""What tests share."""

import os

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    """A value as both engines would write it."""
    import datetime
    import math

    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def same_rows(df, duck, sql):
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = sorted((tuple(map(plain, r)) for r in duck.execute(f"SELECT {quoted} FROM ({sql})").fetchall()), key=repr)
    assert got == want
