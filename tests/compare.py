"""A query's rows against its SQL's: columns by name, rows in any order, floats alike to nine digits."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


class Near:
    """A float that equals those within a relative 1e-9."""

    def __init__(self, value):
        self.value = value

    def __eq__(self, other):
        return isinstance(other, Near) and (math.isclose(self.value, other.value, rel_tol=1e-9, abs_tol=1e-12) or self.value != self.value and other.value != other.value)

    def __repr__(self):
        return repr(self.value)


def plain(x):
    """What is compared: whole numbers and all else as text, floats as they are."""
    if isinstance(x, bool) or x is None:
        return repr(x)
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return Near(float(x)) if float(x) != int(x) else f"{float(x):.5f}"
    if isinstance(x, int):
        return f"{x:.5f}" if abs(x) < 2**53 else str(x)
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    told = [tuple(plain(r[i]) for i in order) for r in data]
    # Rows are lined up by what is exact, then by their floats.
    key = lambda r: ([x for x in r if not isinstance(x, Near)], [x.value for x in r if isinstance(x, Near)])
    return [columns[i] for i in order], sorted(told, key=key)


def compare(df, con, sql):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    out = con.execute(sql)
    want = rows([d[0] for d in out.description], out.fetchall())
    return got, want
