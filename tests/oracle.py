"""Rows of a query beside those of its SQL, which another engine runs on the same files."""

import math
import os
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The tables that the comparisons run on.
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    """A value that compares equal in both engines: numbers as floats of 9 digits, lists as tuples."""
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    return value


def spark_rows(frame):
    names = sorted(frame.columns)
    return names, Counter(tuple(plain(row[c]) for c in names) for row in frame.collect())


def sql_rows(sql, sf_dir):
    with duckdb.connect() as db:
        for name in TABLES:
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
        result = db.execute(sql)
        columns = [d[0] for d in result.description]
        order = sorted(range(len(columns)), key=columns.__getitem__)
        return [columns[i] for i in order], Counter(tuple(plain(row[i]) for i in order) for row in result.fetchall())


def assert_alike(frame, sql, sf_dir):
    (got_names, got), (names, rows) = spark_rows(frame), sql_rows(sql, sf_dir)
    assert got_names == names
    assert got == rows, (list((got - rows).items())[:3], list((rows - got).items())[:3])
