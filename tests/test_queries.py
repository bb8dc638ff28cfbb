"""Queries against their DuckDB SQL on the smallest tables; the entry point."""

from __future__ import annotations

import itertools
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(v[k] for k in order)) for v in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_gibberish_at_its_limits(spark, tmp_path):
    """Mean ratios of 0.8 but for rounding, and white space that only Python knows where the entropy's band ends."""
    tied = ["bcdfghjaei", "bcdf", "bcdae", "bcdfghjkla"]
    more = ["bcdfghjka", "bcdfga", "bcdfghjklmnpbcdfghjklmnpbcdfaeiouaeiouaeiouae", "bcdfghjklmnaeio", "bcdfga", "bcdfghjka"]
    docs = [" ".join(w) for ws in (tied, more) for w in itertools.permutations(ws)]
    docs += [space.join(["abcd", "efab", "cdef", "abcd", "efab", "cdef"]) for space in " \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u2003\u2028\u3000"] + ["", None]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLES["gibberish"]).fetchall()
    found = {i for i, _ in want if i >= 0}
    for part in (range(24), range(24, 744), range(744, len(docs))):  # both outcomes of each kind
        assert 0 < len(found.intersection(part)) < len(part)
    assert sorted(map(tuple, QUERIES["gibberish"](spark, str(tmp_path)).collect())) == sorted(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
