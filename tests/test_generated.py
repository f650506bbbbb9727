"""Scans of the generated repositories against SQL over the table they are made from."""

from pathlib import Path

import duckdb
import pytest

from repolens.plans import generated


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(generated.QUERIES))
def test_scan_finds_what_the_arithmetic_says(spark, sf_dir, name):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = generated.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    want = con.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({generated.SQL[name]})").fetchall()
    got = [tuple(r) for r in found.select(*columns).collect()]
    assert sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(map(plain, r)) for r in want) and got
