"""Every registered query against its SQL twin, and on empty tables."""

import math

import duckdb
import pytest

import __spark_entry__
from atollkit.plans import domain, registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracles()


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)) or hasattr(x, "as_tuple"):
        return round(float(x), 6) + 0.0
    return str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for t in domain.TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    assert name in ORACLES
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, want.fetchall())


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for t in domain.TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{at}/{t}.parquet")
    return str(at)


#: Lattices over the data's box have none without data.
NEED_DATA = {"gr4_hex_grid_pointy", "gr5_hex_grid_flat", "gr6_square_grid", "gr7_make_grid"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - NEED_DATA))
def test_on_empty_tables(spark, nothing, name):
    if name in ("io1_read_table", "io6_write_and_append"):
        pytest.skip("nothing to append is an error")
    one = {"cr8_geom_kind", "gr16_import_grid_checks", "gr16_import_grid_envelope"}  # one row however little there is
    assert QUERIES[name](spark, nothing).count() == (name in one)


@pytest.mark.parametrize("name", ["cr1_ease_area", "cr2_ease2_area", "cr3_albers_round_trip", "cr4_split_at_dateline", "fe6_amounts_metric"])
def test_latitudes_stay_on_the_globe(spark, duck, name):
    """At a scale where the boxes climb beyond 90 rows."""
    at = SF.replace("sf0.001", "sf0.01")
    c = duckdb.connect()
    for t in domain.TABLES:
        c.execute(f"create view {t} as select * from '{at}/{t}.parquet'")
    df, want = QUERIES[name](spark, at), c.execute(ORACLES[name])
    assert rows(df.columns, df.collect()) == rows([x[0] for x in want.description], want.fetchall())


def test_without_training_operators(spark, monkeypatch):
    """Where their folder is gone, so are their queries and the pipeline, and nothing else."""
    import importlib.util

    found = importlib.util.find_spec
    monkeypatch.setattr(__spark_entry__.importlib.util, "find_spec", lambda name: None if name == "atollkit.llm" else found(name))
    assert set(__spark_entry__.queries()) == set(QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(ORACLES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
