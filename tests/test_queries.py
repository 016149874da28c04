"""Named queries against their SQL twins on the smallest tables."""

import duckdb
import pytest

from driftmesh.plans.catalogue import QUERIES
from driftmesh.plans.oracles import ORACLES

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
SOME = [
    "load_samples", "dataset_stats", "grid_extent", "box_filter_reset", "interpolate_gaps", "pad_paths", "compress_path", "verify_path", "heading_distance", "levels", "rollup_shift",
    "cell_centres", "unique_cells", "enumerate", "morton_codes", "timeslice_counts", "closed_itemsets", "maximal_itemsets", "viewport_polylines", "sweep_feasible", "sweep_batches", "dat_roundtrip", "emp_text", "dat_file", "csv_file", "unq_file", "map_file", "print_dataset", "rotated_points", "support_order",
]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def values(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(str(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", SOME)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    expected = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert values(got.collect(), got.columns) == values(expected.fetchall(), expected.columns)


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
