"""Groups of small cells, read from files and merged step by step, against their SQL twins."""

import duckdb
import pytest

from driftmesh.plans.catalogue import QUERIES
from driftmesh.plans.oracles import ORACLES
from tests.test_queries import values

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["group_nc", "group_wc", "group_attachment", "group_attachment_by_id", "group_both", "group_both_symmetric", "grp_file", "merged_members"])
def test_twin(spark, name):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{FOLDER}/events.parquet'")
    got, expected = QUERIES[name](spark, FOLDER), duck.sql(ORACLES[name])
    found = values(got.collect(), got.columns)
    assert found == values(expected.fetchall(), expected.columns) and len(found) > 5
