"""Interpolated orders of all customers against a loop."""

import datetime

from driftmesh.plans.catalogue import QUERIES

ORDERS = [(1, 5, 0, 1500.0, "1-URGENT"), (2, 5, 4, 9800.0, "5-LOW"), (3, 61, 2, 100.0, "2-HIGH"), (4, 61, 5, 30500.0, "3-MEDIUM"), (5, 1500, 9, 7000.0, "4-NOT SPECIFIED")]


def brute(orders):
    made = []
    for k, customer in enumerate(sorted({o[1] for o in orders})):
        path = sorted((day, key, int(price // 1000), int(level[0])) for key, c, day, price, level in orders if c == customer)
        for n, (t, _, x, y) in enumerate(path):
            if n:
                t0, _, x0, y0 = path[n - 1]
                made += [(k, x0 + int(i * (x - x0) / (t - t0)), y0 + int(i * (y - y0) / (t - t0)), t0 + i + 1) for i in range(t - t0 - 1)]
            made.append((k, x, y, t))
    return sorted(made)


def test_all_customers(spark, tmp_path):
    day = datetime.date(1995, 1, 1)
    rows = [(key, c, day + datetime.timedelta(d), price, level) for key, c, d, price, level in ORDERS]
    names = "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double, o_orderpriority string"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["interpolate_orders"](spark, str(tmp_path)).select("trajectory_idx", "x", "y", "t").collect()
    assert sorted(map(tuple, got)) == brute(ORDERS)
