"""Customers and parts connected through all order lines, against brute force."""

import numpy as np

from peakloom.plans import catalog


def test_connected_orders(spark, tmp_path):
    rng = np.random.default_rng(7)
    orders = [(i, int(rng.integers(1, 40))) for i in range(60)]
    lines = [(int(rng.integers(0, 60)), int(rng.integers(1, 60)), float(rng.integers(1, 50))) for _ in range(70)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    customer = dict(orders)
    edges = [(customer[o], p + 1000000000) for o, p, _ in lines]
    label = {n: n for e in edges for n in e}
    while True:
        was = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if was == label:
            break
    assert len(set(label.values())) > 1
    assert {tuple(r) for r in catalog.QUERIES["connected_orders"](spark, str(tmp_path)).collect()} == set(label.items())
