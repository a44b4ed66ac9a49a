"""Admission in balanced label propagation."""

from pitwise.llm import sharding


def _homes(spark, rows, room, shards):
    cells = spark.createDataFrame(rows, "group string, shard int, n long")
    return {r.group: r.home for r in sharding.propagate(cells, room, shards).collect()}


def test_refused_groups_take_their_next_label(spark):
    rows = [("a", 0, 8), ("a", 1, 2), ("b", 0, 5), ("b", 1, 1), ("b", 2, 4), ("c", 0, 3), ("c", 3, 1)]
    assert _homes(spark, rows, 100.0, 4) == {"a": 0, "b": 0, "c": 0}
    tight = _homes(spark, rows, 10.0, 4)
    assert tight == {"a": 0, "b": 2, "c": 3}


def test_shards_hold_no_more_than_their_room_while_groups_fit(spark):
    rows = [(f"g{i:03d}", s, n) for i in range(60) for s, n in ((0, 3), (1 + i % 2, 1))] + [("big", 1, 90)]
    homes = _homes(spark, rows, 70.0, 4)
    load = [sum(4 for g, h in homes.items() if h == k and g != "big") for k in range(4)]
    assert len(homes) == 61 and homes["big"] == 1 and max(load) <= 70 and sum(load) == 240
