"""Helpers that operators share."""

import pytest

from docweave.llm.shared import fresh, shared_dir, spread_join


def test_spread_join_is_a_join(spark):
    large = [(i, i % 3 if i < 900 else i) for i in range(1000)] + [(5, None)]
    small = [(k, f"v{k}") for k in (0, 1, 7, 950)] + [(0, "again"), (None, "none")]
    a, b = spark.createDataFrame(large, "i int, k int"), spark.createDataFrame(small, "k int, v string")
    want = sorted((k, i, v) for i, k in large for q, v in small if k is not None and k == q)
    for share in (1, 50, 10_000):
        got = spread_join(a, b, "k", ["i"], share).select("k", "i", "v")
        assert sorted(tuple(r) for r in got.collect()) == want


def test_fresh_names():
    assert fresh("a", ["b"]) == "a" and fresh("a", ["A", "a_"]) == "a__"


def test_no_machine_local_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        shared_dir(Session)
