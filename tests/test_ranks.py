"""Places and quantiles by sorted ranges against plain sorting."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossweave.functions.ranks import placed, quantiles
from crossweave.operators.vectors import similarity_quantiles


def test_places_in_groups_larger_than_a_range(spark):
    r = random.Random(1)
    rows = [(r.choice(["big"] * 8 + ["small", None]), r.randint(0, 50), k) for k in range(2000)]
    got = placed(spark.createDataFrame(rows, "g string, v int, id long"), "g", [F.desc("v"), F.asc("id")])
    assert got.columns == ["g", "v", "id", "place"]
    want = []
    for g in {row[0] for row in rows}:
        own = sorted((row for row in rows if row[0] == g), key=lambda x: (-x[1], x[2]))
        want += [(*row, k) for k, row in enumerate(own, 1)]
    assert sorted(map(tuple, got.collect()), key=lambda x: x[2]) == sorted(want, key=lambda x: x[2])


@pytest.mark.parametrize("n", [1, 2, 3, 100, 5001])
def test_quantiles_with_many_ties(spark, n):
    r = random.Random(n)
    values = [r.choice([0.25, -1.5, r.random()]) for _ in range(n)]
    marks = [0.0, 0.1, 0.5, 0.99, 1.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got = {row["mark"]: row["value"] for row in quantiles(df, "x", marks).collect()}
    assert sorted(got) == marks
    assert np.allclose([got[m] for m in marks], np.quantile(values, marks), rtol=0, atol=1e-12)


def test_no_scores_give_a_row_of_nulls(spark):
    row = similarity_quantiles(spark.createDataFrame([], "relevance double")).collect()
    assert len(row) == 1 and set(row[0].asDict().values()) == {None}
