"""Batches that close on rows or on distinct values, against one scan of all rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from loglathe.operators import saturation


def scanned(rows, most, values, shrink):
    out, batch, n, seen, full = [], 0, 0, (set(), set()), False
    for row in rows:
        over = not (shrink and full) and any(len(s | {v}) > values for s, v in zip(seen, row, strict=True))
        if n == most or over:
            if n < most and shrink and not full:
                full, most = True, values - values // 32
            batch, n, seen = batch + 1, 0, (set(), set())
        n += 1
        seen[0].add(row[0])
        seen[1].add(row[1])
        out.append(batch)
    return out


@pytest.mark.parametrize(("most", "values"), [(10, 4), (64, 40)])
@pytest.mark.parametrize("producer", [None, "p"])
def test_against_a_scan(spark, producer, most, values):
    rng = random.Random(most)
    data = [(k + 1, rng.choice(["a", "hot", "hot", None]), f"r{min(rng.randrange(60), rng.randrange(60))}", rng.choice([None, *(f"e{x}" for x in range(80))]), "kept") for k in range(600)]
    df = spark.createDataFrame(data, "sequence long, p string, resource string, endpoint string, batch_id string").repartition(5)
    for shrink in (False, True):
        out = saturation.dynamic_batches(df, most, values, producer=producer, shrink=shrink, range_rows=64, fan=3)
        assert out.columns == df.columns
        got = out.collect()
        assert len(got) == len(data)
        for p in ["a", "hot", None] if producer else ["all"]:
            mine = [d for d in data if p == "all" or d[1] == p]
            want = dict(zip((d[0] for d in mine), scanned([d[2:4] for d in mine], most, values, shrink), strict=True))
            assert {r["sequence"]: r["batch_id"] for r in got if p == "all" or r["p"] == p} == want


def test_empty_and_no_limits(spark):
    df = spark.range(1, 4).selectExpr("id as sequence", "'a' as resource", "'b' as endpoint")
    assert saturation.dynamic_batches(df.limit(0), 5, 5).count() == 0
    assert [r["batch_id"] for r in saturation.dynamic_batches(df, 5, 1, shrink=True).orderBy("sequence").collect()] == [0, 0, 0]
    with pytest.raises(ValueError, match="a row and a value"):
        saturation.dynamic_batches(df, 0, 5)


def test_ends_of_all_begins():
    end, full = saturation.ends([np.array([0, 1, 0, 2, 2]), np.array([0, 0, 0, 0, 1])], 5, 4, 2)
    assert end.tolist() == [3, 3, 5, 5, 5] and full.tolist() == [True, True, False, False, False]


def test_a_range_ends_with_the_batch_it_began():
    """What a task gets of a producer is a range and the rows of one batch behind it, and that says where all begins lead."""
    columns = {f"{kind}{lane}": np.arange(58) % 5 for kind in saturation.KINDS for lane in (0, 1)}
    out = saturation._scan(8, 3, 50)((pa.scalar("hot"), pa.scalar(2)), pa.table({"position": np.arange(100, 158), **columns})).to_pylist()[0]
    assert out["upto"][-1] == 107 and min(out["land"]) >= 150 and max(out["land"]) < 158
    assert {e - b for b, e in zip(out["begin"], out["end"], strict=True)} == {3} and all(out["full"])
