import math
import random

import numpy as np

from grafloom.operators.quantiles import quantiles


def test_quantiles_equal_sorted_values(spark):
    r = random.Random(6)
    rows = [(r.choice(["hot"] * 6 + ["b", None]), r.choice([r.gauss(0, 9), float(r.randrange(4)), 2.0])) for _ in range(3000)]
    rows += [("nulls", None), ("nulls", math.nan), ("one", 7.5), ("hot", None), ("hot", math.nan), ("ends", -math.inf), ("ends", 1.0)]
    shares = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {x.k: x for x in quantiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", shares).collect()}
    assert set(got) == {k for k, _ in rows}
    for k in ("hot", "b", None, "one"):
        values = [v for g, v in rows if g == k and v is not None and not math.isnan(v)]
        assert (got[k].n, got[k].least, got[k].most) == (len(values), min(values), max(values))
        assert np.allclose(got[k].quantiles, np.quantile(values, shares), atol=1e-9)
    assert got["nulls"].n == 0 and got["nulls"].least is None and got["nulls"].quantiles == [None] * 5
    assert (got["ends"].n, got["ends"].least, got["ends"].most) == (2, -math.inf, 1.0)
    empty = quantiles(spark.createDataFrame([], "k string, v double"), "k", "v", [0.5])
    assert empty.columns == ["k", "n", "least", "most", "quantiles"] and not empty.count()


def test_no_group_is_held_in_a_buffer(spark):
    rows = spark.range(1000).selectExpr("'same' as k", "cast(id as double) as v")
    plan = quantiles(rows, "k", "v", [0.5])._jdf.queryExecution().toString()
    assert "ObjectHashAggregate" not in plan and "collect_list" not in plan and "percentile" not in plan
