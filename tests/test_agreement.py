"""Rater agreement by blocks against a plain version."""

import math
import random

import pytest

from sparkloom.operators import ratings as R


def plain(rows, least):
    last = {}
    for rater, item, value, at in rows:
        if None not in (rater, item, value) and (rater, item) not in last or (rater, item) in last and value is not None and last[rater, item][0] < at:
            last[rater, item] = (at, value)
    by = {}
    for (rater, item), (_, v) in last.items():
        by.setdefault(rater, {})[item] = v
    out = {}
    for a in by:
        for b in by:
            both = [(by[a][i], by[b][i]) for i in by[a] if i in by[b]] if a < b else []
            n, sx, sy = len(both), sum(x for x, _ in both), sum(y for _, y in both)
            vx, vy = n * sum(x * x for x, _ in both) - sx * sx, n * sum(y * y for _, y in both) - sy * sy
            if n >= least and vx > 1e-9 and vy > 1e-9:
                out[a, b] = (n, (n * sum(x * y for x, y in both) - sx * sy) / math.sqrt(vx * vy))
    return out


@pytest.mark.parametrize(("raters", "part"), [(512, 1 << 20), (4, 60), (1, 10)])
def test_agreement_by_blocks(spark, raters, part):
    rng = random.Random(8)
    rows = [(rng.choice(["r%d" % i for i in range(14)] + [None]), rng.choice([*range(30), None]), rng.choice([1.0, 2.0, 3.0, 4.0, 5.0, None]), t) for t in range(500)]
    rows += [("hot", i, float(i % 5), 1000 + i) for i in range(30)] + [(f"r{i}", 7, float(i % 4), 2000 + i) for i in range(14)]  # a rater of all items, an item of all raters
    table = spark.createDataFrame(rows, "rater string, item int, value double, at int")
    got = {(r.left_rater, r.right_rater): (r.n_shared, r.r) for r in R.agreement_pairs(table, "rater", "item", "value", ["at"], 3, raters, part).collect()}
    want = plain(rows, 3)
    assert set(got) == set(want)
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_agreement_of_nobody(spark):
    assert R.agreement_pairs(spark.createDataFrame([], "rater long, item long, value double"), "rater", "item", "value", ["item"]).count() == 0


def test_mean_agreement_makes_no_pairs(spark):
    """Few items: as many raters as would make two billion pairs, and the same mean as by pairs on a small table."""
    rng = random.Random(3)
    rows = [(rng.choice([*range(40), None]), rng.choice(["a", "b", "c", "d", "e", None]), rng.choice([1.0, 2.0, 3.0, 4.5, None]), t) for t in range(260)]
    table = spark.createDataFrame(rows, "rater int, item string, value double, at int")
    want = list(plain(rows, 3).values())
    for few in (6, 2):  # summed by sets of items; by pairs
        got = R.mean_agreement(table, "rater", "item", "value", ["at"], few=few).first()
        assert got.n_pairs == len(want) and abs(got.agreement - sum(r for _, r in want) / len(want)) < 1e-9
    many = spark.range(65536).selectExpr("id AS rater", "explode(array(0, 1, 2)) AS item").selectExpr("rater", "item", "double(item) AS value")
    got = R.mean_agreement(many, "rater", "item", "value", ["item"]).first()
    assert got.n_pairs == 65536 * 65535 // 2 and abs(got.agreement - 1) < 1e-9
    assert R.mean_agreement(many.limit(0), "rater", "item", "value", ["item"]).first().n_pairs == 0
