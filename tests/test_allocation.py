"""Greedy allocation of a balance to ordered demands."""

from decimal import Decimal

import numpy as np
import pytest

from tillwise.operators import updates


def plain(amounts, left):
    n = 0
    for x in amounts:
        if x <= left:
            left, n = left - x, n + 1
    return n, left


@pytest.mark.parametrize("seed", range(30))
def test_tree_of_minima(seed):
    rng = np.random.default_rng(seed)
    amounts = rng.integers(1, int(rng.integers(2, 1000)), int(rng.integers(1, 300)))
    for left in (0, 1, 50, 700, 5000, 10**6):
        n, rest = plain(amounts.tolist(), left)
        assert updates.taken(amounts, left) == (n, left - rest)
    tree = updates.Minima(amounts)
    for at in range(0, len(amounts) + 1, 7):
        fits = np.flatnonzero(amounts[at:] <= 40)
        assert tree.first(at, 40) == (at + fits[0] if len(fits) else len(amounts))


def test_a_key_with_many_different_decimal_amounts(spark):
    rng = np.random.default_rng(2)
    n = 30_000
    hot = [Decimal(int(x)).scaleb(-2) for x in rng.permutation(n) + 1]
    demand = [(1, i, a) for i, a in enumerate(hot)] + [(2, i, Decimal("3.50")) for i in range(20)] + [(2, 90, None), (3, 1, Decimal("-2")), (None, 1, Decimal("1"))]
    balances = spark.createDataFrame([(1, Decimal("40000.00")), (2, Decimal("10.00")), (3, Decimal("5")), (4, None)], "k long, b decimal(18,2)")
    asked = spark.createDataFrame(demand, "k long, i long, a decimal(18,2)").repartition(7)
    out = {r.k: (r.remaining, r.accepted, r.refused) for r in updates.deplete(balances, asked, "k", "b", "a", ["i"]).collect()}
    count, left = plain(hot, Decimal("40000.00"))
    assert count > 100 and out[1] == (left, count, n - count)
    assert out[2] == (Decimal("3.00"), 2, 18) and out[3] == (Decimal("5.00"), 0, 0) and out[4] == (None, 0, 0)


@pytest.mark.parametrize("held,asked", [("long", "int"), ("double", "double"), ("decimal(10,1)", "decimal(12,3)"), ("long", "decimal(9,2)")])
def test_kinds_of_numbers(spark, held, asked):
    balances = spark.sql(f"SELECT 'a' AS k, CAST(10 AS {held}) AS b")
    demand = spark.sql(f"SELECT 'a' AS k, i, CAST(a AS {asked}) AS a FROM VALUES (1, 4), (2, 7), (3, 6), (4, 1) AS t(i, a)")
    row = updates.deplete(balances, demand, "k", "b", "a", ["i"]).first()
    assert (float(row.remaining), row.accepted, row.refused) == (0.0, 2, 2)
    assert updates.deplete(balances, demand.limit(0), "k", "b", "a", ["i"]).first().accepted == 0
