"""Apportionment where one party is due many seats."""

from collections import Counter

import pytest

from tidemark.llm import mixing


def highest(weights, seats):
    got = Counter()
    for _, i, _ in sorted((-w / (2 * k + 1), i, k) for i, w in enumerate(weights) for k in range(seats))[:seats]:
        got[i] += 1
    return [got[i] for i in range(len(weights))]


@pytest.mark.parametrize("weights, seats", [
    ([1000.0] + [10.1] * 100, 2010),  # ten seats more than its share
    ([1000.0] + [9.6] * 100, 1960),
    ([1000.0] + [10.6] * 100, 2060),  # forty taken back
    ([500.0, 3.0, 0.0] + [0.4] * 60, 527),
    ([7.0] + [1.0] * 50, 20),
])
def test_one_party_takes_the_whole_gap(spark, weights, seats):
    df = spark.createDataFrame([(i, w, seats) for i, w in enumerate(weights)], "k long, w double, seats long")
    got = {r.k: r.got for r in mixing.apportion(df, [], ["k"], "w", "seats", "got").collect()}
    assert [got[i] for i in range(len(weights))] == highest(weights, seats)
