"""Containers: nothing lost, nothing too full, near the least number."""

import random

import numpy as np
import pytest

from foliospark.llm import packing
from foliospark.llm.queries import QUERIES


def used(containers):
    out = {}
    for r, content in containers:
        for a, n in content.items():
            out[a] = out.get(a, 0) + r * n
    return out


def first_fit(hist, capacity):
    """Containers that plain first fit, longest first, uses."""
    space = []
    for a in sorted((a for a, n in hist.items() for _ in range(n)), reverse=True):
        i = next((i for i, s in enumerate(space) if s >= a), None)
        if i is None:
            space.append(capacity - a)
        else:
            space[i] -= a
    return len(space)


@pytest.mark.parametrize("seed,capacity", [(1, 512), (2, 2048), (3, 64), (4, 10)])
def test_plan_holds_every_item(seed, capacity):
    r = random.Random(seed)
    hist = {a: r.randint(1, 40) for a in r.sample(range(1, capacity + 1), min(capacity, 60))}
    got = packing.plan(hist, capacity)
    assert used(got) == hist
    assert all(sum(a * n for a, n in c.items()) <= capacity for _, c in got)
    assert sum(r for r, _ in got) <= 1.01 * first_fit(hist, capacity)


def test_edges():
    assert packing.plan({}, 512) == [] and packing.plan({0: 5}, 512) == []
    assert packing.plan({512: 3}, 512) == [(3, {512: 1})]
    assert sum(r for r, _ in packing.plan({300: 7}, 512)) == 7
    assert sum(r for r, _ in packing.plan({1: 1000}, 512)) == 2


def test_slots_are_filled_once():
    hist = {100: 13, 200: 5, 412: 3, 50: 9}
    plan = packing.plan(hist, 512)
    slots = packing.Slots(plan)
    load = np.zeros(slots.count + 1, int)
    for a, n in hist.items():
        np.add.at(load, slots.of(a, np.arange(n)), a)
    assert load[0] == 0 and load.max() <= 512 and load.sum() == sum(a * n for a, n in hist.items()) and (load[1:] > 0).all()


def test_one_hot_length_and_splits(spark):
    df = spark.createDataFrame([(i, 700 if i else 0) for i in range(200)], "doc_id bigint, tokens bigint")
    got = packing.ranked(packing.pieces(df, [(1, 512)])).collect()
    for size, n in ((512, 199), (188, 199), (0, 1)):
        assert sorted(r.rank for r in got if r.tokens == size) == list(range(n))


def test_real_fill(spark):
    for r in QUERIES["p8_fill"](spark, "/root/testdata/sf0.01").collect():
        assert r.containers <= r.least + 2
