"""Whole groups in folds, whatever their number."""

from airloft.operators import windows as win


def greedy(sizes, n):
    load, out = [0] * n, {}
    for k, c in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        out[k] = load.index(min(load))
        load[out[k]] += c
    return out


def test_turns_equal_greedy(spark):
    import random

    for seed in range(200):
        rng = random.Random(seed)
        load = [rng.randrange(60) for _ in range(rng.randrange(1, 7))]
        size, count = rng.randrange(1, 9), rng.randrange(1, 90)
        turns, after = win._turns(load, size, count)
        held, want = list(load), []
        for _ in range(count):
            want.append(held.index(min(held)))
            held[want[-1]] += size
        ends = [t[0] for t in turns[1:]] + [count]
        assert [f[(i - start) % len(f)] for (start, f), end in zip(turns, ends) for i in range(start, end)] == want and after == held


def test_many_groups_are_dealt_as_evenly_as_few(spark):
    sizes = {f"k{i:05d}": 1 + i * i % 7 for i in range(6000)}
    df = spark.createDataFrame([(k,) for k, c in sizes.items() for _ in range(c)], "k string")
    want = greedy(sizes, 5)
    assert {r["k"]: r["fold"] for r in win.group_folds(df, "k").collect()} == want
    assert {r["k"]: r["fold"] for r in win.group_folds(df, "k", most=2).collect()} == want
    assert win.group_folds(df.limit(0), "k").count() == 0
