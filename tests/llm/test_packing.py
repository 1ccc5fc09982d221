import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from claimloom.llm.packing import best_fit_decreasing, lower_bound, pack, token_counts

DOC = "doc_id long, text string, part int, room string"


def naive(sizes, capacity):
    room = []
    for s in sorted(sizes, reverse=True):
        fit = [(r, i) for i, r in enumerate(room) if r >= s]
        if fit:
            room[min(fit)[1]] -= s
        else:
            room.append(capacity - s)
    return sorted(room)


def fewest(sizes, capacity):
    """Exact number of containers of a small list."""
    best = len(sizes)

    def go(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(sizes):
            best = len(room)
            return
        for r in sorted(set(room)):
            if r >= sizes[i]:
                k = room.index(r)
                go(i + 1, room[:k] + [r - sizes[i]] + room[k + 1 :])
        go(i + 1, room + [capacity - sizes[i]])

    go(0, [])
    return best


@given(st.lists(st.integers(0, 20), max_size=8))
@settings(max_examples=150, deadline=None)
def test_bound_optimum_and_best_fit(sizes):
    x = np.array(sizes, dtype=np.int64)
    where, room = best_fit_decreasing(x, 20)
    load = np.bincount(where, x, minlength=len(room)) if len(x) else np.array([])
    assert (load + room == 20).all() and sorted(room.tolist()) == naive(sizes, 20)
    live = sorted((s for s in sizes if s), reverse=True)
    lb = lower_bound(*np.unique(x, return_counts=True), 20) if len(x) else 0
    assert lb <= fewest(live, 20) <= max(len(room), 0)


def test_dual_feasible_functions_beat_the_total():
    sizes, counts = np.array([11]), np.array([6])  # no two fit together
    assert lower_bound(sizes, counts, 20) == 6 and -(-66 // 20) == 4
    assert lower_bound(np.array([7]), np.array([6]), 20) == 3


def test_packing_of_documents(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices(["credit", "rationing", "wage", "x1", "zoning"], k=rng.randint(0, 60))), 1, "r") for i in range(400)]
    docs += [(1000, None, 1, "r"), (1001, "", 1, "r"), (1002, "long text " * 300, 1, "r"), (1003, "same", 1, "r"), (1003, "same", 1, "r"), (1004, "信贷配给" * 50, 1, "r")]
    df = spark.createDataFrame(docs, DOC)
    sizes = {r["doc_id"]: r["tokens"] for r in token_counts(df).collect()}
    for pieces in (20_000, 60):
        out, report = pack(df, capacity=128, partition_pieces=pieces)
        rows = out.collect()
        load, parts = {}, {}
        for r in rows:
            load[r["container"]] = load.get(r["container"], 0) + r["tokens"]
            parts.setdefault(r["doc_id"], []).append((r["part"], r["start_token"], r["tokens"]))
        assert max(load.values()) <= 128 and set(parts) == {d[0] for d in docs}
        assert all(load[r["container"]] + r["room"] == 128 for r in rows)
        for d, p in parts.items():
            p.sort()
            assert sum(x[2] for x in p) == sizes[d] and [x[1] for x in p] == [128 * k for k in range(len(p))]
            assert len(p) == 1 or sizes[d] > 128
        assert len(load) == report["containers"] >= report["bound"] and report["containers"] - report["bound"] <= 2
    assert pack(df.limit(0), capacity=128)[0].count() == 0
