from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.operators.periods import TILE_BITS, dyadic_runs, periods_and_gaps, speaking_periods


def brute(spans):
    """Periods and gaps of one key by sorting."""
    out = []
    for s, e in sorted((s, e) for s, e in spans if s is not None and e is not None and s < e):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    rows = {("period", a, b) for a, b in out}
    return rows | {("gap", a[1], b[0]) for a, b in zip(out, out[1:])}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 255), st.integers(1, 256)).filter(lambda x: x[0] < x[1]), max_size=40))
def test_runs_within_tiles(spans):
    bits = 5
    parts = [(max(s, t << bits), min(e, (t + 1) << bits)) for s, e in spans for t in range(s >> bits, ((e - 1) >> bits) + 1)]
    low, high = dyadic_runs(np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64), bits)
    covered = {x for s, e in spans for x in range(s, e)}
    assert {x for s, e in zip(low, high) for x in range(s, e)} == covered
    assert all(b < c or b % (1 << bits) == 0 for b, c in zip(high, low[1:]))


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    tile = 1 << TILE_BITS
    rows = []
    for key in ("a", "b", None):
        for _ in range(400):
            s = int(rng.integers(-3 * tile, 6 * tile))
            rows.append((key, s, s + int(rng.choice([1, 10, 1_000, 50_000]))))
        rows += [
            (key, 7 * tile, 12 * tile + 5), (key, 8 * tile + 3, 8 * tile + 4), (key, 9 * tile, 10 * tile),
            (key, 12 * tile + 5, 12 * tile + 6),
        ]
        rows += [(key, 20 * tile, 21 * tile), (key, 21 * tile, 22 * tile), (key, 5, 5), (key, 9, 2), (key, None, 4), (key, 4, None)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint").repartition(7)
    got = {k: set() for k in ("a", "b", None)}
    for r in periods_and_gaps(df, ["k"], "s", "e").collect():
        assert (r["kind"], r["start"], r["end"]) not in got[r["k"]]
        got[r["k"]].add((r["kind"], r["start"], r["end"]))
    for key in got:
        assert got[key] == brute([(s, e) for k, s, e in rows if k == key])


def test_edge_cases_of_segments(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        ("m", "ref", "a", 0.0, 1.0), ("m", "ref", "a", 1.0, 2.0), ("m", "ref", "a", 2.0011, 3.0), ("m", "ref", "a", 0.2, 0.3),
        ("m", "ref", "a", 5.0, 5.0), ("m", "ref", "a", 7.0, 6.0),
        ("m", "ref", "a", nan, 9.0), ("m", "ref", "a", 8.0, inf), ("m", "ref", "a", None, 9.0), ("m", "ref", None, 0.0, 9.0),
        ("m", "ref", " ", 0.0, 9.0), ("m", "ref", "<NA>", 0.0, 9.0), ("m", "ref", "a", 4.0001, 4.0002),
        (None, "hyp", "b", 0.0, 0.5),
    ]
    df = spark.createDataFrame(rows, "meeting_id string, side string, speaker string, start_s double, end_s double")
    got = {tuple(r) for r in speaking_periods(df.selectExpr("*", "'x' AS kind", "0 AS start", "1 AS _s")).collect()}
    assert got == {
        ("period", "m", "ref", "a", 0, 2000), ("gap", "m", "ref", "a", 2000, 2001), ("period", "m", "ref", "a", 2001, 3000),
        ("period", None, "hyp", "b", 0, 500),
    }
    assert speaking_periods(df.limit(0)).count() == 0
