from __future__ import annotations

import random

import numpy as np

from colloquy.llm import splitting

LIMITS = "profile string, target_s double, min_s double, max_s double, overlap_s double"


def test_pieces_of_random_items():
    rng = random.Random(3)
    for _ in range(300):
        high = rng.randrange(50, 900)
        cuts = [np.array(sorted({rng.randrange(1, high) for _ in range(rng.randrange(n))}), np.int64) for n in (3, 6, 12, 20)]
        most, overlap = rng.randrange(20, 200), rng.choice([0, 5])
        pieces = splitting.pieces_of(0, high, cuts, most, overlap, most * 3 // 4, most // 2)
        assert pieces[0][0] == 0 and pieces[-1][1] == high
        assert all(0 < b - a <= most for a, b, _ in pieces)
        assert all(x[1] - y[0] == overlap for x, y in zip(pieces, pieces[1:]))
        natural = set(np.concatenate(cuts).tolist()) | {high}
        for a, b, level in pieces[:-1]:
            assert level == 4 or b in natural


def test_prefers_the_higher_boundary():
    sections, turns = np.array([60], np.int64), np.array([60, 75, 110], np.int64)
    pieces = splitting.pieces_of(0, 160, [sections, turns, turns, turns], 100, 0, 50, 10)
    assert pieces[0] == (0, 60, 0)
    whole = splitting.pieces_of(0, 90, [sections, turns, turns, turns], 100, 0, 50, 10)
    assert [x[:2] for x in whole] == [(0, 90)]


def tables(spark, dialogues, turns):
    d = spark.createDataFrame(dialogues, "uniq_id string, duration double")
    t = spark.createDataFrame(turns, "uniq_id string, turn_index int, start_s double, end_s double")
    return d, t, spark.createDataFrame(
        [("p", 8.0, 5.0, 10.0, 1.0), ("q", 80.0, 50.0, 100.0, 0.0), (None, 1.0, 1.0, 1.0, 0.0), ("z", 1.0, 1.0, None, 0.0)], LIMITS,
    )


def test_limits_and_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    dialogues = [
        ("a", 10.0000000001), ("b", 10.000002), ("c", None), ("d", nan), ("e", inf), ("f", -1.0), ("a", 10.0000000001), (None, 50.0),
        ("g", 9.0),
    ]
    turns = [
        ("c", 0, 0.0, 11.0), ("c", 0, 0.0, 11.0), ("d", 1, 3.0, 30.0), ("f", 0, 2.0, 1.0), ("f", 1, None, 90.0), ("g", 0, 0.0, 25.0),
        ("unlisted", 7, 0.0, 12.0), ("g", 1, nan, 90.0),
    ]
    out = splitting.split_oversized(*tables(spark, dialogues, turns)).where("profile = 'p'").collect()
    found = {(r["uniq_id"], r["turn_index"]) for r in out}
    assert found == {("b", -1), ("c", -1), ("c", 0), ("d", -1), ("d", 1), ("g", -1), ("g", 0), ("unlisted", 7)}
    for key in found:
        own = sorted((r for r in out if (r["uniq_id"], r["turn_index"]) == key), key=lambda r: r["piece_no"])
        assert len(own) >= 2 and all(r["end_s"] - r["start_s"] <= 10 + 1e-6 for r in own)
        assert all(abs(x["end_s"] - y["start_s"] - 1.0) < 1e-6 for x, y in zip(own, own[1:])) and own[-1]["boundary"] == "end"


def test_ends_between_turns_where_possible(spark):
    turns = [("a", i, i * 6.0, i * 6.0 + 5.0) for i in range(10)]
    out = splitting.split_oversized(*tables(spark, [("a", 60.0)], turns)).where("profile = 'p' and turn_index = -1").collect()
    ends = {t[3] for t in turns} | {60.0}
    assert all(r["end_s"] in ends for r in out) and {r["boundary"] for r in out} == {"silence", "end"}


def test_touching_turns_are_a_boundary(spark):
    turns = [("a", i, i * 7.0, i * 7.0 + 7.0) for i in range(5)]
    out = splitting.split_oversized(*tables(spark, [("a", 35.0)], turns)).where("profile = 'p' and turn_index = -1").collect()
    assert {r["end_s"] for r in out} <= {7.0, 14.0, 21.0, 28.0, 35.0} and {r["boundary"] for r in out} == {"between_turns", "end"}


def test_empty(spark):
    d, t, p = tables(spark, [], [])
    assert splitting.split_oversized(d, t, p).count() == 0 and splitting.split_oversized(d, t, p.limit(0)).count() == 0


def test_faults_are_seen(spark):
    limits = spark.createDataFrame([("p", 10.0, 2.0)], "profile string, max_s double, overlap_s double")
    good = [("p", "a", -1, 0, 0.0, 10.0), ("p", "a", -1, 1, 8.0, 15.0)]
    bad = [("p", "b", 1, 0, 0.0, 11.0), ("p", "b", 1, 2, 10.0, 11.0)]
    schema = "profile string, uniq_id string, turn_index int, piece_no int, start_s double, end_s double"
    counts = lambda rows: tuple(splitting.piece_faults(spark.createDataFrame(rows, schema), limits).first())
    assert counts(good) == ("p", 1, 0, 0, 0, 0) and counts(good + bad) == ("p", 2, 1, 1, 1, 1)
