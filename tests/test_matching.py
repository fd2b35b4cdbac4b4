from __future__ import annotations

import random

from pyspark.sql import functions as F

from colloquy.operators import matching as mt


def test_greedy_claims(spark):
    gold = spark.createDataFrame(
        [("m", "g1", ["a", "b", "c"]), ("m", "g2", ["a", "b"]), ("n", "g1", ["x"])], "meeting string, gold string, tokens array<string>",
    )
    pred = spark.createDataFrame(
        [("m", 0, ["a", "b", "c"]), ("m", 1, ["a", "b", "d"]), ("m", 2, ["a", "b"]), ("m", 3, ["z"]), ("n", 0, [])],
        "meeting string, pred int, tokens array<string>",
    )
    got = sorted((r["meeting"], r["gold"], r["pred"], r["f1"]) for r in mt.greedy_claims(gold, pred).collect())
    assert got == [("m", "g1", 0, 1.0), ("m", "g2", 2, 1.0)]
    lone = pred.where("pred = 1")
    assert [(r["gold"], round(r["f1"], 3)) for r in mt.greedy_claims(gold, lone).collect()] == [("g2", 0.8)]
    assert mt.greedy_claims(gold.limit(0), pred).count() == 0


def test_alternatives_and_gaps(spark):
    df = spark.createDataFrame(
        [("a", ["x", "y"], [["x"], ["x", "y", "z", "q"]]), ("b", [], []), ("c", ["x"], [])],
        "id string, p array<string>, g array<array<string>>",
    )
    got = {r["id"]: (round(r["f1"], 3), r["exact"]) for r in mt.best_alternative(df, "p", "g").collect()}
    assert got == {"a": (0.667, 0), "b": (1.0, 1), "c": (0.0, 0)}
    s = lambda v: spark.createDataFrame(v, "id string, v double")
    gaps = {r["id"]: (r["gap"], r["diverges"]) for r in mt.scorer_gaps(s([("a", 0.9), ("b", 0.5), ("z", 1.0)]), s([("a", 0.5), ("b", 0.4)]), "id", "v").collect()}
    assert gaps == {"a": (0.4, True), "b": (0.1, False)}


def test_positions_and_rows(spark):
    a = spark.createDataFrame([("k", 3, "x"), ("k", 1, "y")], "k string, o int, v string")
    b = spark.createDataFrame([("k", 5, "p")], "k string, o int, w string")
    got = [(r["place"], r["a"]["v"] if r["a"] else None, r["b"]["w"] if r["b"] else None) for r in mt.positional(a, b, "k", "o").orderBy("place").collect()]
    assert got == [(0, "y", "p"), (1, "x", None)]
    x = spark.createDataFrame([(1, None), (1, None), (2, "b")], "a int, b string")
    y = spark.createDataFrame([(None, 1), ("b", 2), ("c", 3)], "b string, a int")
    assert {(r["a"], r["b"], r["n_a"], r["n_b"]) for r in mt.same_rows(x, y).collect()} == {(1, None, 2, 1), (3, "c", 0, 1)}
    assert mt.same_rows(x, x.repartition(3)).count() == 0
    plan = lambda rows: spark.createDataFrame(rows, "k string, i int, s int")
    r = mt.changed_positions(plan([("k", 0, 1), ("k", 1, 2)]), plan([("k", 0, 1), ("k", 1, 3), ("k", 2, 4)]), "k", "i", ["s"]).first()
    assert (r["changed"], r["places"]) == (2, 3)


def test_windows(spark):
    from tests.test_functions import edit

    rng = random.Random(6)
    rows = [([rng.choice("abc") for _ in range(rng.randrange(9))], [rng.choice("abc") for _ in range(rng.randrange(1, 5))]) for _ in range(120)]
    rows += [(["a", "b", "x", "d"], ["b", "c", "d"]), (["a"], ["a", "b"]), (["q"], [])]
    df = spark.createDataFrame(rows, "t array<string>, n array<string>")
    for r in df.select("t", "n", mt.window_distance("t", "n").alias("d")).collect():
        n = len(r["n"])
        windows = [r["t"][i : i + k] for k in range(max(1, n - 1), n + 2) for i in range(len(r["t"]) - k + 1)]
        assert r["d"] == min((edit(w, r["n"]) for w in windows), default=n)
    match = lambda t, *needles: spark.createDataFrame([(t.split(), list(needles))], "t array<string>, n array<string>").select(mt.fuzzy_matches("t", "n").alias("x")).first()["x"]
    assert match("we met anna lund today", "anna lund") == ["anna lund"]
    assert match("the head of the sales team met", "head of sales team") == ["head of the sales team"]  # one word more
    assert match("head sales team and head of sales team", "head of sales team") == ["head sales team", "head of sales team"]
    assert match("anna anna lund", "anna lund", "anna") == ["anna", "anna", "anna lund"]
    assert match("a b c", "x", "") == [] and match("", "a") == []
    none = spark.createDataFrame([(None, ["a"])], "t array<string>, n array<string>").select(
        mt.fuzzy_matches("t", "n").alias("x"), mt.window_distance("t", "n").alias("d"),
    ).first()
    assert none["x"] is None and none["d"] is None


def test_budgets_blocks_and_rotation(spark):
    df = spark.createDataFrame([("g", 1, 40), ("g", 2, 50), ("g", 3, 20), ("g", 4, 1), ("h", 1, None)], "g string, o int, c int")
    got = {(r["g"], r["o"]): (r["spent"], r["allowed"]) for r in mt.within_budget(df, ["g"], ["o"], "c", 100).collect()}
    assert got == {("g", 1): (40, True), ("g", 2): (90, True), ("g", 3): (110, False), ("g", 4): (111, False), ("h", 1): (0, True)}
    lines = spark.createDataFrame([("g", 2, "bbbb"), ("g", 1, "aaa"), ("g", 3, "c" * 50)], "g string, o int, t string")
    assert [(r["block"], r["n_lines"]) for r in mt.capped_block(lines, "g", ["o"], "t", 3).collect()] == [("aaa\nbbbb", 2)]
    turns = mt.rotated_requests(spark.createDataFrame([(f"t{i}",) for i in range(30)], "id string"), "id", ["x", "y", "z"]).collect()
    assert len(turns) == 90 and all(sorted(r["turn"] for r in turns if r["id"] == f"t{i}") == [0, 1, 2] for i in range(30))
    assert len({r["turn"] for r in turns if r["arm"] == "x"}) == 3
    plan = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    done = spark.createDataFrame([("a",), ("a",), ("b",), ("z",)], "k string")
    assert {r["k"]: r["state"] for r in mt.reconciled(plan, done, ["k"]).collect()} == {
        "a": "repeated", "b": "complete", "c": "missing", "z": "unplanned",
    }


def test_sections_are_trimmed_from_the_end(spark):
    df = spark.createDataFrame([("a", ["t1", "t2"], ["s1", "s2"]), ("b", None, None)], "k string, t array<string>, s array<string>")

    def made(budget):
        rows = df.select(
            "k", mt.trimmed_sections(F.col("t"), F.col("s"), ("T", "S"), ("-", "-"), budget).alias("x"),
        ).select("k", "x.*").collect()
        return {r["k"]: (r["text"], r["n_first"], r["n_second"], r["tokens"]) for r in rows}

    assert made(99)["a"] == ("T\nt1\nt2\n\nS\ns1\ns2", 2, 2, 4) and made(99)["b"] == ("T\n-\n\nS\n-", 0, 0, 2)
    assert made(3)["a"] == ("T\nt1\nt2\n\nS\n-", 2, 0, 3)
    assert made(2)["a"][1:3] == (0, 0) and made(1)["a"] == ("T\n-\n\nS\n-", 0, 0, 2)
