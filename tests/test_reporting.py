from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from colloquy.operators import reporting as rp


def test_rollup_cells_and_reports(spark):
    df = spark.createDataFrame([("a", "ok"), ("a", "error"), ("b", "ok"), (None, "ok")], "g string, outcome string")
    got = {(r["g"], r["total"]): (r["n"], r["n_ok"], r["n_error"]) for r in rp.outcome_rollup(df, "g").collect()}
    assert got == {("a", False): (2, 1, 1), ("b", False): (1, 1, 0), (None, False): (1, 1, 0), (None, True): (4, 3, 1)}
    cells = spark.createDataFrame(
        [("x", 0.5, 0.95), ("y", 0.505, 1.0), ("z", 0.1, 0.5), ("w", 0.6, 1.0)], "cell string, v double, c double",
    )
    assert {r["cell"]: r["winner"] for r in rp.best_cells(cells, "v", "c", ["cell"]).collect()} == {"x": True, "y": False}
    assert rp.best_cells(cells.where("c < 0.9"), "v", "c", ["cell"]).count() == 0
    qa = spark.createDataFrame([(1.0, 1.0, True), (0.0, 0.0, True), (1.0, 1.0, False)], "f double, i double, a boolean")
    assert tuple(rp.answer_report(qa, "f", "i", F.col("a")).first()) == (3, 0.666667, 0.666667, 0.5, 1.0)
    assert rp.answer_report(qa.where("a"), "f", "i", F.col("a")).first()["f1_other"] is None
    assert rp.markdown_table(cells.where("cell = 'x'")) == "| cell | v | c |\n| --- | --- | --- |\n| x | 0.5 | 0.95 |"
    with pytest.raises(ValueError):
        rp.markdown_table(cells, 2)


def test_silences(spark):
    frames = [("r", i, 0.0 if 10 <= i < 70 or 200 <= i < 220 else 1.0 + i) for i in range(400)]
    got = rp.silences(spark.createDataFrame(frames, "recording string, frame int, energy double")).collect()
    assert [(r["start_ms"], r["end_ms"]) for r in got] == [(200, 1400)]


def test_logs_and_constraints(spark):
    logs = spark.createDataFrame(
        [("log-10.txt", "batch 3 took 5 s\nnoise\nbatch 4 took 7 s"), ("log-2.txt", "batch 1 took 2 s")], "file string, text string",
    )
    rows = rp.log_entries(logs, r"batch (\d+) took (\d+) s", ["batch", "seconds"]).orderBy("file_no", "no").collect()
    assert [(r["file_no"], r["no"], r["batch"], r["seconds"]) for r in rows] == [(2, 0, "1", "2"), (10, 0, "3", "5"), (10, 1, "4", "7")]
    roster = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    members = spark.createDataFrame([("a", "train"), ("a", "test"), ("z", "train")], "k string, split string")
    assert {tuple(r) for r in rp.constraint_breaks(roster, "k", {"m": members}).collect()} == {
        ("repeated", "roster", "b"), ("unknown", "m", "z"), ("two splits", "m", "a"),
    }


def test_supplies(spark):
    rows = [("m", 0, "alpha", 2), ("m", 1, "beta", 1), ("m", 1, "alpha", 1), ("n", 0, "gamma", 3), ("n", 1, "delta", 2)]
    df = spark.createDataFrame(rows, "meeting string, chunk int, term string, evidence bigint")
    got = {}
    for r in rp.term_supplies(df).orderBy("rank").collect():
        got.setdefault((r["arm"], r["meeting"], r["chunk"]), []).append(r["term"])
    assert got["gated", "m", 1] == ["alpha"] and got["naive", "m", 1] == ["alpha", "beta"] and got["scrambled", "m", 1] == ["aplha", "btea"]
    assert ("no_carry", "m", 1) not in got and got["no_carry", "n", 1] == ["delta"] and got["deranged", "m", 1] == ["gamma", "delta"]


def test_indexes(spark):
    r = spark.createDataFrame([(list(range(200)),)], "v array<int>").select(rp.index_interval(F.col("v")).alias("x")).first()["x"]
    assert (r["low"], r["high"]) == (5, 194)
