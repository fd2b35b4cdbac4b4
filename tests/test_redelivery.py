from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from colloquy.operators.redelivery import IDS_PER_WORD, message_counts, messages, one_row_per_message

SCHEMA = "delivery_id bigint, target_id string, arm string, outcome string, delivered_at timestamp, batch_id string"


def test_counts_against_brute_force(spark):
    rng = random.Random(4)
    day = dt.datetime(2025, 3, 1)
    rows = []
    for i in range(1500):
        target = "hot" if rng.random() < 0.33 else f"t{rng.randrange(700)}"
        text = rng.choice([target, target.upper(), f"  {target}\t"])
        at = None if rng.random() < 0.03 else day + dt.timedelta(hours=rng.randrange(24 * 200))
        rows.append((i, text, rng.choice(["A", "a ", None]), "ok" if rng.random() < 0.9 else "error", at, "b"))
    rows += [(5000, None, "A", "ok", day, "b"), (5001, "  ", "A", "ok", day, "b")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = {}
    for d, t, a, o, at, _ in rows:
        if o == "ok" and t and t.strip():
            want.setdefault((t.strip().lower(), a.strip().lower() if a else None), []).append((at is None, at or day, d))
    got = {(r["target_id"], r["arm"]): (r["copies"], r["delivery_id"]) for r in messages(df).collect()}
    assert got == {k: (len(v), min(v)[2]) for k, v in want.items()}
    kept = one_row_per_message(df.withColumn("_kept", F.lit(1)).drop("_kept"))
    assert sorted(r["delivery_id"] for r in kept.collect()) == sorted(min(v)[2] for v in want.values())


def test_false_positives_do_not_count(spark, monkeypatch):
    """With hardly any filter bits every other bucket matches; the exact check must decide."""
    from colloquy.operators import redelivery

    monkeypatch.setattr(redelivery, "IDS_PER_WORD", 10_000)
    day = dt.datetime(2025, 3, 1)
    rows = [(i, f"t{i % 300}" if i % 7 else f"u{i}", "a", "ok", day + dt.timedelta(days=i % 150), "b") for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for r in rows:
        want[r[1]] = want.get(r[1], 0) + 1
    assert {r["target_id"]: r["copies"] for r in messages(df, days=5).collect()} == want
    assert IDS_PER_WORD == 5


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert messages(df).count() == 0 and one_row_per_message(df).count() == 0
    assert message_counts(df, [F.col("target_id")], F.col("delivered_at"), [F.col("delivery_id")]).count() == 0
