from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from colloquy.llm import epochs


def philox_plain(key: int, counter: int) -> int:
    """The published rounds in plain integers."""
    c, k0, k1 = [counter & 0xFFFFFFFF, counter >> 32, 0, 0], key & 0xFFFFFFFF, key >> 32
    for _ in range(10):
        a, b = c[0] * 0xD2511F53, c[2] * 0xCD9E8D57
        c = [(b >> 32) ^ c[1] ^ k0, b & 0xFFFFFFFF, (a >> 32) ^ c[3] ^ k1, a & 0xFFFFFFFF]
        k0, k1 = (k0 + 0x9E3779B9) & 0xFFFFFFFF, (k1 + 0xBB67AE85) & 0xFFFFFFFF
    return c[1] << 32 | c[0]


def test_generator():
    # the published answer for key and counter of all zeros
    assert epochs.philox(np.zeros(1, np.uint64)).tolist() == [0xE169C58D6627E8D5]
    keys = np.random.default_rng(1).integers(0, 2**63, 200).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    for counter in (0, 5, 2**40 + 3):
        assert epochs.philox(keys, counter).tolist() == [philox_plain(int(k), counter) for k in keys]


def listed(spark, rows):
    return spark.createDataFrame(rows, "uniq_id string, manifest_batch int")


def test_members_stay(spark):
    first = [(f"d{i}", 1) for i in range(800)]
    later = first + [(f"d{i}", 2) for i in range(700, 1500)] + [("d3", 5), (None, 1), ("n", None)]
    sample = lambda rows, n: {r["id"] for r in epochs.members(epochs.first_seen(listed(spark, rows).repartition(n), "uniq_id", "manifest_batch")).collect()}
    one, two = sample(first, 2), sample(later, 5)
    assert one and one <= two and {x for x in two if x != "n" and int(x[1:]) < 800} == one
    assert two == sample(list(reversed(later)) + later, 3)
    assert 0.14 < len(one) / 800 < 0.26
    assert sample([], 1) == set()


def test_rates(spark):
    rows = epochs.first_seen(listed(spark, [("a", 1), ("b", 2), ("c", 99), ("d", None), ("e", -4)]), "uniq_id", "manifest_batch").collect()
    assert {r["id"]: round(r["rate"], 6) for r in rows} == {"a": 0.2, "b": 0.19, "c": 0.05, "d": 0.05, "e": 0.2}
    draws = spark.range(20_000).select(epochs.uniform(F.xxhash64("id")).alias("u"))
    r = draws.agg(F.min("u").alias("a"), F.max("u").alias("b"), F.avg("u").alias("m")).first()
    assert 0 <= r["a"] < 0.001 and 0.999 < r["b"] < 1 and abs(r["m"] - 0.5) < 0.01


def test_store_freezes_epochs_and_rates(spark, tmp_path):
    store = epochs.EpochStore(spark, f"file://{tmp_path}/state")
    store.update(listed(spark, [(f"d{i}", 1) for i in range(300)]), "uniq_id", "manifest_batch", rate=0.5)
    before = {r["id"] for r in store.sample().collect()}
    store.update(listed(spark, [(f"d{i}", 2) for i in range(200, 600)] + [("d1", 0)]), "uniq_id", "manifest_batch", rate=0.01)
    after = store.read().collect()
    assert len(after) == 600 and {r["epoch"] for r in after if int(r["id"][1:]) < 300} == {1} and {r["rate"] for r in after if int(r["id"][1:]) < 300} == {0.5}
    assert before == {r["id"] for r in store.sample().collect() if int(r["id"][1:]) < 300} and len(before) > 100


def test_batches_arrive_one_after_the_other(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(epochs, "checkpoint_root", lambda _: f"file://{tmp_path}")
    first = [(f"d{i}", 1) for i in range(400)]
    take = lambda rows: {r["id"]: (r["epoch"], r["rate"]) for r in epochs.persisted_members(listed(spark, rows), "t", "uniq_id", "manifest_batch").collect()}
    one = take(first)
    assert one and take(first) == one
    monkeypatch.setattr(epochs, "FIRST_RATE", 0.9)
    later = take([*first, *[(f"d{i}", 2) for i in range(300, 700)], ("d5", 0)])
    assert {i: x for i, x in later.items() if int(i[1:]) < 400} == one and len(later) > len(one)
    # what is not listed any more is not returned, and its epoch is kept
    assert set(take(first[:200])) == {i for i in one if int(i[1:]) < 200}
    assert take(first) == one


def test_an_epoch_keeps_its_rate(spark, tmp_path):
    store = epochs.EpochStore(spark, f"file://{tmp_path}/s")
    assert store.update(listed(spark, [("a", 1)]), "uniq_id", "manifest_batch", rate=0.5) == 0
    assert store.update(listed(spark, [("a", 1), ("b", 1), ("c", 2)]), "uniq_id", "manifest_batch", rate=0.1) == 1
    assert store.update(listed(spark, [("a", 3), ("c", 1)]), "uniq_id", "manifest_batch", rate=0.9) == 1
    assert {r["id"]: (r["epoch"], r["rate"]) for r in store.read().collect()} == {"a": (1, 0.5), "b": (1, 0.5), "c": (2, 0.1)}


def test_two_writers(spark, tmp_path, monkeypatch):
    """A writer that read the store before another one stored starts again."""
    folder = f"file://{tmp_path}/s"
    slow, fast = epochs.EpochStore(spark, folder), epochs.EpochStore(spark, folder)
    slow.update(listed(spark, [("a", 1)]), "uniq_id", "manifest_batch", rate=0.5)
    seen, real = [], slow.generations

    def generations():
        found = real()
        if not seen:
            seen.append(1)
            fast.update(listed(spark, [("b", 1), ("c", 2)]), "uniq_id", "manifest_batch", rate=0.3)
        return found

    monkeypatch.setattr(slow, "generations", generations)
    assert slow.update(listed(spark, [("b", 2), ("d", 2)]), "uniq_id", "manifest_batch", rate=0.1) == 2
    rows = [(r["id"], r["epoch"], r["rate"]) for r in fast.read().collect()]
    assert sorted(rows) == [("a", 1, 0.5), ("b", 1, 0.5), ("c", 2, 0.3), ("d", 2, 0.3)]
    assert [p.name for p in tmp_path.glob("s/_aside*")] == []
