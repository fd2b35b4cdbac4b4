from __future__ import annotations

import os
import random
from collections import defaultdict

import pytest

from colloquy.llm import bpe, mixing

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARIES), reason="no vocabulary files")
TARGETS = "mix_name string, size_ratio double, source_name string, target_share double, max_repeats int"


def corpus(spark, n=600):
    rng = random.Random(2)
    rows = [(i, " ".join(["token"] * rng.randrange(1, 30)), rng.choice(["big"] * 6 + ["mid", "small", None])) for i in range(n)]
    rows += [(9001, None, "big"), (9002, "", "big"), (9003, "one", "single")]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def test_prefix_sums_against_brute_force(spark):
    rows, df = corpus(spark)
    docs = mixing.sized(df)
    own = {r["doc_id"]: (r["source"], r["tokens"]) for r in docs.collect()}
    key = {r["doc_id"]: r["k"] for r in docs.select("doc_id", mixing.random_key(0, docs["doc_id"]).alias("k")).collect()}
    want = {}
    for source in {s for s, _ in own.values()}:
        total = 0
        for d in sorted((d for d, (s, _) in own.items() if s == source), key=lambda d: (key[d], d)):
            total += own[d][1]
            want[d] = total
    for n in (1, 7, 2_000):
        assert {r["doc_id"]: r["upto"] for r in mixing.prefix_sums(docs, 0, n).collect()} == want


def test_budgets_repeats_and_shares(spark):
    rows, df = corpus(spark)
    targets = [
        ("m", 0.5, "big", 0.5, 1), ("m", 0.5, "small", 0.4, 3), ("m", 0.5, "none", 0.05, 2), ("m", 0.5, "mid", 0.0, 1),
        ("x", 2.0, "single", 0.1, 5), ("x", 2.0, "mid", 0.01, None),
    ]
    t = spark.createDataFrame(targets, TARGETS)
    sizes = {r["doc_id"]: (r["source"], r["tokens"]) for r in mixing.sized(df).collect()}
    total = sum(n for _, n in sizes.values())
    per = defaultdict(int)
    for s, n in sizes.values():
        per[s] += n
    mix = mixing.mixed(df, t).collect()
    got = defaultdict(int)
    for r in mix:
        assert 1 <= r["repeats"] <= {("m", "big"): 1, ("m", "small"): 3, ("x", "single"): 5}[r["mix_name"], r["source"]]
        assert sizes[r["doc_id"]] == (r["source"], r["tokens"])
        got[r["mix_name"], r["source"]] += r["repeats"] * r["tokens"]
    assert len({(r["mix_name"], r["doc_id"]) for r in mix}) == len(mix)
    longest = max(n for _, n in sizes.values())
    for name, ratio, source, share, repeats in targets:
        budget = min(int(ratio * total * share), per.get(source, 0) * (repeats or 0))
        assert budget - longest < got[name, source] <= budget or budget == got[name, source]
    report = {(r["mix_name"], r["source"]): r for r in mixing.mix_report(df, t).collect()}
    assert len(report) == len(targets)
    for k, r in report.items():
        assert r["actual_tokens"] == got[k]
        assert r["docs"] == sum((m["mix_name"], m["source"]) == k for m in mix)
        assert r["most_repeats"] == max((m["repeats"] for m in mix if (m["mix_name"], m["source"]) == k), default=0)
    assert report["x", "single"]["short"] and report["m", "none"]["short"] and not report["m", "big"]["short"]
    assert abs(sum(r["actual_share"] for k, r in report.items() if k[0] == "m") - 1) < 1e-5


def test_same_whatever_the_partitions_and_empty(spark):
    _, df = corpus(spark, 200)
    t = spark.createDataFrame([("m", 0.3, "big", 0.7, 1), ("m", 0.3, "mid", 0.3, 2)], TARGETS)
    one, two = (sorted(map(tuple, mixing.mixed(d, t).collect())) for d in (df.coalesce(1), df.repartition(7)))
    assert one == two and one
    assert mixing.mixed(df.limit(0), t).count() == 0 and mixing.mixed(df, t.limit(0)).count() == 0
    assert [r["actual_tokens"] for r in mixing.mix_report(df.limit(0), t).collect()] == [0, 0]
