from __future__ import annotations

import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from colloquy.operators import carry, diarization, overlaps, sampling, scoring, slicing, statistics, wer
from pyspark.sql import functions as F


def test_census_against_brute_force(spark):
    rng = random.Random(3)
    units = sorted({(m, rng.randrange(12), rng.choice("xyz"), rng.choice("abcdef")) for m in "mn" for _ in range(120)})
    df = spark.createDataFrame(units, "meeting string, position int, speaker string, surface string")
    got = {(r["meeting"], r["position"], r["speaker"], r["surface"]): r["kind"] for r in carry.census(df).collect()}
    for m, p, s, w in units:
        own = any(u[0] == m and u[1] < p and u[2] == s and u[3] == w for u in units)
        other = any(u[0] == m and u[1] < p and u[2] != s and u[3] == w for u in units)
        assert got[m, p, s, w] == ("shared" if own and other else "exclusive" if own else "global_only" if other else "new")
    supply = carry.supply_summary(carry.census(df)).first()
    counts = sorted(sum(k[0] == m and v == "exclusive" for k, v in got.items()) for m in "mn")
    assert supply["units"] == sum(counts) and supply["q1"] == counts[round(0.25)] and supply["q3"] == counts[round(0.75)]
    assert carry.supply_summary(carry.census(df.limit(0))).first()["max_share"] == 0.0


def test_folded_glossary(spark):
    rows = [
        ("m", "k", 0, "Kay", 2, ["Kay"]), ("m", "k", 1, "KAY", 2, ["KAY"]), ("m", "k", 2, "kay", 9, ["kay", "Kay"]),
        ("m", "o", 1, "Oh", 1, ["Oh"]),
    ]
    df = spark.createDataFrame(rows, "meeting string, key string, chunk int, canonical string, evidence int, variants array<string>")
    got = {r["key"]: (r["canonical"], r["evidence"], r["first_seen"], r["variants"]) for r in carry.merged_entries(df).collect()}
    assert got == {"k": ("kay", 13, 0, ["KAY", "Kay", "kay"]), "o": ("Oh", 1, 1, ["Oh"])}
    assert [r["evidence"] for r in carry.gated(carry.merged_entries(df), 2, 5).collect()] == [5]
    arms = spark.createDataFrame([("t", ["a", "b", "c"], ["x"]), ("u", [], ["x"])], "id string, p array<string>, q array<string>")
    assert [tuple(r) for r in carry.equal_width_arms(arms, ["p", "q"]).collect()] == [("t", ["a"], ["x"], 1)]


def test_logs(spark):
    log = spark.createDataFrame(
        [("c", 1, "a", None, None), ("c", 2, "b", "a", None), ("c", 3, "d", "x", "a")],
        "chain string, seq int, entry string, previous string, supersedes string",
    )
    assert sorted(r["entry"] for r in carry.active_entries(log).collect()) == ["b", "d"]
    assert [r["entry"] for r in carry.broken_links(log, "chain", "seq").collect()] == ["d"]


def _segments(spark, rows):
    return spark.createDataFrame(
        [(m, side, s, float(a), float(b)) for m, side, s, a, b in rows],
        "meeting_id string, side string, speaker string, start_s double, end_s double",
    )


def test_error_rates_by_hand(spark):
    ref = [("m", "ref", "a", 0, 10), ("m", "ref", "b", 10, 20)]
    same = _segments(spark, ref + [("m", "hyp", "1", 0, 10), ("m", "hyp", "2", 10, 20)])
    assert [r["der"] for r in diarization.meeting_scores(same).collect()] == [0.0, 0.0]
    shifted = _segments(spark, ref + [("m", "hyp", "1", 0, 11), ("m", "hyp", "2", 11, 20)])
    got = {r["convention"]: r for r in diarization.meeting_scores(shifted).collect()}
    assert got["full"]["der"] == 1 / 20 and got["full"]["confusion_ms"] == 1000
    assert got["forgiving"]["der"] == round(0.75 / 19, 6)
    absent = _segments(spark, ref + [("m", "hyp", "1", 0, 10)])
    assert {r["der"] for r in diarization.meeting_scores(absent).collect()} == {0.5}
    assert diarization.jaccard_errors(absent).first()["jer"] == 0.5
    assert diarization.meeting_scores(absent.limit(0)).count() == 0


def test_error_rates_against_a_millisecond_grid(spark):
    rng = random.Random(5)
    rows = []
    for m in ("p", "q"):
        for side, names in (("ref", "abc"), ("hyp", "12")):
            for _ in range(14):
                s = rng.randrange(0, 2_100_000, 700)
                rows.append((m, side, rng.choice(names), s / 1000, (s + rng.randrange(700, 90_000, 700)) / 1000))
    df = _segments(spark, rows)
    got = {(r["meeting_id"], r["convention"]): r for r in diarization.meeting_scores(df, (("full", 0, False),)).collect()}
    for m in ("p", "q"):
        at = {side: {n: set() for n in names} for side, names in (("ref", "abc"), ("hyp", "12"))}
        for mm, side, n, a, b in rows:
            if mm == m:
                at[side][n] |= set(range(round(a * 1000) // 700, round(b * 1000) // 700))
        best, best_pairs = -1, []
        for perm in itertools.permutations("abc", 2):
            shared = sum(len(at["ref"][r] & at["hyp"][h]) for r, h in zip(perm, "12"))
            if shared > best:
                best, best_pairs = shared, list(zip(perm, "12"))
        total = missed = false = correct = both = 0
        for t in range(3200):
            r, h = {n for n, x in at["ref"].items() if t in x}, {n for n, x in at["hyp"].items() if t in x}
            total, missed, false = total + len(r), missed + max(0, len(r) - len(h)), false + max(0, len(h) - len(r))
            correct, both = correct + sum(a in r and b in h for a, b in best_pairs), both + min(len(r), len(h))
        row = got[m, "full"]
        assert (
            row["total_ms"], row["missed_ms"], row["false_alarm_ms"], row["correct_ms"], row["confusion_ms"],
        ) == tuple(700 * x for x in (total, missed, false, correct, both - correct))


def test_assignment_against_permutations():
    rng = np.random.default_rng(6)
    for _ in range(120):
        n, m = map(int, rng.integers(1, 6, 2))
        w = rng.integers(0, 20, (n, m)).astype(float)
        pairs = diarization.assignment(w)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        small, turned = (w, False) if n <= m else (w.T, True)
        best = max(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(max(n, m)), min(n, m)))
        assert sum(w[i, j] for i, j in pairs) == best, turned


def test_joins_against_brute_force(spark):
    rng = random.Random(7)
    spans = lambda n: [(rng.choice("kl"), i, s := rng.randrange(0, 400_000), s + rng.randrange(0, 90_000)) for i in range(n)]
    left, right = spans(60), spans(60)
    a = spark.createDataFrame(left, "k string, i int, s bigint, e bigint")
    b = spark.createDataFrame(right, "k string, j int, s2 bigint, e2 bigint")
    got = sorted((r["i"], r["j"]) for r in overlaps.overlap_join(a, b, "k").collect())
    assert got == sorted(
        (x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] < y[3] and y[2] < x[3] and x[2] < x[3] and y[2] < y[3]
    )
    points, others = [(rng.choice("kl"), rng.randrange(5_000_000)) for _ in range(80)], [("k", rng.randrange(5_000_000)) for _ in range(40)]
    pd_, od = spark.createDataFrame(points, "k string, at bigint"), spark.createDataFrame(others, "k string, at bigint")
    got = {(r["k"], r["at"]): r["distance"] for r in overlaps.nearest(pd_, od, "k", "at").collect()}
    assert got == {p: min((abs(p[1] - o[1]) for o in others if o[0] == p[0]), default=None) for p in points}
    chunks = spark.createDataFrame([("k", 0, 10, 20), ("k", 1, 20, 30)], "k string, idx int, s bigint, e bigint")
    at = spark.createDataFrame([("k", 5), ("k", 10), ("k", 29), ("k", 30), ("z", 1)], "k string, at bigint")
    assert {r["at"]: r["idx"] for r in overlaps.containing(at, chunks, "k", "at").collect()} == {5: 0, 10: 0, 29: 1, 30: 1, 1: None}
    assert {r["at"]: r["idx"] for r in overlaps.containing(at, chunks, "k", "at", clamp_first=False).collect()}[5] == 1


def test_slice_plans():
    assert slicing.grid(0, 300, (), 90, 60, 120, 3) == [(0, 90), (90, 180), (180, 300)]
    assert slicing.grid(0, 200, (88, 93), 90, 60, 120, 3) == [(0, 88), (88, 200)]
    assert slicing.grid(0, 50, (), 90, 60, 120, 3) == [(0, 50)]
    rng = random.Random(8)
    for _ in range(200):
        turns, at = [], 0
        for _ in range(rng.randrange(1, 30)):
            at += rng.randrange(0, 15)
            turns.append((at, at + rng.randrange(1, 40)))
            at = turns[-1][1]
        slices = slicing.packed(turns, 0, at, 90, 60, 120, 3)
        assert all(b - a <= 120 for a, b in slices) and all(x[1] <= y[0] for x, y in zip(slices, slices[1:]))
        assert all(any(a <= s and e <= b for a, b in slices) for s, e in turns)
        chunks = slicing.chunked(turns, 360, 180, 900)
        assert chunks[0][0] == turns[0][0] and chunks[-1][1] == turns[-1][1] and all(x[1] == y[0] for x, y in zip(chunks, chunks[1:]))
        assert all(360 <= b - a <= 900 for a, b in chunks[:-1])
    six = [(i * 600, i * 600 + 600) for i in range(7)]
    assert slicing.chunked(six, 1800, 600, 3600) == [(0, 1800), (1800, 3600), (3600, 4200)]
    assert slicing.chunked(six, 1800, 700, 3600) == [(0, 1800), (1800, 4200)]
    ten = [(i * 600, i * 600 + 600) for i in range(10)]
    assert slicing.chunked(ten, 1800, 600, 3600, [2350]) == [(0, 1800), (1800, 2350), (2350, 4200), (4200, 6000)]
    assert slicing.chunked(ten, 2000, 600, 3600, [2350, 1650]) == [(0, 2350), (2350, 4800), (4800, 6000)] or slicing.chunked(ten, 2000, 600, 3600, [2350, 1650])[0] in ((0, 2350), (0, 1650))
    assert slicing.chunked([(0, 100), (100, 1100), (1100, 1300)], 360, 180, 900) == [(0, 100), (100, 1100), (1100, 1300)]  # within most, or whole
    assert slicing.chunked([(0, 5_000)], 360, 180, 900) == [(0, 5_000)] and slicing.chunked([], 360, 180, 900) == []
    assert slicing.packed([(0, 500)], 0, 500, 90, 60, 120, 3)[-1][1] == 500
    assert slicing.next_fit([1000, 1500, 600, 3000], 3000) == [0, 0, 1, 2]
    with pytest.raises(ValueError):
        slicing.next_fit([3001], 3000)


def test_word_errors():
    assert wer.cp_errors([["a", "b"], ["c"]], [["c"], ["a", "x"]]) == 1
    assert wer.cp_errors([["a"]], []) == 1 and wer.cp_errors([], [["a", "b"]]) == 2 and wer.cp_errors([], []) == 0
    assert wer.orc_errors([["a"], ["b"]], [["a"], ["b"]]) == 0 and wer.orc_errors([["a"], ["b"]], [["b", "a"]]) == 2
    assert wer.orc_errors([["a"]] * 10, [["a"] * 3000] * 4) is None
    rng = random.Random(9)
    for _ in range(60):
        ref = [[rng.choice("ab") for _ in range(rng.randrange(3))] for _ in range(3)]
        hyp = [[rng.choice("ab") for _ in range(rng.randrange(4))] for _ in range(2)]
        best = min(
            sum(
                wer.distance(sum((r for r, s in zip(ref, way) if s == k), []), hyp[k]) for k in range(2)
            ) for way in itertools.product(range(2), repeat=3)
        )
        assert wer.orc_errors(ref, hyp) == best
    near = wer.within_collar([(0, 1), (9, 10)], [(3, 4)], 3)
    assert near.tolist() == [[True], [False]] and wer.distance(["a", "b"], ["b"], near) == 2 and wer.distance(["a", "b"], ["b"]) == 1
    assert wer.word_times(0, 4, ["ab", "cd"]) == [(0, 2.0), (2.0, 4.0)]


def test_batches(spark):
    rows = [("a", 1, 1000.0), ("a", 2, 1500.0), ("a", 3, 600.0), ("a", 4, 3000.0), ("a", 5, None), ("b", 1, 5.0)]
    df = spark.createDataFrame(rows, "g string, n int, c double")
    got = {(r["g"], r["n"]): (r["c"], r["batch"]) for r in slicing.next_fit_batches(df, ["g"], ["n"], "c", 3000).collect()}
    assert got == {
        ("a", 1): (1000.0, 0), ("a", 2): (1500.0, 0), ("a", 3): (600.0, 1), ("a", 4): (3000.0, 2), ("a", 5): (None, 2), ("b", 1): (5.0, 0),
    }
    with pytest.raises(Exception, match="over the cap"):
        slicing.next_fit_batches(df, ["g"], ["n"], "c", 2999).collect()
    assert slicing.next_fit_batches(df.limit(0), ["g"], ["n"], "c", 3000).count() == 0


def test_chunks_with_marks(spark):
    turns = spark.createDataFrame(
        [("a", 0.0, 300.0), ("a", 300.0, 420.0), ("a", 420.0, 800.0), ("b", 0.0, 10.0)], "uniq_id string, start_s double, end_s double",
    )
    marks = spark.createDataFrame([("a", 310_000), ("a", None), ("z", 1)], "uniq_id string, at_ms bigint")
    cut = lambda *m: sorted((r["uniq_id"], r["start_ms"], r["end_ms"]) for r in slicing.task_chunks(turns, *m).collect())
    assert cut() == [("a", 0, 420_000), ("a", 420_000, 800_000), ("b", 0, 10_000)]
    assert cut(marks) == [("a", 0, 310_000), ("a", 310_000, 800_000), ("b", 0, 10_000)]


def test_very_long_intervals(spark):
    """An interval of three thousand years is a few rows, not billions."""
    age = 10**14
    rows = [("k", 0, age), ("k", 5, 10), ("k", age // 2, age // 2 + 40_000), ("k", 10**9, 10**9 + 10**8), ("m", 0, 1)]
    a = spark.createDataFrame(rows, "k string, s bigint, e bigint")
    b = spark.createDataFrame(rows, "k string, s2 bigint, e2 bigint")
    got = sorted((r["s"], r["e"], r["s2"], r["e2"]) for r in overlaps.overlap_join(a, b, "k").where("k = 'k'").collect())
    assert got == sorted((x[1], x[2], y[1], y[2]) for x in rows for y in rows if x[0] == y[0] == "k" and x[1] < y[2] and y[1] < x[2])
    segments = _segments(spark, [("m", "ref", "A", 0.0, 1e11), ("m", "hyp", "x", 5.0, 6.0), ("m", "hyp", "y", 1e10, 1e10 + 1.5)])
    r = {x["convention"]: x for x in diarization.meeting_scores(segments).collect()}["full"]
    assert (r["total_ms"], r["missed_ms"], r["correct_ms"], r["confusion_ms"]) == (10**14, 10**14 - 2500, 1500, 1000)


def test_session_scores_against_brute_force(spark):
    rng = random.Random(4)
    cut = lambda n, who: [(s, who(s), float(t), float(t + 2), [rng.choice("ab") for _ in range(rng.randrange(3))]) for s in "pqrs" for t in rng.sample(range(0, 40, 3), n)]
    ref, hyp = cut(3, lambda _: rng.choice("AB")), cut(3, lambda _: rng.choice("xy"))
    ref.append(("only ref", "A", 0.0, 1.0, ["a"]))
    hyp.append(("only hyp", "x", 0.0, 1.0, ["a"]))
    schema = "session string, speaker string, start_s double, end_s double, words array<string>"
    got = {r["session"]: r for r in wer.session_scores(spark.createDataFrame(ref, schema), spark.createDataFrame(hyp, schema), 5.0).collect()}
    assert (got["only ref"]["outcome"], got["only ref"]["cp"], got["only ref"]["tcorc"]) == ("no_hypothesis", 1, 1)
    assert (got["only hyp"]["outcome"], got["only hyp"]["cp_wer"], got["only hyp"]["confusion"]) == ("no_reference", None, None)

    def timed(own):
        own = sorted(own, key=lambda s: s[:2])
        return [w for s in own for w in s[2]], [t for s in own for t in wer.word_times(*s)]

    for session in "pqrs":
        own = sorted((s[2:] for s in ref if s[0] == session and s[4]), key=lambda s: s[:2])
        streams = {}
        for s in hyp:
            if s[0] == session:
                streams.setdefault(s[1], []).append(s[2:])
        other = list(streams.values())
        r = got[session]
        if not own or not any(s[2] for o in other for s in o):
            continue
        best = {False: 10**9, True: 10**9}
        for way in itertools.product(range(len(other)), repeat=len(own)):
            for strict in best:
                total = 0
                for k, stream in enumerate(other):
                    x, tx = timed([s for s, to in zip(own, way) if to == k])
                    y, ty = timed(stream)
                    total += wer.distance(
                        x, y, wer.within_collar(tx, ty, 5.0) if strict and x and y else None,
                    ) if x and y else len(x) + len(y)
                best[strict] = min(best[strict], total)
        assert (r["orc"], r["tcorc"]) == (best[False], best[True]) and r["tcp"] >= r["cp"] and r["tcorc"] >= r["orc"]
    few = wer.session_scores(spark.createDataFrame(ref, schema), spark.createDataFrame(hyp, schema), 5.0, 1).where("session = 'p'").first()
    assert (few["outcome"], few["orc"], few["tcorc"]) == ("refused", None, None) and few["cp"] == got["p"]["cp"]


def test_time_constrained_errors():
    ref = [[(0.0, 2.0, ["a", "b"])], [(3.0, 4.0, ["c"])]]
    assert wer.tcp_errors(ref, [[(3.0, 4.0, ["c"])], [(0.0, 2.0, ["a", "b"])]]) == 0
    assert wer.tcp_errors(ref, [[(60.0, 62.0, ["a", "b"])], [(3.0, 4.0, ["c"])]]) == 4  # right words, wrong time
    assert wer.tcp_errors([], [[(0.0, 1.0, ["x"])]]) == 1 and wer.tcp_errors([], []) == 0


def test_slice_outcomes(spark):
    df = spark.createDataFrame([(0, 3, 1.0), (2, 0, 1.0), (2, 2, 3e9), (2, 2, 5.0)], "r int, h int, c double")
    assert [r["o"] for r in df.select(wer.slice_outcome(F.col("r"), F.col("h"), F.col("c")).alias("o")).collect()] == ["no_reference", "no_hypothesis", "refused", "scored"]


def test_speaker_word_errors(spark):
    ref = spark.createDataFrame(
        [("s", 0, 1, ["b"]), ("s", 0, 0, ["a"]), ("s", 1, 2, ["c"]), ("t", 0, 0, ["x"])],
        "session string, speaker int, ordinal int, words array<string>",
    )
    hyp = spark.createDataFrame([("s", 5, 0, ["c"]), ("s", 6, 0, ["a", "b"]), ("u", 1, 0, ["y"])], ref.schema)
    got = {r["session"]: (r["errors"], r["ref_words"], r["cp_wer"]) for r in wer.cp_wer(ref, hyp).collect()}
    assert got == {"s": (0, 3, 0.0), "t": (1, 1, 1.0), "u": (1, 0, None)}


def test_scores(spark):
    rows = [("t1", "u", "A", 1, 2, 0, 1, 1, 1, 0), ("t2", "u", "A", None, None, 0, 0, None, 0, 1)]
    df = spark.createDataFrame(
        rows,
        "target_id string, uniq_id string, arm string, wer_errors int, wer_tokens int, carry_errors int, carry_tokens int, carry_hits int, carry_total int, false_hint_target int",
    )
    r = scoring.pooled_metrics(df, ["arm"]).first()
    assert (r["wer"], r["carry_wer"], r["hit_rate"], r["false_hint_rate"]) == (0.5, 0.0, 1.0, 0.5)
    cells = scoring.completeness(df, ["A", "B"], df, ["target_id"], ["wer_errors"])
    assert {(r["target_id"], r["arm"]): r["found"] for r in cells.collect()} == {
        ("t1", "A"): True, ("t1", "B"): False, ("t2", "A"): True, ("t2", "B"): False,
    }
    with pytest.raises(Exception, match="more than once"):
        scoring.completeness(df, ["A"], df.union(df), ["target_id"], ["wer_errors"], "raise").collect()
    gold = spark.createDataFrame([("a", ["x"]), ("b", ["x", "y"]), ("c", ["x"]), ("d", ["x"])], "sentence string, speakers array<string>")
    said = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z"), ("e", "x")], "sentence string, speaker string")
    got = {r["sentence"]: r["outcome"] for r in scoring.attribution(gold, said).collect()}
    assert got == {"a": "correct", "b": "ambiguous", "c": "wrong", "d": "unattributed", "e": "hallucinated"}
    pairs = spark.createDataFrame([("a", "a"), ("b", "g"), ("g", "x"), (None, "g")], "ref string, hyp string")
    r = scoring.pair_errors(pairs, spark.createDataFrame([("g",)], "term string")).first()
    assert (r["induced"], r["b_tokens"], r["b_errors"], r["u_tokens"], r["u_errors"], r["insertions"]) == (1, 1, 1, 2, 1, 1)
    active = scoring.activation(
        spark.createDataFrame([(["a", "b"], ["a"], ["a", "b", "c", "b"])], "h array<string>, r array<string>, t array<string>"), "h", "r",
        "t",
    ).first()
    assert (active["activated"], active["unsupported"]) == (2, 1)


def test_statistics(spark):
    values = [5, 1, 4, 4, 2, 9, 9, 3, 7, 10]
    r = statistics.cluster_summary(spark.createDataFrame([(v,) for v in values], "v int"), "v").first()
    assert (r["n"], r["mean"], r["median"], r["p90"], r["most"]) == (10, 5.4, 4.5, 9.0, 10.0)
    array = spark.createDataFrame([(sorted(values),)], "a array<int>").select(
        statistics.ceil_rank(F.col("a"), 0.9).alias("c"), statistics.floor_rank(F.col("a"), 0.5).alias("f"),
    ).first()
    assert (array["c"], array["f"]) == (9, 5)
    clusters = spark.createDataFrame([(f"c{i}", float(i), 1.0) for i in range(6)], "c string, x double, n double")
    one = [tuple(r) for r in statistics.bootstrap(clusters, "c", ["x", "n"], 30, "s").orderBy("r").collect()]
    two = [tuple(r) for r in statistics.bootstrap(clusters.repartition(5), "c", ["x", "n"], 30, "s").orderBy("r").collect()]
    assert one == two and all(r[2] == 6.0 for r in one)
    bound = spark.createDataFrame([(3, [1, 2])], "u int, w array<int>").select(
        statistics.orc_bound(F.col("u"), F.col("w")).alias("b"), statistics.prompt_tokens(F.lit(90.5)).alias("p"),
    ).first()
    assert (bound["b"], bound["p"]) == (18.0, 90 * 13 + 950 + 362)


def test_samples_do_not_depend_on_partitions(spark):
    ids = [(f"id{i}", f"g{i % 3}", 1 + i % 4) for i in range(100)]
    df = spark.createDataFrame(ids, "id string, g string, m int")
    for make in (
        lambda d: sampling.capped(d, "id", "s", 10), lambda d: sampling.derangement(d, "id", "s", ["g"]),
        lambda d: sampling.round_robin(d, "id", "g", "s", 9),
        lambda d: sampling.prefix_of_mass(d, "id", "m", 20, "s", ["g"]), lambda d: sampling.ranked_split(d, "id", "s", {"a": 7, "b": 5}),
        lambda d: sampling.last_rows(d, "g", ["m", "id"], 2),
    ):
        one, two = (sorted(map(tuple, make(d).collect())) for d in (df.coalesce(1), df.repartition(6)))
        assert one == two and one
    import hashlib

    digest = lambda s, x: hashlib.md5(f"{s}:{x}".encode()).hexdigest()
    for within in (["g"], []):
        groups = {}
        for i, g, m in sorted(ids, key=lambda x: digest("s", x[0])):
            groups.setdefault(g if within else None, []).append((i, m))
        want = {i: own[(n + 1) % len(own)][0] for own in groups.values() for n, (i, _) in enumerate(own)}
        assert {r["id"]: r["partner"] for r in sampling.derangement(df, "id", "s", within).collect()} == want
        kept = {i for own in groups.values() for n, (i, _) in enumerate(own) if sum(m for _, m in own[:n]) < 20}
        assert {r["id"] for r in sampling.prefix_of_mass(df, "id", "m", 20, "s", within).collect()} == kept
    nulls = spark.createDataFrame([("a", None), ("b", None), ("c", "g")], "id string, g string")
    assert {r["id"]: r["partner"] for r in sampling.derangement(nulls, "id", "s", ["g"]).collect()} == {"a": "b", "b": "a", "c": None}
    pairs = sampling.derangement(df, "id", "s", ["g"]).collect()
    assert all(r["id"] != r["partner"] for r in pairs) and len({r["partner"] for r in pairs}) == 100
    assert sampling.derangement(df.limit(1), "id", "s", ["g"]).first()["partner"] is None
    robin = sampling.round_robin(df, "id", "g", "s", 9).collect()
    assert sorted(r["g"] for r in robin) == ["g0"] * 3 + ["g1"] * 3 + ["g2"] * 3
    for g in ("g0", "g1", "g2"):
        kept = [r for r in sampling.prefix_of_mass(df, "id", "m", 20, "s", ["g"]).collect() if r["g"] == g]
        assert sum(r["m"] for r in kept) >= 20 and sum(r["m"] for r in kept) - max(kept, key=lambda r: r["upto"])["m"] < 20


def test_hashed_head(spark):
    df = spark.createDataFrame([(f"t{i}",) for i in range(5_000)], "t string")
    one, two = (sorted(r["t"] for r in sampling.hashed_head(d, "t", 40, 5_000).collect()) for d in (df.coalesce(1), df.repartition(9)))
    assert one == two and len(one) == 40
    assert sampling.hashed_head(df, "t", 40, 10).count() == 40 and sampling.hashed_head(df.limit(0), "t", 4, 0).count() == 0


def test_seconds_and_pins(spark):
    df = spark.createDataFrame(
        [(10.0, 50.0, [(1.0,), (None,), (2.5,)]), (-1.0, 200.0, None), (10.0, None, [])],
        "w double, u double, a array<struct<latency: double>>",
    )
    got = [(r["d"], r["s"]) for r in df.select(statistics.device_seconds(F.col("w"), F.col("u")).alias("d"), statistics.attempt_seconds(F.col("a")).alias("s")).collect()]
    assert got == [(5.0, 3.5), (0.0, 0.0), (0.0, 0.0)]
    assert wer.Pins().pin_hash() == wer.Pins().pin_hash() != wer.Pins(collar_seconds=0.0).pin_hash()


def test_numbers_in_order(spark):
    df = spark.createDataFrame([(f"k{i:03}",) for i in range(57)], "k string").repartition(5)
    rows, n = statistics.numbered(df, "k")
    assert n == 57 and [r["_i"] for r in rows.orderBy("k").collect()] == list(range(57))
    empty, none = statistics.numbered(df.limit(0), "k")
    assert none == 0 and empty.count() == 0


def test_states_and_sources(spark):
    rows = spark.createDataFrame(
        [("x", ["a", "b", "c"], ["a", "b"], ["a"], ["a", "d"]), ("x", None, ["a"], None, ["a"]), ("y", [], [], [], [])],
        "arm string, t array<string>, s array<string>, same array<string>, other array<string>",
    )
    got = {r["arm"]: r for r in carry.state_scores(rows, ["arm"], "t", "s", "same", "other").collect()}
    x = got["x"]
    assert (
        x["targets"], x["terms"], x["supported_terms"], x["hallucinated_terms"], x["off_speaker_terms"], x["target_relevant_terms"],
        x["same_targets"], x["same_target_hits"], x["global_targets"], x["global_target_hits"],
    ) == (2, 3, 2, 1, 1, 1, 1, 1, 3, 1)
    assert (x["support_precision"], x["same_target_recall"]) == (0.666667, 1.0) and got["y"]["hallucination_rate"] is None
    entries = spark.createDataFrame(
        [
            ("m", "k", 0, "K", 1, ["K"], "speech", None, "A"), ("m", "k", 2, "kk", 3, ["kk"], "speech", None, "B"),
            ("m", "k", 1, "K2", 1, ["K2"], "slides", "t1", None),
        ],
        "meeting string, key string, chunk int, canonical string, evidence bigint, variants array<string>, provenance string, tier string, introduced_by string",
    )
    got = {(r["provenance"], r["tier"]): (r["key"], r["canonical"], r["evidence"], r["first_seen"], r["introduced_by"]) for r in carry.merged_by_source(entries).collect()}
    assert got == {("speech", None): ("k", "kk", 4, 0, "A"), ("slides", "t1"): ("k", "K2", 1, 1, None)}


def test_faults(spark):
    rows = [
        ("ok", "a", 0, 0.0, 1.0), ("ok", "a", 1, 1.0, 2.0), ("zero", "a", 0, 0.0, 0.0), ("pair", "a", 0, 1.0, 2.0),
        ("pair", "b", 1, 1.0, 2.0), ("back", "a", 0, 5.0, 6.0), ("back", "a", 1, 1.0, 2.0), ("rev", "a", 0, 2.0, 1.0),
    ]
    df = spark.createDataFrame(rows, "s string, who string, n int, a double, b double")
    got = {r["s"]: (r["valid"], r["all_zero"], r["one_pair"], r["reversed"], r["disordered"]) for r in overlaps.stream_faults(df, "s", "who", "n", "a", "b").collect()}
    assert got == {
        "ok": (True, False, False, False, False), "zero": (False, True, False, False, False), "pair": (False, False, True, False, False),
        "back": (False, False, False, False, True), "rev": (False, False, False, True, False),
    }


def _shared_by_pairs(periods):
    out: dict = {}
    for m, side, a, s, e in periods:
        for m2, side2, b, s2, e2 in periods:
            if (m, side, side2) == (m2, "ref", "hyp") and (ms := min(e, e2) - max(s, s2)) > 0:
                out[m, a, b] = out.get((m, a, b), 0) + ms
    return out


def test_shared_times_in_blocks_and_tiles(spark, monkeypatch):
    """Blocks of few speakers and narrow tiles give what comparing all pairs gives."""
    rng = random.Random(11)
    rows = []
    for m, n, span in (("m", 9, 50_000), ("n", 2, 10**13), (None, 3, 1_000)):
        for side in ("ref", "hyp"):
            for k in range(n):
                at = sorted(rng.sample(range(span), 12))
                rows += [(m, side, f"{side}{k}", s, e) for s, e in zip(at[::2], at[1::2])]
    rows.append(("only", "ref", "A", 0, 5))
    df = spark.createDataFrame(rows, "meeting_id string, side string, speaker string, s bigint, e bigint")
    monkeypatch.setattr(diarization, "BLOCK_PERIODS", 16)
    monkeypatch.setattr(diarization, "BLOCK_SPEAKERS", 2)
    monkeypatch.setattr(diarization, "SHARE_MS", 1 << 10)
    assert {r["block"] for r in diarization.numbered_speakers(df).collect()} > {0, 1, 2}
    want = _shared_by_pairs([r for r in rows if r[0] is not None])
    got = {(r["meeting_id"], r["ref_speaker"], r["hyp_speaker"]): r["ms"] for r in diarization.speaker_overlap(df).collect()}
    assert got == want
    for m in ("m", "n"):
        refs, hyps = (sorted({r[2] for r in rows if r[:2] == (m, side)}) for side in ("ref", "hyp"))
        w = np.array([[want.get((m, a, b), 0) for b in hyps] for a in refs], float)
        best = sum(w[i, j] for i, j in diarization.assignment(w))
        pairs = [r for r in diarization.speaker_mapping(df).collect() if r["meeting_id"] == m]
        assert sum(want[m, r["ref_speaker"], r["hyp_speaker"]] for r in pairs) == best
        assert len({r["ref_speaker"] for r in pairs}) == len({r["hyp_speaker"] for r in pairs}) == len(pairs)


def test_a_meeting_of_many_speakers_is_never_a_row(spark):
    """A meeting in which 400 speakers a side all share time: rows of shared times hold one
    reference speaker each, and the mapping is a bijection of most time."""
    n = 400
    seats = spark.range(n).selectExpr("'m' meeting_id", "id", "concat('seat', id) speaker")
    ref = seats.selectExpr("meeting_id", "'ref' side", "speaker", "id s", "id + 1000 e")
    hyp = seats.selectExpr("meeting_id", "'hyp' side", "speaker", "id s", "id + 1000 e")
    periods = ref.unionByName(hyp)
    _, rows = diarization.shared(periods)
    sizes = rows.selectExpr("r", "size(h) n").collect()
    assert len(sizes) == n and max(r["n"] for r in sizes) <= n
    pairs = diarization.speaker_mapping(periods).collect()
    assert len(pairs) == n and all(r["ref_speaker"] == r["hyp_speaker"] for r in pairs)


def test_pair_distances_are_distances(monkeypatch):
    """All pairs at once, in parts, give what each pair gives, free and within the collar."""
    rng = random.Random(13)
    for cells in (1, 1 << 22):
        monkeypatch.setattr(wer, "PAIR_CELLS", cells)
        for _ in range(20):
            ref, hyp = ([[rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(rng.randrange(4))] for _ in range(2))
            times = tuple([[(t, t + 1.0) for t in sorted(rng.uniform(0, 20) for _ in own)] for own in side] for side in (ref, hyp))
            got = wer.pair_distances(ref, hyp, times, 1.5)
            for i, a in enumerate(ref):
                for j, b in enumerate(hyp):
                    near = wer.within_collar(times[0][i], times[1][j], 1.5)
                    assert (got[0, i, j], got[1, i, j]) == (wer.distance(a, b), wer.distance(a, b, near))
    table = np.array([[rng.randrange(50) for _ in range(300)] for _ in range(11)])
    want = np.minimum.accumulate(table, axis=0)
    wer.running_least(table)
    assert (table == want).all()


def test_session_scores_do_not_depend_on_partitions(spark):
    """Segments of the same times are taken in the order of their ordinals."""
    schema = "session string, ordinal int, speaker string, start_s double, end_s double, words array<string>"
    rows = [("p", i, "A", 0.0, 9.0, [w]) for i, w in enumerate("dbca")]
    ref = spark.createDataFrame(rows, schema)
    for way in (rows, rows[::-1]):
        r = wer.session_scores(ref, spark.createDataFrame(way, schema).repartition(3)).first()
        assert (r["cp"], r["tcp"], r["orc"], r["tcorc"]) == (0, 0, 0, 0)


def test_full_errors_of_a_crowded_meeting(spark):
    """Speakers in several blocks: the totals are those of the best mapping, whatever the names."""
    n = 700
    rows = [("m", "ref", f"r{i}", float(i % 7), float(i % 7 + 5)) for i in range(n)] + [("m", "hyp", f"h{i}", float(i % 7), float(i % 7 + 5)) for i in range(n)]
    segments = _segments(spark, rows)
    blocks = diarization.numbered_speakers(diarization.side_periods(segments)).select("block").distinct().count()
    r = diarization.meeting_scores(segments, (("full", 0, False),)).first()
    assert blocks == 2 and (r["total_ms"], r["correct_ms"], r["der"]) == (n * 5000, n * 5000, 0.0)
    pool = diarization.pooled(diarization.meeting_scores(segments, (("full", 0, False),))).first()
    assert (pool["meetings"], pool["correct_ms"], pool["der"]) == (1, n * 5000, 0.0)


def test_the_mapping_of_a_crowded_meeting_holds_no_matrix(monkeypatch):
    """Shared times of 1,200 speakers a side, a row a reference speaker and block, take less
    memory than a quarter of their matrix, and the mapping is the best one."""
    n, parts = 1200, 3
    rng = np.random.default_rng(5)
    hidden, held = rng.permutation(n), 1 << 18
    monkeypatch.setattr(diarization, "HELD_BYTES", held, raising=False)

    def batches():
        for i in range(n):
            ms = rng.integers(1, 1000, n)
            ms[hidden[i]] = 5000
            h = np.array_split(np.arange(n, dtype=np.int32), parts)
            columns = [pa.array(["m"] * parts), pa.array([i] * parts, pa.int32()), pa.array(h, pa.list_(pa.int32())), pa.array(np.array_split(ms, parts), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["meeting_id", "r", "h", "ms"])

    tracemalloc.start()
    try:
        rows = [x for b in diarization._mapped(batches()) for x in b.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert {(x["meeting_id"], x["r"], x["h"]) for x in rows} == {("m", i, int(hidden[i])) for i in range(n)} and len(rows) == n
    assert peak < n * n * 8 / 4


def test_crowded_and_small_meetings_of_one_task(monkeypatch):
    """Meetings that pass through one task, as for the pooled rate: each has its best mapping,
    whatever is in files, in parts of time, beyond 32 bits or without a partner."""
    rng = np.random.default_rng(8)
    monkeypatch.setattr(diarization, "HELD_BYTES", 1 << 14, raising=False)
    shapes = {"a": (5, 9), "b": (800, 640), "c": (640, 800), "d": (7, 3)}
    weights = {m: rng.integers(0, 50, s) for m, s in shapes.items()}
    weights["b"][::3, :5] += 1 << 33
    kind = [pa.list_(pa.int32()), pa.list_(pa.int64())]

    def batches():
        for m, w in weights.items():
            for i in range(len(w)):
                cells = [np.flatnonzero(x) for x in (w[i] // 2, w[i] - w[i] // 2)]  # two tiles of time
                times = [w[i][cells[0]] // 2, (w[i] - w[i] // 2)[cells[1]]]
                own = [(h.astype(np.int32), x) for h, x in zip(cells, times) if len(h)]
                if own:
                    columns = [pa.array([m] * len(own)), pa.array([i] * len(own), pa.int32()), *[pa.array(list(x), k) for x, k in zip(zip(*own), kind)]]
                    yield pa.RecordBatch.from_arrays(columns, ["meeting_id", "r", "h", "ms"])

    tracemalloc.start()
    try:
        rows = [x for b in diarization._mapped(batches()) for x in b.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    for m, w in weights.items():
        pairs = [(x["r"], x["h"]) for x in rows if x["meeting_id"] == m]
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        flipped = diarization.assignment(np.ascontiguousarray(w.T))
        assert sum(w[i, j] for i, j in pairs) == sum(w[i, j] for j, i in flipped)
    assert peak < 800 * 640 * 8 / 2


def _swept(spans, collar):
    """Times of each state of (ref, hyp, match, within a collar), moment by moment."""
    out: dict = {}
    for m in {x[0] for x in spans}:
        own = [x[1:] for x in spans if x[0] == m]
        own += [("collar", b - collar, b + collar) for k, s, e in own if k == "ref" and collar for b in (s, e)]
        at = sorted({b for _, s, e in own for b in (s, e)})
        for low, high in zip(at, at[1:]):
            n = [sum(k == kind and s <= low and high <= e for k, s, e in own) for kind in ("ref", "hyp", "match", "collar")]
            if n[0] or n[1]:
                state = (m, *n[:3], n[3] > 0)
                out[state] = out.get(state, 0) + high - low
    return out


def test_a_sweep_stores_spans_and_no_moments(spark, monkeypatch):
    """Events of one moment, tiles without events, times before 0 and meetings without an id:
    the states are those of a sweep by hand, and what is stored is at most a row a span."""
    rng = random.Random(17)
    rows = []
    for m, n, span in (("m", 40, 3_000), ("n", 20, 10**9), (None, 9, 400_000)):
        for side in ("ref", "hyp"):
            for k in range(n // 4 + 1):
                at = sorted(rng.sample(range(-span // 3, span), 8))
                rows += [(m, side, f"{side}{k}", s, e) for s, e in zip(at[::2], at[1::2])]
    matched = [(m, who, s, (s + e) // 2 + 1) for m, side, who, s, e in rows if side == "ref" and s % 2]
    periods = spark.createDataFrame(rows, "meeting_id string, side string, speaker string, s bigint, e bigint")
    pairs = spark.createDataFrame(matched, "meeting_id string, ref_speaker string, s bigint, e bigint")
    stored, keep = [], diarization.stored_table

    def counted(df, *names):
        out = keep(df, *names)
        stored.append(out.count())
        return out

    monkeypatch.setattr(diarization, "stored_table", counted)
    spans = [(m, side, s, e) for m, side, _, s, e in rows] + [(m, "match", s, e) for m, _, s, e in matched]
    for collar in (0, 250):
        got: dict = {}
        for r in diarization.elementary(periods, pairs, collar).collect():
            state = (r["meeting_id"], r["n_ref"], r["n_hyp"], r["n_match"], r["n_collar"] > 0)
            got[state] = got.get(state, 0) + r["ms"]
        assert got == _swept(spans, collar)
    assert stored and max(stored) <= len(spans)


def test_shared_times_of_many_blocks_are_handed_on(monkeypatch):
    """Of a batch of 24 pairs of blocks, in which 128 speakers a side all share time, no more is
    held than one pair and SHARED_CELLS; small pairs go on together."""
    n, pairs, most = 128, 24, 1 << 12
    monkeypatch.setattr(diarization, "SHARED_CELLS", most, raising=False)
    item = pa.struct([("no", pa.int32()), ("s", pa.int64()), ("e", pa.int64())])

    def batch(n):
        own = pa.array([[{"no": k, "s": k, "e": k + 1000} for k in range(n)]] * pairs, pa.list_(item))
        return pa.RecordBatch.from_arrays([pa.array([f"m{i}" for i in range(pairs)]), own, own], ["meeting_id", "_r", "_h"])

    parts = [x for x in diarization._shared(iter([batch(n)])) if len(x)]
    assert len(parts) == pairs and max(len(x.column("h").flatten()) for x in parts) <= most + n * n
    seen = [(x["meeting_id"], x["r"], len(x["h"]), sum(x["ms"])) for p in parts for x in p.to_pylist()]
    assert sorted(seen) == sorted((f"m{i}", k, n, sum(1000 - abs(k - j) for j in range(n))) for i in range(pairs) for k in range(n))
    assert [len(x) for x in diarization._shared(iter([batch(2), batch(0)]))] == [2 * pairs]
