"""Assignments of utterances to streams: the least total, whatever the size of the search."""

from __future__ import annotations

import itertools
import random
from pathlib import Path

import numpy as np
import pytest

from colloquy.operators import streams, wer
from colloquy.plans import all_plans

SF = Path("/root/testdata/sf0.001")


def _stream(rng, parts, words, start=0.0):
    out = []
    for _ in range(parts):
        start += rng.uniform(0, 3)
        out.append((start, start + rng.uniform(0.5, 4), [rng.choice("abc") for _ in range(rng.randrange(words))]))
    return out


@pytest.mark.parametrize(("held", "few", "many", "often"), [(1 << 26, 24, 512, 16), (0, 1, 1, 0), (1 << 26, 1, 2, 1)])
def test_least_errors_against_brute_force(monkeypatch, held, few, many, often):
    """All assignments, free and within a collar, with and without tables of moves, however few
    assignments are looked at together."""
    monkeypatch.setattr(streams, "MOVE_BYTES", held)
    monkeypatch.setattr(streams, "FEW", few)
    monkeypatch.setattr(streams, "MANY", many)
    monkeypatch.setattr(streams, "OFTEN", often)
    rng = random.Random(5)
    code = lambda words: np.array(["abc".index(w) for w in words], np.int64)
    for _ in range(150):
        ref = _stream(rng, rng.randrange(1, 5), 6)
        hyp = [_stream(rng, rng.randrange(4), 5) for _ in range(rng.randrange(1, 4))]
        words = [[w for s in own for w in s[2]] for own in hyp]
        times = [[t for s in own for t in wer.word_times(*s)] for own in hyp]
        for near in (None, [[wer.within_collar(wer.word_times(*u), t, 1.0) for t in times] for u in ref]):
            best = 10**9
            for way in itertools.product(range(len(hyp)), repeat=len(ref)):
                total = 0
                for k, own in enumerate(words):
                    mine = [u for u, to in enumerate(way) if to == k and ref[u][2]]
                    x = [w for u in mine for w in ref[u][2]]
                    allowed = np.concatenate([near[u][k] for u in mine]) if near and x and own else None
                    total += wer.distance(x, own, allowed) if x and own else len(x) + len(own)
                best = min(best, total)
            assert streams.least_errors([code(u[2]) for u in ref], [code(w) for w in words], near) == best


def test_table_and_streams_count_alike(monkeypatch):
    rng = random.Random(8)
    for _ in range(12):
        ref = [[rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))] for _ in range(6)]
        hyp = [[rng.choice("abcdefgh") for _ in range(rng.randrange(25))] for _ in range(3)]
        got = set()
        for cells in (0, 1 << 40):
            monkeypatch.setattr(wer, "TABLE_CELLS", cells)
            got.add(wer.orc_errors(ref, hyp))
        assert len(got) == 1


def test_a_session_of_any_size_is_scored(spark):
    """Six speakers of ninety words: 1e13 cells. Of each utterance the last word is lost and all
    have other speakers, so exactly the lost words are errors where speakers do not count."""
    rng = random.Random(2)
    names = [f"w{i}" for i in range(400)]
    hyp = [("p", f"h{i % 6}", float(3 * i), float(3 * i + 3), [rng.choice(names) for _ in range(30)]) for i in range(18)]
    ref = [(s, f"r{rng.randrange(3)}", a, b, words[:-1]) for s, _, a, b, words in hyp]
    schema = "session string, speaker string, start_s double, end_s double, words array<string>"
    row = wer.session_scores(spark.createDataFrame(ref, schema), spark.createDataFrame(hyp, schema)).first()
    assert wer.orc_cells(len(ref), [["w"] * 90] * 6) > wer.MOST_CELLS
    assert (row["outcome"], row["orc"], row["tcorc"], row["ref_words"]) == ("scored", 18, 18, 18 * 29)
    assert row["cp"] > 18 and row["confusion"] > 0 and row["confusion_free"] > 0


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_no_request_is_refused(spark):
    rows = all_plans().queries["confusion_costs"](spark, str(SF)).collect()
    assert rows and not any(r["outcome"] == "refused" or r["orc"] is None or r["tcorc"] is None for r in rows)
    assert all(r["cp"] >= r["orc"] and r["tcp"] >= r["tcorc"] >= r["orc"] for r in rows)
