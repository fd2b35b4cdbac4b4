from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from colloquy.llm import truncation as tc

NOUNS = "menu layout,status screen,rubber grip,cable tray,voice prompt,risk register,login page,noise filter,test harness,budget draft".split(",")
DAYS = "Monday Tuesday Friday".split()
FORMS = ["We should move the {n} to {d} because nobody owns it.", "The {n} came back with {k} open points.", "My worry is the {n}, which still looks late to me.", "Like I said, the {n} and the {m} do not fit together.",
         "So what do we do with the {n} before anyone signs?", "Right, and who is going to check it?", "I'd rather check the {n} first and look at the {m} later.", "We've got {k} minutes left for the {n}.", "If we keep the {n}, the {m} can wait until {d}."]


def sentence(rng):
    return rng.choice(FORMS).format(n=rng.choice(NOUNS), m=rng.choice(NOUNS), d=rng.choice(DAYS), k=rng.randrange(2, 90))


def test_ends():
    shown = tc.shown_by_end
    assert [shown(x) for x in (None, "", "  \n")] == ["none"] * 3
    assert shown("We met.") == shown('He said "fine."') == shown("We met. [laughter]") == shown("I was about to say—") == shown("That depends...") == shown("Really? (applause)") == "closed"
    assert shown("We met and th…") == shown("We m�") == shown("We met [truncated]") == "marker"
    assert shown("It works for [cross") == shown("that (cough") == shown("that <noi") == "note"
    assert shown("a|b.\nspea") == shown("a|b.\nspeaker_0|") == shown("[speaker_1] a.\n[speaker_2] ") == shown("x.\nSpeaker 3") == "label"
    assert shown("We met and") == shown("We agreed on approx.") == shown("it cost 12.") == "open"


def test_against_planted_cuts(spark):
    rng = random.Random(11)
    rows, cut = [], set()
    for i in range(1200):
        text = " ".join(sentence(rng) for _ in range(rng.randrange(2, 6)))
        kind = rng.random()
        if kind < 0.15:
            at = rng.randrange(len(text) // 2, len(text) - 1)
            if text[at - 1] in ".?!" or text[at : at + 2] in (".", "?") or text[at] in ".?":
                at -= 4
            text = text[:at]
            cut.add(str(i))
        elif kind < 0.3:
            text = text[:-1]  # finished, without its full stop
        elif kind < 0.35:
            text += rng.choice([" Bye", " Thanks everyone", " No idea", " Well, the cable tray is—"])
        elif kind < 0.45:
            text = text.lower().replace(".", "").replace(",", "").replace("?", "")
            if rng.random() < 0.5:
                text = text[: rng.randrange(len(text) - 30, len(text) - 8)].rstrip()
                cut.add(str(i))
        rows.append((i, "s", text))
    scores = spark.createDataFrame(rows, "delivery_id bigint, source_name string, text string")
    replies = spark.createDataFrame([], "request_id string, source_name string, raw_text string")
    got = {r["record_id"] for r in tc.truncated(replies, scores).collect()}
    missed, wrong = cut - got, got - cut
    assert len(missed) <= 0.06 * len(cut), [rows[int(i)][2][-60:] for i in missed]
    assert len(wrong) <= 0.05 * len(cut), [rows[int(i)][2][-60:] for i in wrong]


def test_copies_rates_and_edge_cases(spark):
    long = "The cable tray came back with nine open points and everybody who was there"
    rows = [
        (1, "a", long + " agreed on it."), (2, "a", long), (3, "b", long + " agreed on it."), (4, "b", None), (5, "b", " "),
        (6, None, "We met at noon."), (7, "a", long), (8, "a", long + " agreed on it"),
    ]
    scores = spark.createDataFrame(rows, "delivery_id bigint, source_name string, text string").selectExpr("*", "1 AS key", "2 AS evidence")
    replies = spark.createDataFrame([("r1", "a", "speaker_0|Fine.\nspeaker_")], "request_id string, source_name string, raw_text string")
    got = {(r["record_kind"], r["record_id"]): r["evidence"] for r in tc.truncated(replies, scores).collect()}
    assert got == {("score", "2"): "copy", ("score", "7"): "copy", ("reply", "r1"): "label"}
    rates = {(r["record_kind"], r["source_name"]): (r["texts"], r["cut"], r["share"]) for r in tc.truncation_rates(replies, scores).collect()}
    assert rates == {("score", "a"): (4, 2, 0.5), ("score", "b"): (1, 0, 0.0), ("score", None): (1, 0, 0.0), ("reply", "a"): (1, 1, 1.0)}
    assert tc.truncated(replies.limit(0), scores.limit(0)).count() == 0
    assert tc.truncation_rates(replies.limit(0), scores.limit(0)).count() == 0


def test_sorted_successor_finds_every_prefix(spark):
    rng = random.Random(3)
    texts = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 8))) for _ in range(80)})
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    got = {r["text"]: r["next"] for r in tc.with_next(df, "text", F.lit(True)).collect()}
    even = {r["text"]: r["next"] for r in tc.with_next(df, "text", F.length("text") % 2 == 0).collect()}
    for i, t in enumerate(texts):
        assert got[t] == next(iter(texts[i + 1 :]), None)
        assert even[t] == next((o for o in texts[i + 1 :] if len(o) % 2 == 0), None)
        assert (got[t] or "").startswith(t) == any(o != t and o.startswith(t) for o in texts)


def test_any_longer_copy_counts(spark):
    """Copies that end the sentence, in whatever way, hide none that goes on with it."""
    x = "The cable tray came back with nine open points. We went on to the login page and the rest of the"
    more = [x + "!", x + ".", x + ' —. Nobody "came', x + "? Then we left.", x + ",", x + "! Then we left.", x + ", but it was late."]
    copies = lambda texts: tc.longer_copies(spark.createDataFrame([(tc.skeleton(t),) for t in texts], "skeleton string")).count()
    assert copies([x, *more]) == 1
    assert copies([x, *more[:-1]]) == 0
    fifteen = "we should move the cable tray to Monday because the login page is late and nobody"
    rows = [(1, "a", "Well, " + fifteen), (2, "a", "Well, " + fifteen + " owns it.")]
    scores = spark.createDataFrame(rows, "delivery_id bigint, source_name string, text string")
    replies = spark.createDataFrame([], "request_id string, source_name string, raw_text string")
    assert [r["evidence"] for r in tc.truncated(replies, scores).collect()] == ["copy"]


def test_broken_words_by_all_words(spark):
    shape = lambda t, end: (t, (end, t.lower().split()))
    rows = [
        shape("the menu and the mo", "open"), shape("the mo and more of it", "closed"), shape("we move on move", "open"),
        shape("the budg", "open"), shape("budgets of budgets", "closed"), shape("we met zz", "open"), shape("a moveme", "open"),
        shape("movement", "closed"),
    ]
    df = spark.createDataFrame(rows, "text string, s struct<end: string, tail: array<string>>")
    assert {r["w"] for r in tc.broken_words(df).collect()} == {"mo", "budg", "moveme"}


@pytest.mark.parametrize("text", ["word " * 40_000 + "and", "x" * 200_000])
def test_very_long_texts(spark, text):
    scores = spark.createDataFrame([(1, "a", text), (2, "a", "Fine.")], "delivery_id bigint, source_name string, text string")
    replies = spark.createDataFrame([], "request_id string, source_name string, raw_text string")
    assert {r["record_id"] for r in tc.truncated(replies, scores).collect()} <= {"1"}
