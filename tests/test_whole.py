"""Queries that must pass every row, on written tables with cases that were dropped before."""

from __future__ import annotations

import re
import string

from colloquy.functions import text
from colloquy.plans import all_plans


def run(spark, folder, name, **tables):
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
    return all_plans().queries[name](spark, str(folder)).collect()


TEXTS = [
    "The menu, one of 1,200", "It’s the café’s twenty\u00a0one — an “old” plan", "créa la the", "我们 needs three 页面。\u3000ten",
    "Straße, Ökonomie: an ÉA", "Speaker 2: naïve the", "naïve\u2003\u2003a", "", "🙂 five", None,
]


def answer(t):
    t = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", re.sub(r"(?<=\d),(?=\d{3})", "", t.lower()))).strip()
    return " ".join(text.NUMBER_WORDS.get(w, w) for w in t.split(" "))


def span(t):
    plain = "".join(c for c in re.sub("Speaker [0-9]*: ", "", t).lower() if c not in string.punctuation)
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", plain).split())


def test_texts_in_any_script(spark, tmp_path):
    rows = list(enumerate(TEXTS))
    said = {i: t for i, t in rows if t is not None}
    got = run(spark, tmp_path, "normal_answers", direction_scores=(rows, "delivery_id int, text string"))
    assert {r["delivery_id"]: r["answer"] for r in got} == {i: answer(t) for i, t in said.items()}
    got = run(spark, tmp_path, "normal_spans", parse_results=(rows, "request_id int, raw_text string"))
    assert {r["request_id"]: r["span"] for r in got} == {i: span(t) for i, t in said.items()}
    got = run(spark, tmp_path, "token_counts", documents=(rows, "doc_id int, text string"))
    assert {r["doc_id"]: (r["tokens"], r["estimate"]) for r in got} == {i: (len(re.findall("[a-z0-9]+", t.lower())), -(-len(t) // 4)) for i, t in said.items()}


def test_claims_from_the_reference_threshold(spark, tmp_path):
    turns = [("u", 0, "s", "a b c d e f"), ("u", 1, "s", "k l m n o p q r")]
    segments = [("r", "u", 0, "a b x y z w"), ("r", "u", 1, "k l 1 2 3 4 5 6")]  # F1 of 1/3 and 1/4
    got = run(
        spark, tmp_path, "claimed_turns", score_turns=(turns, "uniq_id string, turn_index int, speaker_id string, reference_text string"),
        transcribed_segments=(segments, "request_id string, uniq_id string, seg_ord int, text string"),
        speaker_roster=([], "uniq_id string, speaker_no int, display_name string, role_title string"),
    )
    assert [(r["meeting"], r["claims"], r["f1"]) for r in got] == [("r", 1, 0.333333)]


def test_all_words_have_a_speaker(spark, tmp_path):
    turns = [
        ("u", 0, "Speaker 1", "a b"), ("u", 1, "Ana  Lund", "c d"), ("u", 2, None, "e f g"), ("u", 3, "S0", "h"), ("u", 3, "ANA LUND", "h"),
        ("u", 4, "unknown", "i j"),
    ]
    segments = [
        ("r", "u", 0, "[spk_1]:", "a b"), ("r", "u", 1, "S0", "c d"), ("r", "u", 2, "", "e f g"), ("r", "u", 3, "chair", "h"),
        ("r", "u", 4, "guest", "i x"),
    ]
    roster = [("u", 0, "Ana Lund", "Chair"), ("u", 1, "Bo Ek", None)]
    got = run(
        spark, tmp_path, "speaker_error_rates",
        score_turns=(turns, "uniq_id string, turn_index int, speaker_id string, reference_text string"),
        transcribed_segments=(segments, "request_id string, uniq_id string, seg_ord int, speaker string, text string"),
        speaker_roster=(roster, "uniq_id string, speaker_no int, display_name string, role_title string"),
    )
    assert [(r["session"], r["errors"], r["ref_words"], r["hyp_words"]) for r in got] == [("r", 1, 10, 10)]
