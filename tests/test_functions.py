from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from colloquy.functions import grammar, text
from colloquy.operators import wer


def one(spark, column, **values):
    """The value of an expression over one row of string columns."""
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_normalisers(spark):
    assert one(spark, text.normal_term(F.col("t")), t="  Foo_Bar – Élan, (x)--") == "foo-bar - élan x"
    assert one(spark, text.normal_answer(F.col("t")), t="Twenty-five, or 1,200 units!") == "20 5 or 1200 units"
    assert one(spark, text.normal_span(F.col("t")), t="Speaker 2: The cat's a-b") == "cats ab"
    assert one(spark, text.normal_span(F.col("t")), t="the") == ""
    assert one(spark, text.normal_term(F.col("t")), t=None) is None
    assert one(spark, text.word_tokens(F.col("t")), t="Über_uns: straße 42") == ["über", "uns", "straße", "42"]


def test_phrases_and_windows(spark):
    holds = lambda a, b, **k: one(spark, text.holds_phrase(F.col("a"), F.col("b"), **k), a=a, b=b)
    assert holds("The Sales team.", "sales TEAM") and not holds("salesteam", "sales team") and not holds("x", "")
    assert holds("..", "", refuse_empty=False) is False or holds("", "", refuse_empty=False)
    places = lambda h, n: one(spark, text.window_places(F.col("h"), F.col("n")), h=h, n=n)
    assert places(["a", "a", "a"], ["a", "a"]) == [0, 1] and places(["a"], ["a", "b"]) == [] and places(["a"], []) == []


def test_token_scores(spark):
    f1 = lambda a, b: one(spark, text.token_f1(F.col("a"), F.col("b")), a=a, b=b)
    assert f1(["a", "a", "b"], ["a", "b", "c"]) == 2 * 2 / 6 and f1([], []) == 1.0 and f1(["a"], []) == 0.0
    assert one(spark, text.token_iou(F.col("a"), F.col("b")), a=["a", "a", "b"], b=["b", "c"]) == 1 / 3


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(new[-1], row[j]))
        row = new
    return row[-1]


def test_distances_against_brute_force(spark):
    rng = random.Random(2)
    pairs = [([rng.choice("abcd") for _ in range(rng.randrange(9))], [rng.choice("abcd") for _ in range(rng.randrange(9))]) for _ in range(150)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    rows = df.select(
        "a", "b", text.token_distance("a", "b").alias("d"), text.lcs_length("a", "b").alias("l"), wer.ngrams(F.col("a"), 2).alias("g"),
        wer.aligned_pairs("a", "b").alias("p"),
    )
    for r in rows.collect():
        assert r["d"] == edit(r["a"], r["b"]) == wer.distance(r["a"], r["b"])
        assert r["l"] == lcs(r["a"], r["b"])
        assert r["g"] == [" ".join(x) for x in zip(r["a"], r["a"][1:])]
        assert [x["ref"] for x in r["p"] if x["ref"] is not None] == r["a"] and [x["hyp"] for x in r["p"] if x["hyp"] is not None] == r["b"]
        kept = sum(x["ref"] == x["hyp"] for x in r["p"])
        assert kept >= sum(m.size for m in SequenceMatcher(None, r["a"], r["b"], autojunk=False).get_matching_blocks())


def test_miners(spark):
    said = "We met Anna Berg and Tom. The New Plan works, I'm told by Zoe. P G L is ABC."
    assert one(spark, text.capital_runs(F.col("t")), t=said) == ["Anna Berg", "Tom", "New Plan", "Zoe", "G L", "ABC"]
    assert one(spark, text.acronyms(F.col("t")), t=said) == ["ABC", "PGL"]
    assert one(spark, text.self_introduction(F.col("t")), t="well THIS IS Ann Lee speaking") == "Ann Lee"
    for said, name in {
        "I'm not sure": None, "my name is Mary Ann O'Neil and": "Mary Ann O'Neil", "So I am Bo, the chair": "Bo",
        "this  is Al Bo Cy Di": "Al Bo Cy", "(I'm Jean-Luc": "Jean-Luc", "hi i am not this is Zoe": "Zoe", "Am I Bo": None, "I'm": None,
        "": None, "that this is Ann. Lee": "Ann", "siam Bo": None,
    }.items():
        assert one(spark, text.self_introduction(F.col("t")), t=said) == name, said
    assert one(spark, text.swapped(F.col("t")), t="Anna Bo") == "Anna Box"
    assert one(spark, text.swapped(F.col("t")), t="Torben") == "Troben"
    assert one(spark, text.speaker_numbers(F.col("t")), t="Speaker 10 and Speaker 2, Speaker 10") == [2, 10]
    assert one(
        spark, text.tag_runs(F.col("a"), F.col("b")), a=["x", "the", "cat", "y", "z"], b=["O", "B", "I", "O", "B"],
    ) == ["the cat", "z"]


def test_terms_and_forms(spark):
    df = spark.createDataFrame([(1, "Anna met Tom. The X2 plan, NASA {Bob} said Tom"), (2, "tom"), (3, None)], "id int, t string")
    got = {(r["id"], r["surface"]): (r["kind"], r["n"]) for r in text.term_kinds(df, ["id"], "t").collect()}
    assert got == {(1, "Tom"): ("name_like", 2), (1, "X2"): ("strict", 1), (1, "NASA"): ("strict", 1)}
    assert one(spark, text.casefolded("t"), t="  Straße Ｘ\u00a0y ") == "strasse x y"
    for said, form in {
        "I can't, it's A B C; we've 2": "i cannot it isabc we have 2", "IT'S FINE": "it is fine",
        "Anna's plan won't, shouldn't've": "anna s plan will not should not have", "the D V D's here": "the dvds here",
        "O' Neil at 5 o'clock": "o neil at 5 of the clock",
        "well-known (e.g. U S): 3.5%": "well known egus 3 5", "": "", "He’s late": "he is late", "A B s C": "absc",
    }.items():
        assert one(spark, text.spoken_form(F.col("t")), t=said) == form, said


def test_folds_and_draws(spark):
    import hashlib

    for i in ("a", "dlg-7", "é"):
        assert one(spark, text.fold_of(F.col("t"), "s"), t=i) == int.from_bytes(hashlib.sha256(f"s:{i}".encode()).digest()[:8], "big") % 4
        assert one(
            spark, text.md5_draw(F.lit(17), F.lit("s"), F.col("t")), t=i,
        ) == int(hashlib.md5(f"s:{i}".encode()).hexdigest()[:8], 16) % 17


def test_replies(spark):
    colon = spark.createDataFrame(
        [(1, "Alice: hi"), (2, "Dr. A-B_1: x"), (3, " | x"), (4, "[ ] x"), (5, "Élan: x"), (6, "a" * 41 + ": x"), (7, "no colon")],
        "id int, raw string",
    )
    assert {r["id"]: r["speaker"] for r in grammar.reply_lines(colon, "raw", ["id"]).collect()} == {
        1: "Alice", 2: "Dr. A-B_1", 3: None, 4: None, 5: None, 6: None, 7: None,
    }
    df = spark.createDataFrame(
        [(1, "a|hi\n\n[b] yo\nSpeaker 3: hm\nnonsense"), (2, "x|y"), (3, ""), (4, None), (5, "zzz")], "id int, raw string",
    )
    rows = [(r["id"], r["line_no"], r["form"], r["speaker"], r["said"]) for r in grammar.reply_lines(df, "raw", ["id"]).orderBy("id", "line_no").collect()]
    assert rows[:4] == [
        (1, 0, "strict", "a", "hi"), (1, 1, "lenient", "b", "yo"), (1, 2, "lenient", "Speaker 3", "hm"), (1, 3, "malformed", None, None),
    ]
    assert {r["id"]: r["mode"] for r in grammar.reply_modes(df, "raw", ["id"]).collect()} == {1: "lenient", 2: "strict", 5: "failed"}
    minutes = spark.createDataFrame(
        [(1, "- stray\nDecisions:\n- do it [evidence: A|10-20]\n* no bullet\n-then\n\n## ACTIONS\n- go\nplain")], "id int, raw string",
    )
    got = [tuple(r) for r in grammar.minutes_bullets(minutes, "raw", ["id"]).orderBy("section", "n").collect()]
    assert got == [(1, "ACTIONS", 0, "go", None, None), (1, "DECISIONS", 0, "do it", "A", "10-20"), (1, "DECISIONS", 1, "then", None, None)]
    qa = spark.createDataFrame([(1, "ANSWER: red\nABSTAIN"), (2, "abstain"), (3, "just this"), (4, " ")], "id int, raw string")
    got = {r["id"]: (r["answers"], r["abstained"], r["mode"]) for r in grammar.answers(qa, "raw", ["id"]).collect()}
    assert got == {1: (["red"], False, "strict"), 2: ([], True, "strict"), 3: (["just this"], False, "lenient"), 4: ([], False, "failed")}


def test_patterns_compile_in_python_too():
    assert re.match(grammar.STRICT_LINE, "a|b")
