from __future__ import annotations

import random

import pytest

from colloquy.llm import transcripts as tr

ROSTER = [(0, "Belquo Glosslock", "Chair"), (1, "Olimar Ruskister", None), (2, "Pelka Ivarhurst", "Product lead")]


def words(text, label=None, roster=ROSTER):
    decode = tr.Tagger.prior().decode
    return [(s, n) for s, n, _ in tr.said(text, label, tr.Roster(roster), decode)]


@pytest.mark.parametrize(
    ("label", "number"),
    [("speaker_1", 1), ("SPEAKER_02", 2), ("S2", 2), ("Spk-00", 0), ("spk1:", 1), (" Speaker 0\t", 0), ("<spk_2>", 2), ("Belquo  Glosslock", 0), ("GLOSSLOCK", 0), ("belquo", 0), ("B. Glosslock", 0), ("Glosslock, Belquo", 0),
     ("[Ruskister, Olimar]", 1), ("chair", 0), ("Product lead (Ivarhurst)", 2), ("Pelka Ivahrurst", 2), ("Glossgorve", None), ("Glossloc", 0), ("unknown", None), ("", None), (None, None), ("<NA>", None), ("<v Olimar>", 1), ("Guest", None)],
)
def test_labels(label, number):
    assert tr.Roster(ROSTER).number(label) == number


def test_shared_names_name_nobody():
    roster = tr.Roster([(0, "Anna Berg", "Chair"), (1, "Anna Tal", "Guest")])
    assert roster.number("anna") is None and roster.number("Tal") == 1


@pytest.mark.parametrize(
    ("text", "label", "want"),
    [
        ("[00:01:02] Um, we met at 16:20 [laughter] today.", "S1", [(1, 5)]),
        ("(0:34) a (that was before lunch) b (applause) c", "S1", [(1, 7)]),
        ("00:01:04.908 --> 00:01:08.000\n <v Speaker 0>No. <applause>", None, [(0, 1)]),
        ("04:49 - How so?", "S2", [(2, 2)]),
        ("00:00:33 We counted @151.6s three *crosstalk* things mm-hmm... ♪ music ♪ ((door slams)) {sighs}", "S2", [(2, 4)]),
        (">> OLIMAR RUSKISTER: yes\nchair| no, uh-huh.\nerm", "S2", [(1, 1), (0, 1)]),
        ("[Pelka] mhm, (the {noise} cheaper one) [inaudible 00:00:51]", "S0", [(2, 3)]),
        ("As Zork put it: fine", "S0", [(0, 5)]), ("Um, uh,", "S0", []), ("", "S0", []), (None, "S0", []),
        ("3.5 mm open points", "S1", [(1, 3)]), ("hmm -\n hello -", None, [(None, 1)]),
        ("See you at 9:15", "S1", [(1, 4)]), ("(not um the old one) x", "S1", [(1, 5)]), ("See you at (door creaks) 8:45.", "S1", [(1, 4)]),
        ("on (that was <00:04:44.9> before) 9:15", "S1", [(1, 5)]), ("at (applause) 10:30 then", "S1", [(1, 3)]),
    ],
)
def test_rows(text, label, want):
    assert words(text, label) == want


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    model = tr.Tagger.prior()
    rng = random.Random(2)
    for _ in range(40):
        seen = [rng.choice([c for c in tr.CLASSES if c not in ("start", "line")]) for _ in range(4)]
        assert np.isclose(
            model.score(seen, model.decode(seen)), max(model.score(seen, p) for p in itertools.product(range(len(tr.STATES)), repeat=4)),
        )


# None of these words is in any list; the notes are new to the evidence, too.
NOTES = ["door creaks", "chair scrapes", "sneezes", "dog barking", "paper rustling", "laughs quietly", "someone whistles", "typing"]
ASIDES = ["at noon", "we tried that", "the second one", "if you ask me", "not in Ellmoor", "two of them", "I checked twice"]


@pytest.mark.parametrize("note", NOTES)
def test_new_notes_are_left_out(note):
    assert words(f"so we ({note}) went on", "S1") == [(1, 4)]


@pytest.mark.parametrize("aside", ASIDES)
def test_spoken_asides_stay(aside):
    assert words(f"so we ({aside}) went on", "S1") == [(1, 4 + len(aside.split()))]


def test_evidence_of_the_corpus_decides():
    texts = ["[kettle boils] we met", "{kettle} so", "we took the lift up", "lift or stairs", "the stairs are wet"] * 5
    evidence = tr.Words.of(texts)
    model = tr.Tagger.prior(evidence)
    count = lambda t: sum(n for _, n, _ in tr.said(t, None, tr.Roster(()), model.decode, evidence))
    assert count("a (kettle) b") == 2 and count("a (lift) b") == 3 and count("a (stairs wet) b") == 4


def test_decoding_differs_from_the_best_tag_of_each_token():
    """A bracket is one thing: single words of it would be tagged otherwise."""
    model = tr.Tagger.prior(tr.Words.of(["the door is open", "close the door"] * 5))
    classes = [t[2] for t in tr.lex("well (door creaks) yes", tr.Roster(()), model.words)]
    assert classes == ["word", "in_open", "in_said", "in_verbal", "in_close", "word"]
    best = [tr.STATES[int(model.emission[:, tr.CLASSES.index(c)].argmax())] for c in classes]
    tags = [tr.STATES[t] for t in model.decode(classes)]
    assert tags[2] == "annotation" != best[2]
    assert tags == ["speech", *["annotation"] * 4, "speech"]


def rows_of(spark, rows):
    return spark.createDataFrame(
        [(r, u, o, lab, t, None) for r, u, o, lab, t in rows],
        "record_id string, uniq_id string, ordinal int, label string, text string, loaded_at timestamp",
    )


def rosters(spark, ids):
    return spark.createDataFrame(
        [(u, n, a, b) for u in ids for n, a, b in ROSTER], "uniq_id string, speaker_no int, display_name string, role_title string",
    )


def test_turns_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for rec in ("r1", "r2", "hot"):
        for o in range(400 if rec == "hot" else 30):
            speaker = rng.choice(["S0", "S1"]) if rng.random() < 0.5 else "S0"
            text = rng.choice(["a b c", "um, uh", "x\nS1: y z", "[noise]", None, "q (applause)"])
            rows.append((rec, "u", o, speaker, text))
            if rng.random() < 0.2:
                rows.append((rec, "u", o, speaker.replace("S", "speaker_"), None if text is None else "um " + text))
    want = {}
    for rec in ("r1", "r2", "hot"):
        turns = []
        seen = {}
        for r, _, o, lab, text in rows:
            if r == rec:
                seen.setdefault(o, (lab, text))
        for o in sorted(seen):
            for s, n in words(seen[o][1], seen[o][0]):
                if turns and turns[-1][0] == s:
                    turns[-1][1] += n
                else:
                    turns.append([s, n])
        want[rec] = [(i, s, n) for i, (s, n) in enumerate(turns, 1)]
    for stretch in (4_096, 7, 1):
        monkeypatch.setattr(tr, "ORDINALS", stretch)
        got = tr.clean_turns(rows_of(spark, rows).repartition(3), rosters(spark, ["u"]), tr.Tagger.prior()).collect()
        for rec in want:
            assert sorted((r["turn_no"], r["speaker_no"], r["n_words"]) for r in got if r["record_id"] == rec) == want[rec]


def test_edge_cases(spark):
    rows = [
        ("r", "u", 0, "Chair", "hello"), ("r", "u", None, "S1", "first"), (None, "u", 1, "S2", "no record"),
        ("r", None, 2, "S1", "no dialogue"), ("s", "none", 0, "Chair", "who?"), ("t", "u", 0, None, "   "),
    ]
    got = {(r["record_id"], r["turn_no"]): (r["speaker_no"], r["n_words"], r["text"]) for r in tr.clean_turns(rows_of(spark, rows), rosters(spark, ["u"]), texts=True).collect()}
    assert got == {
        ("r", 1): (1, 1, "first"), ("r", 2): (0, 1, "hello"), ("r", 3): (1, 2, "no dialogue"), (None, 1): (2, 2, "no record"),
        ("s", 1): (None, 1, "who?"),
    }
    assert tr.clean_turns(rows_of(spark, []), rosters(spark, [])).count() == 0
    long = "word " * 50_000 + "\nS1: " + "um " * 1_000 + "end"
    assert words(long, "S0") == [(0, 50_000), (1, 1)]


def test_the_tagger_is_fitted_on_every_text(spark):
    """Counts, evidence and tables are those of all distinct texts, however many there are."""
    rng = random.Random(7)
    notes, spoken = ["door", "creaks", "laughs", "music"], ["the", "plan", "was", "cheaper", "um"]
    texts = [
        f"{' '.join(rng.choices(spoken, k=4))} t{i} [{rng.choice(notes)}] ({' '.join(rng.choices(notes + spoken, k=2))} w{i % 7}) 10:{i % 60:02d}" for i in range(25_000)
    ]
    rows = spark.createDataFrame([(t,) for t in [*texts, *texts[:50], "", None]], "text string").repartition(5)
    got = tr.fitted_tagger(rows)
    distinct = sorted(set(texts))
    words = tr.Words.of(distinct)
    assert all(got.words.odds[w] == pytest.approx(words.odds[w]) for w in got.words.odds)
    assert {"door", "music", "plan", "cheaper"} <= got.words.odds.keys()
    want = tr.Tagger.prior(words).fitted(tr.collapsed([t[2] for t in tr.lex(text, tr.Roster(()), words)])[0] for text in distinct)
    for a, b in ((got.transition, want.transition), (got.inside, want.inside), (got.emission, want.emission)):
        assert a == pytest.approx(b)
    assert tr.fitted_tagger(rows.limit(0)).words.odds == {}
