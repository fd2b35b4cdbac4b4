from __future__ import annotations

import pytest

from colloquy.llm import residue as rs

SLOTS = ["Dear {{first_name}},", "{{{room}}}", "on ${date}", "#{chair}", "%%DATE%%", "%(chair)s", "__MEETING_TITLE__", "<%= owner %>", "<<Recipient>>", "«Company»", "@@chair@@", "{date}", "[[deadline]]", "[INSERT DATE]", "<add owner>", "(First Name)",
         "(NAME OF CHAIR)", "(Datum eintragen)", "[votre nom]", "<Nombre del cliente>", "主持人：[在此插入日期]", "[meeting_title]", "{{owner|default}}"]
NO_SLOTS = ['The template field "{{client_name}}" will be renamed', "{x | x > 0}", '{"speaker": "a", "start": 3.2}', "[optional]", "<NA>", "{F um}", "[laughter]", "{breath}", "<noise>", "(page 15)", "(at least in Ellmoor)", "(not the old one)",
            "total of $40 [1]", '<vocalsound type="crosstalk"/>', "<html><head><title>x</title>", "[00:01:02]", "(10 min)", "a_b __init__x", "«Bonjour à tous»", "snake_case name"]
BAD = ["404 Not Found", "HTTP 502 - Bad Gateway", "Status: 408 Request Timeout", "ERROR 502", "Access Denied", "Zugriff verweigert. Ihre Sitzung ist abgelaufen.", "Erreur 503 : service momentanément indisponible.", "429. That's an error.",
       "Oops! We can't find the page you are looking for.", "java.lang.IllegalStateException: renderer failed",
       '{"error": {"code": 503, "message": "x"}}', "页面不存在。", "Please enable JavaScript to view this transcript.",
       "This viewer requires scripts.",
       "Enable cookies and JavaScript, then refresh.", "Bitte aktivieren Sie JavaScript in Ihrem Browser, um das Protokoll anzuzeigen.",
       "To continue, switch on JS in your browser settings.", "Lorem ipsum vexil orbum", "xxx xxx xxx xxx xxx xxx", "Click to add title",
       "Your text here. Your text here.", "此处为占位文字。", "请启用浏览器的JavaScript功能", "Heading 2", "Anna: 500 Internal Server Error", "We met. 404 Not Found", "507 Insufficient Storage", "Insufficient Storage (507)", "HTTP 423 - Locked", "Unprocessable Entity", "Gone (410)"]
GOOD = ["Page 404 of the binder was not found in the archive.", "Error rates dropped to 500 per million.", "We discussed whether the viewer may require JavaScript; legal agreed.", "so users without scripts get a blank page, that was the complaint",
        "The mock-up still showed lorem ipsum and nobody noticed.", "She asked why access was denied to the office.",
        "for everyone who gets 'service unavailable' in town", "Someone typed 'test test test' into the field.", "Menu", "Search",
        "Placeholder names in the forms, such as 'Your Name', should be grey.", "The internal server had an error on Monday, the minutes were typed by hand", "no no no wait", "um um um", "The script was read aloud.", "Problems", "Conflict", "Locked", "12 locked doors were found", "10 10 10 10 10 10"]


@pytest.mark.parametrize("text", SLOTS)
def test_slots(text):
    assert rs.has_slot(text)


@pytest.mark.parametrize("text", NO_SLOTS)
def test_no_slots(text):
    assert not rs.has_slot(text)


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_documents(spark):
    texts = [f"We met on Monday.\n{t}\nIt was fine." for t in BAD + SLOTS] + [f"We met on Monday.\n{t}\nIt was fine." for t in GOOD + NO_SLOTS] + [BAD[0], BAD[0], None, "", " \n "]
    df = docs(spark, texts)
    got = {r["doc_id"]: r["reasons"] for r in rs.residue(df.selectExpr("*", "1 AS unit", "2 AS path", "3 AS verdict")).collect()}
    bad, good = len(BAD) + len(SLOTS), len(GOOD) + len(NO_SLOTS)
    assert [texts[i] for i in range(bad) if i not in got] == []
    assert [texts[i] for i in got if bad <= i < bad + good] == []
    assert set(got) == set(range(bad)) | {bad + good, bad + good + 1}
    clean = rs.without_residue(df)
    assert clean.columns == df.columns and clean.count() == len(texts) - len(got)


LINES = [
    "asdf, asdf, asdf", "blah blah blah", "at viewer.Render.run(Render.java:88)", "Sorry, we could not load that transcript", "请求已超时",
    "gateway time-out", "Verify that you are human", "Accès refusé", "Add a title",
]
# None of these is among the classifier's examples.
HELD_OUT = ["503 Backend fetch failed", "ERR_CONNECTION_REFUSED", "Verbindung zum Server fehlgeschlagen", "Errore 404: pagina non trovata", "Cette page nécessite JavaScript pour fonctionner.", "Il documento richiesto non è stato trovato sul server",
            "Hier steht später der richtige Inhalt.", "foo bar baz foo bar baz foo bar baz", "Section text goes here",
            "Please activate JavaScript to load this page.", "HTTP 404 - document removed", "The service could not process your request.",
            "Your connection has timed out, reload the page", "La página solicitada no existe", "Insert your title here", "<PLACEHOLDER>", "Dear [Placeholder],", "Server error. Please try again later."]
ORDINARY = [
    "Yeah, yeah, yeah.", "Here is your coffee", "The server room is on the second floor.", "Please read the page again.",
    "Access to the building was denied to two visitors on Monday", "Your text was fine, thanks.", "Can we enable the heating by Friday?",
    "[sponsor]",
]


def test_single_lines(spark):
    got = {r["doc_id"] for r in rs.residue(docs(spark, LINES)).collect()}
    assert [t for i, t in enumerate(LINES) if i not in got] == []


def test_held_out_lines(spark):
    texts = HELD_OUT + ORDINARY
    got = {r["doc_id"] for r in rs.residue(docs(spark, texts)).collect()}
    missed = [t for i, t in enumerate(HELD_OUT) if i not in got]
    assert len(missed) <= 0.2 * len(HELD_OUT), missed
    assert [texts[i] for i in got if i >= len(HELD_OUT)] == []


def test_frames_and_capitals_make_slots(spark):
    texts = [
        "Thanks to [INSERT NAME] for the lunch.", "Thanks to [Company Name] for the lunch.", "Thanks to [sponsor] for the lunch.",
        "Thanks [sponsor] and all.", "Lead: [PROJEKTLEITER]", "Ana: well [SIGHS] no", "Ana: so {sighs} no", "Next: [1]",
    ]
    got = {r["doc_id"]: r["reasons"] for r in rs.residue(docs(spark, texts)).collect()}
    assert got == {i: ["slot"] for i in (0, 1, 2, 4)}


def test_verdicts_go_on_by_documents(spark):
    texts = [f"{m}\nMail the night desk." for m in BAD[:24]] + ["Vexilo non orbat.\nMail the night desk.", "We met.\nNothing else."]
    got = {r["doc_id"] for r in rs.residue(docs(spark, texts)).collect()}
    assert got == set(range(24)) | {24}
    assert rs.residue(docs(spark, [f"{BAD[0]}\nMail the night desk."] * 20 + ["Vexilo non orbat.\nMail the night desk."])).count() == 20  # one text, sent often


def test_filler_latin_is_learnt(spark):
    texts = [
        "Lorem ipsum vexil orbum corvin tantor", "Lorem ipsum tantor morabo vexil erudi", "Erudi vexil corvin tantor morabo orbum.",
        "Corvin met Ana in town on Monday.",
    ]
    assert {r["doc_id"] for r in rs.residue(docs(spark, texts)).collect()} == {0, 1, 2}


def test_a_leaf_loses_nothing(spark):
    texts = ["This meeting page has been removed."] + ["This meeting page has been available."] * 3
    assert {r["doc_id"] for r in rs.residue(docs(spark, texts)).collect()} == {0}


def test_a_template_speaks_for_its_units(spark):
    kinds = spark.createDataFrame(
        [(f"{w} the requested page could not be found on this server {v}",) for w, v in (("Zzz", "xylo"),)] + [(f"The requested page could not be found on {v} server",) for v in ("vectis", "qulor", "orbum")],
        "unit string",
    )
    got = {r["unit"] for r in rs.condemned_units(kinds, rs.Verdicts()).collect()}
    assert len(got) == 4


def test_rare_lines_in_a_crowded_leaf(spark):
    texts = [f"HTTP {400 + i % 20} - {w} at the stone gate of Ellmoor" for i, w in enumerate(["Lunch", "Dinner", "Supper"] * 30)]
    texts += [f"HTTP {400 + i} - Bad gateway at the server" for i in range(3)]
    got = {r["doc_id"] for r in rs.residue(docs(spark, texts)).collect()}
    assert got == {i for i, t in enumerate(texts) if "Bad gateway" in t}


def test_templates_and_long_texts(spark):
    units = spark.createDataFrame(
        [(f"the meeting of the whole {i} group went on for # hours",) for i in "abcdef"] + [("another # went on",)], "unit string",
    )
    assert {(r["template"], r["n"]) for r in rs.mined_templates(units).collect()} == {
        ("the meeting of the whole * group went on for # hours", 6), ("another # went on", 1),
    }
    long = "An ordinary sentence about nothing. " * 30_000
    assert {r["doc_id"] for r in rs.residue(docs(spark, [long, long + "\n403 Forbidden", long + "[INSERT DATE]"])).collect()} == {1, 2}
    assert rs.residue(docs(spark, [])).count() == 0


def test_majority_acquits_no_minority(spark):
    """Residue behind the fifth token, in leaves whose other units are clean and many."""
    head, turn = "Summary of the weekly call: ", "You need to turn on "
    texts = [head + "access was given to ana"] * 1_000 + [head + "blah blah blah blah blah"]
    texts += [f"{turn}{w} javascript in {v} today" for w, v in (("the", "chrome"), ("your", "firefox"))]
    texts += [turn + "the heating error {} {} today".format(*w.split()) for w in ("in winter", "by noon", "on friday")]
    got = {r["doc_id"]: r["reasons"] for r in rs.residue(docs(spark, texts)).collect()}
    assert got == {1000: ["filler"], 1001: ["scripts"], 1002: ["scripts"]}
