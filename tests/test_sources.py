from __future__ import annotations

import io
import json
import tarfile
import wave

import pytest
from pyspark.sql import functions as F

from colloquy.operators.carry import carry_accounting
from colloquy.functions import grammar
from colloquy.sources import documents, lines, manifests, standoff
from colloquy.streaming import episodes

NITE = 'xmlns:nite="http://nite.sourceforge.net/"'


def test_turn_lines(spark, tmp_path):
    text = ";; comment\n\nSPEAKER m1 1 0.500 1.250 <NA> <NA> anna <NA> <NA>\nSPKR-INFO m1 1 <NA>\nSPEAKER m1 1 2 1 <NA> <NA> <NA> <NA> <NA>\n"
    (tmp_path / "a.rttm").write_text(text)
    rows = lines.read_rttm(spark, str(tmp_path / "a.rttm")).orderBy("start_s").collect()
    assert [(r["file_id"], r["start_s"], r["end_s"], r["speaker"]) for r in rows] == [("m1", 0.5, 1.75, "anna"), ("m1", 2.0, 3.0, None)]
    for bad in ("SPEAKER m1 1 0.5", "SPEAKER m1 1 0.5 0 <NA> <NA> a", "SPEAKER m1 1 x 1 <NA> <NA> a"):
        with pytest.raises(Exception, match="bad speaker line"):
            lines.parse_rttm(spark.createDataFrame([(bad,)], "value string")).collect()
    made = lines.rttm_lines(
        spark.createDataFrame(
            [("f", 0.0, 1.5, "a b"), ("f", 2.0, 2.0, "x"), ("g", 1.0, 2.0, None)], "f string, s double, e double, w string",
        ),
        "f", "s", "e", "w",
    )
    lines.write_rttm(made, str(tmp_path / "out"))
    back = lines.parse_rttm(spark.read.text(str(tmp_path / "out")).select("value")).orderBy("file_id").collect()
    assert [(r["file_id"], r["end_s"], r["speaker"]) for r in back] == [("f", 1.5, "a_b"), ("g", 2.0, None)]
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        lines.write_rttm(made, str(tmp_path / "out"))


def test_aligned_tokens(spark):
    rows = [
        "Acme|1|0.5|0.9||||['e1:ORG']|||", "Corp|1||||||['e1:ORG']|||", "said|1|1.2|||||[]|||", "Rome|2|2.0|||||['e2:LOC']|||", "short|1",
    ]
    df = spark.createDataFrame([("d", i, v) for i, v in enumerate(rows)], "document string, ord int, value string")
    got = {r["entity"]: (r["surface"], r["kind"], r["ts"], r["speaker"]) for r in lines.entity_mentions(lines.aligned_tokens(df)).collect()}
    assert got == {"e1": ("Acme Corp", "ORG", 0.5, "1"), "e2": ("Rome", "LOC", 2.0, "2")}
    again = df.union(spark.createDataFrame([("d", 9, "Inc|1|3||||| ['e1:ORG']|||")], df.schema))
    with pytest.raises(Exception, match="not one run"):
        lines.entity_mentions(lines.aligned_tokens(again)).collect()


def test_responses(spark, tmp_path):
    rows = [
        {"request_id": "a", "outcome": "error", "text": None}, {"request_id": "a", "outcome": "ok", "text": "one", "recorded_utc": "1"},
        {"request_id": "b", "outcome": "error"},
    ]
    (tmp_path / "r1.jsonl").write_text("\n".join(map(json.dumps, rows)) + '\n{"request_id": "c", "outc')
    (tmp_path / "r2.jsonl").write_text(json.dumps({"request_id": "a", "outcome": "ok", "text": "two", "recorded_utc": "2"}) + "\n")
    got = lines.read_responses(spark, str(tmp_path))
    assert [(r["request_id"], r["text"]) for r in lines.last_responses(got, ["request_id"], ["file_name", "recorded_utc"]).collect()] == [("a", "two")]
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "request_id string")
    assert sorted(r["request_id"] for r in lines.still_to_do(asked, got, ["request_id"]).collect()) == ["b", "c"]
    lines.append_responses(asked, str(tmp_path / "more"))
    lines.append_responses(asked, str(tmp_path / "more"))
    assert spark.read.json(str(tmp_path / "more")).count() == 6
    one, two = (lines.table_hash(d, ["request_id"]).first() for d in (asked, asked.repartition(3)))
    assert tuple(one) == tuple(two) and one["n_rows"] == 3


def corpus(folder):
    files = {
        "M1.A.words.xml": f'<r {NITE}><w nite:id="w0" starttime="0.0" endtime="0.4">We</w><w nite:id="w1" starttime="0.4" endtime="0.9">agree</w><w nite:id="w2" starttime="0.9" endtime="0.9" punc="true">.</w><vocalsound nite:id="w3" starttime="bad" type="laugh"/><w nite:id="w4" starttime="1.0" endtime="1.2">Yes</w></r>',
        "M1.A.segments.xml": f'<r {NITE}><segment nite:id="s0" transcriber_start="0.0" transcriber_end="1.0"><nite:child href="M1.A.words.xml#id(w0)..id(w2)"/></segment><segment nite:id="s1"><nite:child href="M1.A.words.xml#id(w4)..id(w3)"/></segment><segment nite:id="s2"><nite:child href="M1.A.words.xml#id(w9)"/></segment></r>',
        "M1.topic.xml": f'<r {NITE}><topic nite:id="t0"><topic nite:id="t1"/><topic nite:id="t2"/></topic></r>',
    }
    for name, body in files.items():
        (folder / name).write_text(body)


def test_standoff_corpus(spark, tmp_path):
    corpus(tmp_path)
    files = standoff.read_files(spark, str(tmp_path))
    assert [(r["meeting"], r["layers"], r["agents"]) for r in standoff.layers(files).collect()] == [("M1", ["segments", "topic", "words"], ["A"])]
    rows = standoff.elements(files).cache()
    words = standoff.words(rows.where("file = 'M1.A.words.xml'"))
    assert [(r["id"], r["kind"], r["text"], r["start_s"]) for r in words.orderBy("ord").collect()] == [
        ("w0", "w", "We", 0.0), ("w1", "w", "agree", 0.4), ("w2", "w", ".", 0.9), ("w3", "vocalsound", None, None), ("w4", "w", "Yes", 1.0),
    ]
    segments = standoff.holders(rows, "segment").withColumn("key", F.col("id"))
    found, orphans = standoff.expanded(segments, words.withColumnRenamed("id", "wid").withColumnRenamed("wid", "id"))
    got = {r["key"]: (r["text"], r["start_s"], r["end_s"], r["n_words"]) for r in standoff.rebuilt(found).collect()}
    assert got == {"s0": ("We agree.", 0.0, 0.9, 2), "s1": ("Yes", 1.0, 1.2, 1)}
    assert [(r["key"], r["start_id"]) for r in orphans.collect()] == [("s2", "w9")]
    tree = {r["id"]: (r["parent_id"], r["depth"], r["place"]) for r in standoff.topic_tree(rows).collect()}
    assert tree == {"t0": (None, 1, 0), "t1": ("t0", 2, 0), "t2": ("t0", 2, 1)}
    with pytest.raises(Exception, match="malformed pointer"):
        spark.createDataFrame([("nonsense",)], "h string").select(standoff.pointer(F.col("h"))).collect()


def test_evidence_links(spark):
    links = spark.createDataFrame([("d1", "s1"), ("d2", "s1"), ("d9", "s2")], "act_id string, sentence_id string")
    acts = spark.createDataFrame([("d1", "B"), ("d2", "A")], "act_id string, speaker string")
    sentences = spark.createDataFrame(
        [("s1", "actions", "Do it."), ("s2", "abstract", "Talk.")], "sentence_id string, section string, text string",
    )
    good, missing = standoff.linked_evidence(links, acts, sentences)
    assert [(r["sentence_id"], r["acts"], r["speakers"]) for r in good.collect()] == [("s1", ["d1", "d2"], ["A", "B"])]
    assert [r["act_id"] for r in missing.collect()] == ["d9"]


def test_questions(spark, tmp_path):
    flat = {"data": [{"id": i, "title": "M", "question": "q", "context": "c", "is_impossible": i == "c", "answers": {"text": ["flat"], "answer_start": [0]}} for i in "abc"]}
    spans = {"data": [{"id": "a", "question": ["q"], "context": ["x", "red", "car", "y", "bus"], "labels": ["O", "B", "I", "O", "B"]}]}
    (tmp_path / "flat.json").write_text(json.dumps(flat))
    (tmp_path / "spans.json").write_text(json.dumps(spans))
    rows = documents.answered(
        documents.read_questions(spark, str(tmp_path / "flat.json")), documents.read_spans(spark, str(tmp_path / "spans.json")),
    )
    assert {r["id"]: (r["answers"], r["answer_source"]) for r in rows.collect()} == {
        "a": (["red car", "bus"], "spans"), "b": (["flat"], "flat"), "c": ([], "unanswerable"),
    }
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "M7.json").write_text(
        json.dumps({"meeting_transcripts": [{"speaker": "A", "content": "hi"}, {"speaker": "B", "content": "yo"}]})
    )
    assert [tuple(r) for r in documents.read_transcripts(spark, str(tmp_path / "t")).orderBy("ord").collect()] == [("M7", 0, "A", "hi"), ("M7", 1, "B", "yo")]


def test_archives_and_audio(spark, tmp_path):
    import hashlib

    data = io.BytesIO()
    with wave.open(data, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16_000), w.writeframes(b"\0\0" * 8_000)
    (tmp_path / "a.wav").write_bytes(data.getvalue())
    (tmp_path / "b.wav").write_bytes(b"no audio")
    with tarfile.open(tmp_path / "x.tar", "w") as tar:
        tar.add(tmp_path / "a.wav", "in/a.wav")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(str(tmp_path)).orderBy("path")
    assert [r["s"] for r in files.select(documents.wave_seconds("content").alias("s")).collect()] == [0.5, None]
    rows = documents.read_tar_index(spark, str(tmp_path / "*.tar")).collect()
    assert [(r["tar"], r["member"], r["stem"], r["bytes"], r["sha256"]) for r in rows] == [("x.tar", "in/a.wav", "a", len(data.getvalue()), hashlib.sha256(data.getvalue()).hexdigest())]
    got = documents.listing(spark, str(tmp_path), "*.wav")
    expected = spark.createDataFrame([("a.wav", 9), ("c.wav", 1)], "name string, bytes bigint")
    assert {r["name"]: r["problem"] for r in documents.lock_breaks(got, expected).collect()} == {"a.wav": "size", "b.wav": "unexpected", "c.wav": "missing"}


def test_clips_and_mono(spark):
    import hashlib
    import io
    import wave

    import numpy as np

    def made(rate, channels, samples):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes(np.asarray(samples, "<i2").tobytes())
        return out.getvalue()

    stereo = made(32_000, 2, np.repeat([[1000, 3000]], 32_000, 0).ravel())
    df = spark.createDataFrame(
        [
            ("a", bytearray(stereo), 0, 0.25, 0.75), ("a", bytearray(stereo), 1, 5.0, 6.0), ("b", bytearray(b"no wave"), 0, 0.0, 1.0),
            ("c", None, 0, 0.0, 1.0),
        ],
        "name string, content binary, n int, s double, e double",
    )
    rows = {(r["name"], r["n"]): r for r in documents.audio_clips(df, "content", "s", "e").collect()}
    clip = rows["a", 0]
    with wave.open(io.BytesIO(bytes(clip["clip"]))) as w:
        assert (w.getframerate(), w.getnchannels(), w.getnframes()) == (16_000, 1, 8_000)
        assert set(np.frombuffer(w.readframes(8_000), "<i2")) == {2000}
    assert clip["sha256"] == hashlib.sha256(bytes(clip["clip"])).hexdigest()
    assert all(rows[k]["clip"] is None and rows[k]["sha256"] is None for k in rows if k != ("a", 0))


def test_layouts_and_minutes(spark):
    files = spark.createDataFrame([("m1.A.words.xml",), ("m1.abssumm.xml",), ("odd.txt",)], "name string")
    layout = {".words.xml": "words", ".abssumm.xml": "abstractive"}
    assert {r["name"]: (r["layer"], r["meeting"]) for r in standoff.placed(files, layout).collect()} == {
        "m1.A.words.xml": ("words", "m1"), "m1.abssumm.xml": ("abstractive", "m1"), "odd.txt": (None, "odd"),
    }
    rows = [
        ("f", 0, 0, -1, "root", None, None), ("f", 1, 1, 0, "abstract", None, None), ("f", 2, 2, 1, "sentence", "s1", "First."),
        ("f", 3, 2, 1, "sentence", "s2", "Then."), ("f", 4, 1, 0, "decisions", None, None), ("f", 5, 2, 4, "sentence", "s3", "Do."),
        ("f", 6, 1, 0, "other", None, None), ("f", 7, 2, 6, "sentence", "s4", "x"),
    ]
    df = spark.createDataFrame(rows, "file string, ord int, depth int, parent int, tag string, id string, text string")
    assert [tuple(r) for r in standoff.minutes(df).orderBy("section", "place").collect()] == [
        ("f", "abstract", 0, "s1", "First."), ("f", "abstract", 1, "s2", "Then."), ("f", "decisions", 0, "s3", "Do."),
    ]


def test_slices_of_audio(spark):
    data = io.BytesIO()
    with wave.open(data, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(1_000), w.writeframes(b"\1\0" * 3_000)
    rows = [(data.getvalue(), 0.5, 1.5), (data.getvalue(), 2.5, 9.0), (data.getvalue(), 5.0, 6.0), (b"x", 0.0, 1.0), (None, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "c binary, a double, b double").select(documents.wave_slice("c", "a", "b").alias("s"))
    assert [r["n"] for r in df.select(documents.wave_seconds("s").alias("n")).collect()] == [1.0, 0.5, None, None, None]


def test_manifests(spark, tmp_path):
    path = str(tmp_path / "m.json")
    df = spark.createDataFrame([("b", 2), ("a", 1)], "k string, n int")
    made = manifests.write_manifest(df, path, "v1")
    read = lambda: manifests.read_documents(spark, path)
    problems = lambda v="v1": sorted((r["problem"], r["detail"]) for r in manifests.manifest_breaks(read(), v).collect())
    assert [r["k"] for r in made["rows"]] == ["a", "b"] and problems() == []
    assert sorted((r["k"], r["n"]) for r in manifests.manifest_rows(read(), "v1", "k string, n int").collect()) == [("a", 1), ("b", 2)]
    assert manifests.content_hash({"b": 1, "a": "é"}) == __import__("hashlib").sha256(b'{"a":"\\u00e9","b":1}').hexdigest()
    with pytest.raises(FileExistsError):
        manifests.write_manifest(df, path, "v1")
    assert problems("v2") == [("version", "v1")] and manifests.manifest_rows(read(), "v2", "k string, n int").count() == 0
    text = (tmp_path / "m.json").read_text()
    (tmp_path / "m.json").write_text(text.replace('"n": 2', '"n": 3'))
    assert [p for p, _ in problems()] == ["hash"]
    (tmp_path / "m.json").write_text('{"a": 1, "a": 2, "b": {"c": 1, "c": 1}}')
    assert problems() == [("hash", "the content is not what was hashed"), ("repeated key", "a"), ("repeated key", "c"), ("version", "none")]
    for broken in ("{", "[1]"):
        (tmp_path / "m.json").write_text(broken)
        assert [p for p, _ in problems()] == ["unreadable"]
    registry = spark.createDataFrame([("m1", "dev"), ("m2", "dev"), ("m3", None), ("m3", "x")], "meeting string, role string")
    listed = spark.createDataFrame([("m1",), ("m9",)], "meeting string")
    got = sorted(tuple(r) for r in manifests.registry_breaks(registry, {"role": {"dev": 2, "test": 1, "x": 1}}, {"list": listed}).collect())
    assert got == [
        ("count", "role", "none 1"), ("count", "role", "test 0"), ("repeated", "registry", "m3"), ("uncovered", "list", "m2"),
        ("uncovered", "list", "m3"), ("unknown", "list", "m9"),
    ]
    files = spark.createDataFrame([("a.wav",)], "name string")
    assert [r["k"] for r in manifests.missing_files(df, "k", files, "{id}.wav").collect()] == ["b"]


def test_section_texts(spark):
    rows = [
        ("m", "ACTIONS", 1, 0, "second"), ("m", "ACTIONS", 0, 1, "first b"), ("m", "ACTIONS", 0, 0, "first a"),
        ("m", "PROBLEMS", 0, 0, "p"),
    ]
    df = spark.createDataFrame(rows, "meeting string, section string, seq int, n int, body string")
    assert {r["section"]: (r["n"], r["text"]) for r in grammar.section_texts(df, "meeting", ["seq", "n"]).collect()} == {
        "ACTIONS": (3, "first a\nfirst b\nsecond"), "PROBLEMS": (1, "p"),
    }


def test_episode_stream_equals_batch(spark, tmp_path):
    units = [(m, p, "s", w) for m in ("m", "n") for p, words in enumerate(("ab", "bc", "", "cad")) for w in words]
    batch = spark.createDataFrame(units, "meeting string, position bigint, speaker string, surface string")
    for p in range(4):  # one file a position, read one a micro-batch
        batch.where(F.col("position") == p).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = episodes.episode_terms(stream).writeStream.format("memory").queryName("episode_report").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(map(tuple, spark.table("episode_report").collect()))
    assert got == sorted(map(tuple, carry_accounting(batch).select("meeting", "position", "total", "new", "carried").collect()))


def test_stream_of_deliveries_and_windows(spark, tmp_path):
    rows = [("a", "2025-01-01 00:10:00"), ("a", "2025-01-01 00:20:00"), ("b", "2025-01-01 01:30:00"), ("c", "2025-01-05 00:00:00")]
    df = spark.createDataFrame(rows, "id string, t string").selectExpr("id", "cast(t as timestamp) as at")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, made in (
        ("first_copies", episodes.first_deliveries(stream, ["id"], "at")), ("hourly", episodes.windowed_counts(stream, "at", [])),
    ):
        made.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["id"] for r in spark.table("first_copies").collect()) == ["a", "b", "c"]
    assert sorted(r["n"] for r in spark.table("hourly").collect()) == [1, 2]
