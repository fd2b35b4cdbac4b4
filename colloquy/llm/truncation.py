"""Texts that stop before they are finished.

Evidence comes in this order:

* what the end itself shows: a marker of the cut, an open note, an open or empty label;
* the whole text is a strict prefix of a longer text elsewhere in which its last sentence
  goes on: texts are sorted by their words, with ends of sentences after everything else, so
  that the next text in this order goes on with the sentence if any text does;
* the open last sentence is a strict prefix of finished sentences elsewhere: the word
  prefixes of all finished sentences are hashed and joined with the open ends;
* the last word is a strict prefix of words of the corpus and no word itself: the distinct
  words of all texts are sorted, and a prefix of any word is one of the next word;
* otherwise a classifier of sentence ends, fitted on a bounded sample of finished and
  unfinished positions of the texts themselves, judges the last words. It also serves
  sources without punctuation, whose sentences have no visible start.

Closing words that many texts end with without a full stop, far more often than cuts would
leave them there, are finished.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sampling import hashed_head
from ..session import cut_lineage

#: Texts the classifier is fitted on, at most (the least by hash), and positions of each (the
#: least by hash out of the whole text).
SAMPLE_TEXTS, SAMPLE_POSITIONS = 6_000, 200
#: Below this probability of a sentence end an open end is a cut.
LEAST_END = 0.5
#: Closing words: so many texts at least, so many times the expected cuts, of so many words.
CLOSING_TEXTS, CLOSING_TIMES, CLOSING_WORDS = 3, 1.0, 6
#: From this probability on, one or two longer sentences elsewhere don't make a cut.
SURE_END = 0.8
_SLOTS = 1 << 18
_CONTEXT = 9

LABEL = re.compile(r"(?:speaker_\d+\s*\||\[speaker_\d+\]|speaker \d+\s*:)", re.I)
_OPEN_LABEL = re.compile(r"(?:s|sp|spe|spea|speak|speake|speaker(?:[_ ]\d*)?|\[(?:s|sp|spe|spea|speak|speake|speaker(?:_\d*)?)?)", re.I)
_MARKERS = re.compile(r"(?:�+|…|\[(?:…|\.\.\.|truncated|cut)\]|<(?:truncated|cut)>|\((?:truncated|cut off)\))$", re.I)
_NOTE = re.compile(r"\(\([^()\n]*\)\)|\([^()\n]*\)|\[[^\[\]\n]*\]|<[^<>\n]*>|\{[^{}\n]*\}|♪[^♪\n]*♪")
_BRACKET = re.compile(r"[\[({<♪]")
_NOTE_END = re.compile(r"\s*(?:" + _NOTE.pattern + r")\s*$")
_OPEN_NOTE = re.compile(r"[\[(<{♪][^\[\](){}<>♪\n]{0,60}$")
_BREAK_OFF = re.compile(r"(?:—|–|--|\.\.\.)[\"'”’)]*$")
_CLOSED = re.compile(r"[.?!。！？][\"'”’»)\]]*$")
_SPLIT = re.compile(r"(?<=[.?!])[\"'”’)\]]*\s+(?=[\"'“‘(\[]*[A-ZÀ-ÝŠŽ])|(?<=[—])\s+(?=[A-ZÀ-Ý])")
# Common words that, written with a capital, begin a sentence even where the
# one before has no full stop.
_STARTERS = "The That This There These Those To We You He She They It My Our Your His Her Their What Who How When Where Why Which Could Would Should Can Do Does Did Is Are Was Were If And But So Or Because As At In On For With Please Maybe Well Right Yeah Yes No Not Okay Like Hold Let's Thanks It's That's We've We'll We'd We're You're I've I'll I'd I'm He's She's They're There's What's See".split()
_UNSTOPPED = re.compile(r"(?<=[\w)\]>])\s+(?=[A-Z])(?=(?:" + "|".join(re.escape(w) for w in _STARTERS) + r")\b(?!['’]\w))")
_WORD = re.compile(r"\d+(?:[.:,]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*")
_ABBREVIATED = re.compile(r"\b(?:approx|ca|no|nr|dr|mr|mrs|prof|st|vs|e\.g|i\.e|incl|max|min)\.$", re.I)


#: Signs at the end that the patterns of ends can reach, at most.
_LAST = 100


def words_of(text: str) -> list[str]:
    if _BRACKET.search(text):
        text = _NOTE.sub(" ", text)
    return _WORD.findall(text.lower().replace("’", "'"))


def shown_by_end(text: str | None) -> str:
    """``none`` (nothing to judge), ``marker``, ``note``, ``label``, ``closed`` or ``open``."""
    if text is None or not text.strip():
        return "none"
    end = text.rstrip()
    if _MARKERS.search(end[-_LAST:]):
        return "marker"
    line = end[end.rfind("\n") + 1 :].strip()
    if (_OPEN_LABEL.fullmatch(line) and len(line) < len(end.strip())) or LABEL.fullmatch(line) or re.fullmatch(r"\[speaker_\d*|speaker_\d+", line, re.I):
        return "label"
    while end[-1] in "])>}♪":
        shorter = _NOTE_END.sub("", end)
        if shorter == end or not shorter:
            break
        end = shorter
    last = end[-_LAST:]
    if _OPEN_NOTE.search(last):
        return "note"
    if LABEL.fullmatch(end[end.rfind("\n") + 1 :].strip()):
        return "closed"  # a turn of nothing but a note
    if _BREAK_OFF.search(last):
        return "closed"
    if _CLOSED.search(last) and not _ABBREVIATED.search(last) and not re.search(r"\d\.$", last):
        return "closed"
    if text.rstrip() != end and not re.search(r"[^\s\])}>]$", end):
        return "closed"
    return "open"


def punctuated(text: str) -> bool:
    return bool(re.search(r"[.?!](?:\s|$|[\"'])", text)) or text != text.lower()


def sentences(text: str, end: str | None = None) -> tuple[list[list[str]], bool]:
    """Sentences of a text as words, and whether the last one is closed; ``end`` is what
    shown_by_end says of it, if it is known."""
    out = []
    for line in text.split("\n"):
        line = LABEL.sub("", line.strip(), count=1) if LABEL.match(line.strip()) else line
        for s in _SPLIT.split(line):
            for part in _UNSTOPPED.split(s):
                if w := words_of(part):
                    out.append(w)
    return out, (end or shown_by_end(text)) == "closed"


@lru_cache(maxsize=200_000)
def _code(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")


def _chain(words: Sequence[str]) -> Iterator[int]:
    """One 64-bit hash for each prefix of the words."""
    state = 0xCBF29CE484222325
    for w in words:
        state = (state ^ _code(w)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        state ^= state >> 29
        yield state - (1 << 64) if state >> 63 else state


_SHAPE = T.StructType(
    [
        T.StructField("end", T.StringType()), T.StructField("marked", T.BooleanType()), T.StructField("parts", T.IntegerType()),
        T.StructField("last", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("tail", T.ArrayType(T.StringType())),
        T.StructField("words", T.StringType()), T.StructField("prefixes", T.ArrayType(T.LongType())),
        T.StructField("whole", T.ArrayType(T.LongType())),
        T.StructField("skeleton", T.StringType()),
    ]
)


_END = "\uffff"
_MARKS = re.compile("[\"'“”‘’„«»()\\[\\]{}<>]")
_ENDS = re.compile(r"\s?[,;:—–-]*[.?!…。！？]+(?!\S)")
_REST = re.compile(r"[\W_]+$")


def skeleton(text: str) -> str:
    """A text with quotes and brackets left out, ends of sentences as the greatest sign there
    is, and nothing but words at its end: texts that go on with a sentence sort before those
    that end it, and a text and its copy with a full stop are one."""
    return _REST.sub("", _ENDS.sub(_END, _MARKS.sub("", text)))


def tail_of(parts: list[list[str]], marked: bool) -> list[str]:
    """The last words; in punctuated texts ``<s>`` stands before each sentence."""
    tail: list[str] = []
    for s in reversed(parts):
        tail = (["<s>"] if marked else []) + s + tail
        if len(tail) > _CONTEXT:
            break
    return tail[-_CONTEXT:]


def _shape(text: str) -> tuple:
    end = shown_by_end(text)
    if end == "none":
        return end, False, 0, None, 0, [], None, [], [], ""
    parts, closed = sentences(text, end)
    marked = punctuated(text)
    prefixes, whole = [], []
    last = words = None
    if marked:
        for s in parts if closed else parts[:-1]:
            *inner, final = _chain(s)
            prefixes += inner
            whole.append(final)
        if end == "open" and parts:
            words = " ".join(parts[-1]) if len(parts[-1]) <= CLOSING_WORDS else None
            *_, last = _chain(parts[-1])
    return end, marked, len(parts), last, len(parts[-1]) if parts else 0, tail_of(parts, marked), words, prefixes, whole, skeleton(text)


@F.pandas_udf(_SHAPE)
def _shapes(texts: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame(map(_shape, texts), columns=_SHAPE.names, dtype=object)
    out["last"] = out["last"].astype("Int64")  # else a column with nulls turns to floats
    return out


def features(tail: Sequence[str]) -> list[int]:
    """Slots of the features of a position, from the words up to it: suffixes of up to five
    words, and words and word pairs at fixed distances (fillers of slots between them)."""
    t = ["", *["<0>"] * max(0, _CONTEXT - len(tail)), *[("#:#" if ":" in w else "#") if w[0].isdigit() else w for w in tail]]
    tail = t[len(t) - len(tail) :]
    n = len(t)
    mode = "p" if "<s>" in tail else "u"
    names = [f"{mode}"]
    names += [f"s{k}:" + " ".join(t[n - k :]) for k in range(1, 6)]
    names += [f"w{k}:" + t[n - k] for k in range(2, 8)]
    names += [f"b{k}:" + t[n - k - 1] + " " + t[n - k] for k in range(2, 8)]
    names += [f"g{k}:" + t[n - 1] + "~" + t[n - k] for k in range(3, 7)]
    names += [f"h{k}:" + t[n - 2] + " " + t[n - 1] + "~" + t[n - k] for k in range(4, 7)]
    names += [f"t{k}:" + " ".join(t[n - k - 2 : n - k + 1]) for k in range(2, 6)]
    if "<s>" in tail:
        at = len(tail) - 1 - list(reversed(tail)).index("<s>")
        names += ["o:" + " ".join(tail[at : at + 3]) + f"~{min(len(tail) - at, 9)}", "p:" + " ".join(tail[at : at + 3]) + "~" + t[n - 1]]
    else:
        names += ["-", "-"]
    return [crc32(x.encode("utf-8", "replace")) % _SLOTS for x in names]


def positions_of(text: str) -> list[tuple[list[str], float]]:
    """Last words at positions of a text, and whether a sentence ends there: every sentence end
    and every third other position, with sentence marks and without. The last position of an
    open text counts as an end too: of the true ends without punctuation many are alike, while
    cuts are spread over positions that mostly go on. Of a long text those SAMPLE_POSITIONS
    are taken whose hash is least, wherever they stand."""
    if (how := shown_by_end(text)) == "none":
        return []
    parts, closed = sentences(text)
    if not punctuated(text):
        seen = [w for s in parts for w in s]
        return [(seen[-_CONTEXT:], 1.0)] if how == "open" else []
    out: list[tuple[int, int, int]] = []
    for i, s in enumerate(parts):
        for j in range(len(s)):
            last = j == len(s) - 1
            if last and i == len(parts) - 1 and how not in ("closed", "open"):
                continue
            draw = crc32(f"{i}:{j}:{s[j]}".encode("utf-8", "replace"))
            if last or draw % 100 < 35:
                out.append((draw, i, j))
    rows = []
    for _, i, j in heapq.nsmallest(SAMPLE_POSITIONS, out):
        here = [*parts[max(0, i - _CONTEXT) : i], parts[i][: j + 1]]
        for marked in (True, False):
            rows.append((tail_of(here, marked), float(j == len(parts[i]) - 1)))
    return rows


@F.pandas_udf(T.StructType([T.StructField("slots", T.BinaryType()), T.StructField("ends", T.BinaryType())]))
def _positions(texts: pd.Series) -> pd.DataFrame:
    """Feature slots (32-bit numbers) and ends (bytes) of the positions of each text."""
    rows = []
    for text in texts:
        found = positions_of(text)
        rows.append((np.array([features(tail) for tail, _ in found], np.int32).tobytes(), bytes(int(end) for _, end in found)))
    return pd.DataFrame(rows, columns=["slots", "ends"])


class EndClassifier:
    """Logistic regression over hashed features."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 4, seed: int = 3) -> EndClassifier:
        """From rows of feature slots and labels, by adaptive gradient steps."""
        rng = np.random.default_rng(seed)
        weights = np.zeros(_SLOTS, np.float32)
        if len(x):
            squares = np.full(_SLOTS, 1e-3, np.float32)
            for _ in range(rounds):
                order = rng.permutation(len(x))
                for at in range(0, len(x), 512):
                    own = order[at : at + 512]
                    p = 1 / (1 + np.exp(-weights[x[own]].sum(1)))
                    slope = np.repeat((p - y[own])[:, None], x.shape[1], 1)
                    touched, where = np.unique(x[own], return_inverse=True)
                    g = np.bincount(where.ravel(), slope.ravel(), len(touched)).astype(np.float32)
                    squares[touched] += g * g
                    weights[touched] -= 0.15 * g / np.sqrt(squares[touched]) + 1e-6 * weights[touched]
        return cls(weights)

    def ends(self, tail: Sequence[str]) -> float:
        return float(1 / (1 + np.exp(-self.weights[features(tail)].sum())))


def fitted_classifiers(texts: DataFrame) -> tuple[EndClassifier, EndClassifier]:
    """Two, on the SAMPLE_TEXTS texts with the least hashes: one on those with an even hash,
    one on the others, so that no text is judged by a classifier that has seen it."""
    head = hashed_head(texts.select("text"), "text", SAMPLE_TEXTS, texts.count())
    head = head.repartition(texts.sparkSession.sparkContext.defaultParallelism)  # a limit leaves one partition
    rows = head.select((F.pmod(F.xxhash64("text"), F.lit(2)) == 0).alias("even"), _positions("text").alias("p")).collect()
    models = []
    for even in (True, False):
        own = [r["p"] for r in rows if r["even"] == even]
        y = np.frombuffer(b"".join(r["ends"] for r in own), np.uint8).astype(np.float32)
        x = np.frombuffer(b"".join(r["slots"] for r in own), np.int32).reshape(len(y), -1) if len(y) else np.empty((0, 1), np.int32)
        models.append(EndClassifier.fit(x, y))
    return models[0], models[1]


def with_next(rows: DataFrame, column: str, eligible: Column) -> DataFrame:
    """Adds ``next``: of the distinct values of a column, in sorted order, the next one after
    each row's for which ``eligible`` holds, null after the last.

    Range partitions are sorted on their own; a partition's first eligible value is the next
    one of the last rows before it, so values with a common start are no one task's group."""
    ranged = cut_lineage(
        rows.repartitionByRange(column).withColumn("_pid", F.spark_partition_id()).withColumn("_good", F.when(eligible, F.col(column)))
    )
    firsts = ranged.groupBy("_pid").agg(F.min("_good").alias("_first"))
    # one row a partition; frames that grow, as one that shrinks is summed up anew for each row
    behind = Window.partitionBy(F.lit(0)).orderBy(F.col("_pid").desc()).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select(F.col("_pid").alias("_of"), F.last("_first", True).over(behind).alias("_after"))
    own = Window.partitionBy("_pid").orderBy(F.col(column).desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("_within", F.last("_good", True).over(own)).join(firsts, F.col("_pid") == F.col("_of"), "left")
    return out.withColumn("next", F.coalesce("_within", "_after")).drop("_pid", "_of", "_good", "_within", "_after")


def longer_copies(texts: DataFrame) -> DataFrame:
    """Hashes (h) of skeletons (column skeleton) that go on in a longer text."""
    rows = with_next(texts.where("skeleton <> ''").select("skeleton").distinct(), "skeleton", F.lit(True))
    rest = F.substr("next", F.length("skeleton") + 1)
    return rows.where(
        F.col("next").startswith(F.col("skeleton")) & rest.rlike(f"^[^{_END}]*[\\p{{L}}\\p{{N}}]")
    ).select(F.md5("skeleton").alias("h"))


def broken_words(texts: DataFrame) -> DataFrame:
    """Last words (w) of texts (text, s) that are no words of the corpus but begin some. A word
    of the corpus stands twice, or once and is longer than three letters, elsewhere than at an
    end that may be a cut."""
    plain = F.lower(F.when(F.col("text").rlike(_BRACKET.pattern), F.regexp_replace("text", _NOTE.pattern, " ")).otherwise(F.col("text")))
    words = F.transform(
        F.regexp_extract_all(plain, F.lit(r"\d+(?:[.:,]\d+)*|\p{L}+(?:['’]\p{L}+)*"), F.lit(0)),
        lambda w: F.replace(w, F.lit("’"), F.lit("'")),
    )
    counted = texts.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    open_ = texts.where(~F.col("s.end").isin("closed", "none") & (F.size("s.tail") > 0))
    last = open_.groupBy(F.element_at("s.tail", -1).alias("w")).agg(F.count(F.lit(1)).alias("lasts"))
    inner = F.coalesce("n", F.lit(0)) - F.coalesce("lasts", F.lit(0))
    rows = counted.join(last, "w", "full").select("w", "lasts", ((inner > 1) | ((inner > 0) & (F.length("w") > 3))).alias("known"))
    rows = with_next(rows, "w", F.col("known"))
    return rows.where(~F.col("known") & (F.col("lasts") > 0) & F.col("next").startswith(F.col("w"))).select("w")


def _judge(models: tuple[EndClassifier, EndClassifier]):
    weights = [m.weights for m in models]

    @F.pandas_udf(T.DoubleType())
    def ends(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        seen_even, seen_odd = (EndClassifier(w) for w in weights)
        for tails, evens, closings in batches:
            out = []
            for tail, even, closing in zip(tails, evens, closings):
                own, tail = seen_odd if even else seen_even, list(tail)
                lengths = [0] if closing is None else [0, *(k for k in closing if k < len(tail))]
                out.append(max(own.ends(tail[: len(tail) - k]) for k in lengths))
            yield pd.Series(out, dtype="float64")

    return ends


def judged(texts: DataFrame) -> DataFrame:
    """Distinct texts (column text) that are cut: key (md5 of the text), evidence.

    ``evidence``: marker, note, label, copy, sentence, word or model."""
    distinct = texts.where(F.length(F.trim("text")) > 0).select("text").distinct()
    shaped = cut_lineage(distinct.withColumn("s", _shapes("text")))
    models = fitted_classifiers(shaped.select("text"))
    rows = shaped.select(
        F.md5("text").alias("key"), (F.pmod(F.xxhash64("text"), F.lit(2)) == 0).alias("even"), "s.end", "s.marked", "s.parts", "s.last",
        "s.n", "s.tail", "s.words", F.md5("s.skeleton").alias("h"),
    )
    shown = rows.where(F.col("end").isin("marker", "note", "label")).select("key", F.col("end").alias("evidence"))
    open_ = rows.where("end = 'open'")
    # finished sentences elsewhere, by the hashes of their word prefixes; counted before the shuffle
    finished = (
        shaped.select(
            F.explode(
                F.concat(
                    F.transform("s.prefixes", lambda h: F.struct(h.alias("h"), F.lit(0).alias("w"))),
                    F.transform("s.whole", lambda h: F.struct(h.alias("h"), F.lit(1).alias("w"))),
                )
            ).alias("p")
        )
        .groupBy(F.col("p.h").alias("h")).agg(F.sum(1 - F.col("p.w")).alias("goes_on"), F.sum("p.w").alias("complete"))
    )
    asked = open_.where(F.col("last").isNotNull()).groupBy(F.col("last").alias("h")).agg(F.count(F.lit(1)).alias("finals"))
    known = asked.join(finished, "h", "left").select(
        F.col("h").alias("last"), "finals", F.coalesce("goes_on", F.lit(0)).alias("goes_on"),
        F.coalesce("complete", F.lit(0)).alias("complete"),
    )
    totals = shaped.agg(F.sum(F.size("s.prefixes")).alias("p"), F.sum((F.col("s.end") == "open").cast("long")).alias("o")).first()
    rate = (totals["o"] or 0) / max(totals["p"] or 0, 1)  # cuts a word, if all open texts were cut
    known = known.withColumn("closes", (F.col("finals") >= CLOSING_TEXTS) & (F.col("finals") > CLOSING_TIMES * rate * F.col("goes_on")))
    copies = longer_copies(shaped.select("s.skeleton")).withColumn("copy", F.lit(True))
    broken = broken_words(shaped).withColumn("breaks", F.lit(True))
    open_ = cut_lineage(
        open_.join(known, "last", "left").join(copies, "h", "left").withColumn(
            "w", F.element_at(F.when(F.size("tail") > 0, F.col("tail")), -1),
        ).join(broken, "w", "left")
        .withColumn("copy", F.coalesce("copy", F.lit(False))).withColumn("breaks", F.coalesce("breaks", F.lit(False))).drop("h", "w", "last")
    )
    # closing words at the end of texts without punctuation
    closing = open_.where(F.col("closes") & F.col("words").isNotNull()).select("words").distinct()
    suffix = lambda k: F.array_join(F.slice("tail", -k, k), " ")
    ends_with = F.explode(
        F.array(*[F.when(F.size("tail") > k, F.struct(F.lit(k).alias("k"), suffix(k).alias("words"))) for k in range(1, CLOSING_WORDS + 1)])
    ).alias("x")
    own = open_.where(~F.array_contains("tail", "<s>")).select("key", ends_with).where("x is not null").select("key", "x.k", "x.words")
    own = own.join(closing, "words", "left_semi").groupBy("key").agg(F.collect_list("k").alias("closing"))
    open_ = open_.join(own, "key", "left").withColumn("ends", _judge(models)("tail", "even", "closing"))
    on, whole = F.coalesce(F.col("goes_on"), F.lit(0)), F.coalesce(F.col("complete"), F.lit(0))
    finished_elsewhere = (whole > 0) & (whole >= 0.1 * on)
    evidence = (
        # without punctuation, what follows in the longer copy may be another sentence; a
        # single sentence may be finished and begin others, too
        F.when(
            F.col("copy") & (F.col("marked") | (F.col("ends") < LEAST_END)) & ((F.col("parts") > 1) | ~finished_elsewhere), F.lit("copy"),
        )
        .when(finished_elsewhere, F.lit(None))
        .when(F.coalesce(F.col("closes"), F.lit(False)) & (F.col("n") <= CLOSING_WORDS) & ~F.col("breaks"), F.lit(None))
        .when((on > 2) | ((on > 0) & (F.col("ends") < SURE_END)), F.lit("sentence"))
        .when(F.col("breaks"), F.lit("word"))
        .when(F.col("ends") < LEAST_END, F.lit("model"))
    )
    return shown.unionByName(open_.withColumn("evidence", evidence).where(F.col("evidence").isNotNull()).select("key", "evidence"))


def reply_rows(parse_results: DataFrame) -> DataFrame:
    return parse_results.select(
        F.lit("reply").alias("record_kind"), F.col("request_id").cast("string").alias("record_id"), "source_name",
        F.col("raw_text").alias("text"),
    )


def score_rows(direction_scores: DataFrame) -> DataFrame:
    return direction_scores.select(
        F.lit("score").alias("record_kind"), F.col("delivery_id").cast("string").alias("record_id"), "source_name", "text",
    )


def truncated(parse_results: DataFrame, direction_scores: DataFrame) -> DataFrame:
    """Cut rows of both tables: record_kind, record_id, source_name, evidence.

    Null, empty and blank texts are no cases; each copy counts; token counts are not used,
    as finished texts may reach a limit and missing counts say nothing.
    """
    rows = reply_rows(parse_results).unionByName(score_rows(direction_scores))
    cut = judged(rows.select("text"))
    return rows.withColumn("key", F.md5("text")).join(cut, "key").select("record_kind", "record_id", "source_name", "evidence")


def truncation_rates(parse_results: DataFrame, direction_scores: DataFrame) -> DataFrame:
    """Per table and source_name: rows with text, cut rows, share of cut rows."""
    rows = reply_rows(parse_results).unionByName(score_rows(direction_scores)).where(F.length(F.trim("text")) > 0)
    cut = judged(rows.select("text"))
    joined = rows.withColumn("key", F.md5("text")).join(cut, "key", "left")
    n, c = F.count(F.lit(1)), F.count("evidence")
    return joined.groupBy("record_kind", "source_name").agg(n.alias("texts"), c.alias("cut"), F.round(c / n, 6).alias("share"))
