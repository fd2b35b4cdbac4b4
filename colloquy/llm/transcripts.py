"""Raw transcript rows into clean, ordered speaker turns.

The text of a row is lexed into tokens, each token has an observable class, and a hidden
Markov model tags the sequence as speaker, timestamp, annotation, filler or speech, decoded
by Viterbi. What a round bracket holds may be a sound note or a spoken aside, and no token
says which: each word in it is seen through its evidence in the corpus (how often it stands
in brackets that only notes have, and how often in running text) and its form, and the model
decides for the bracket as a whole, as its transitions inside brackets keep to one tag. Runs
of one class outside brackets are one observation, so that few distinct sequences are decoded.
Turns are assembled from the tags: a label holds until the next one, words belong to the
label in force, and everything else is left out.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, stored_table

TAGS = ("speaker", "timestamp", "annotation", "filler", "speech")
#: Hidden states: one a tag, and ``pause``, what is not speech within a spoken aside.
STATES = (*TAGS, "pause")
#: Observable classes of tokens. Those in brackets: the brackets themselves, words mostly
#: seen in notes, words mostly seen in running text, function words, and new words, with and
#: without an ending of verbs and nouns of action.
CLASSES = (
    "start", "line", "label", "clock_marked", "clock_long", "clock_dash", "clock", "note", "sound", "mark", "word",
    "in_open", "in_close", "in_note", "in_said", "in_function", "in_new", "in_verbal", "in_sound", "in_group",
)
_INSIDE = frozenset(c for c in CLASSES if c.startswith("in_"))
#: Log odds from which a word counts as one of notes, or of running text.
CLEAR_ODDS = 1.0
#: Ordinals of one record that one window handles; longer records are joined in a second step.
ORDINALS = 4_096

# Hesitation sounds, and function words.
SOUND = re.compile(r"(?:u+h+|u+m+|u+hm+|e+r+m*|e+h+m+|eh|h+m+|m{2,}|m+h+m+|mm+-?h+m+|m+-m+|uh+-?hu+h+|uh-uh|ä+h+m*|ö+h+m*|a+hm+)", re.I)
FUNCTION_WORDS = frozenset(
    "a an the this that these those my your his her its our their i you he she it we they me us them at in on of to for from by with before after until not no yes is are was were be been do does did has have had will would can could should if so but and or as "
    "than then there here what who when where why how which all one least der die das ich wir sie im am zu mit nicht le la les un une je nous dans pas el los en con no se".split()
)
_VERBAL = re.compile(r".{2,}(?:ing|[^s]s|ter)$")
_CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
LEXER = re.compile(
    rf"(?P<cue>{_CLOCK}\s*-->\s*{_CLOCK})"
    rf"|(?P<marked>[\[(<{{]\s*{_CLOCK}\s*[\])>}}]|@\d+(?:\.\d+)?s\b)"
    r"|(?P<group>\(\([^()\n]*\)\)|\[\[?[^\[\]\n]*\]?\]|\{[^{}\n]*\}|<[^<>\n]*>|\*[^*\n]{1,40}\*|♪[^♪\n]*♪)"
    r"|(?P<round>\((?=[^()\n]*\)))"
    rf"|(?P<clock>(?<![\w:.]){_CLOCK}(?![\w:]))"
    r"|(?P<line>[\n\r\u2028\u2029]+)"
    r"|(?P<word>[^\s\[\]{}<>()♪]+|[\[\]{}<>()♪])"
)
_NOTES = re.compile(r"\(\([^()\n]*\)\)|\([^()\n]*\)|\[\[?[^\[\]\n]*\]?\]|\{[^{}\n]*\}|<[^<>\n]*>|\*[^*\n]{1,40}\*|♪[^♪\n]*♪")
_ROUND = re.compile(r"\([^()\n]*\)")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_EDGES = re.compile(r"^\W+|\W+$")
_PIECE = re.compile(r"\S+")
_SOMETHING = re.compile(r"[\n\r\u2028\u2029]|\S")
_LABEL = re.compile(r"(?:>>+\s*)?(?P<name>[^\s:|>\[\](){}<][^:|>\[\]{}<\n]{0,60}?)\s*[:|]")
_NUMBERED = re.compile(r"(?:speaker|spkr?|s)[\s_\-]*0*(\d+)")


def _distance_one(a: str, b: str) -> bool:
    """One insertion, deletion, substitution or swap of neighbours apart."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


class Roster:
    """Numbers of the speakers of one dialogue by any way to name them."""

    def __init__(self, entries: Iterable[tuple[int, str | None, str | None]]) -> None:
        self.exact: dict[str, int | None] = {}
        self.names: list[tuple[str, int]] = []
        for number, name, role in entries:
            if name and name.strip():
                parts = name.lower().split()
                first, last = parts[0], parts[-1]
                for form in {" ".join(parts), first, last, f"{first[0]}. {last}", f"{last}, {first}"}:
                    self._add(form, number)
                    self.names.append((form, number))
            if role and role.strip():
                self._add(" ".join(role.lower().split()), number)
        self._known: dict[str, int | None] = {}

    def _add(self, form: str, number: int) -> None:
        """A form that two speakers share names neither."""
        self.exact[form] = number if self.exact.get(form, number) == number else None

    def number(self, label: str | None) -> int | None:
        if not label:
            return None
        if label not in self._known:
            self._known[label] = self._find(label)
        return self._known[label]

    def _find(self, label: str) -> int | None:
        text = re.sub(r"^\W*(?:v\s+(?=\S))?|[\s:|>\]]+$", "", label.strip()) if label.lstrip().startswith("<v") else re.sub(r"^[\s<\[>]+|[\s:|>\]]+$", "", label)
        text = " ".join(text.lower().split())
        if found := _NUMBERED.fullmatch(text):
            return int(found.group(1))
        if text in self.exact:
            return self.exact[text]
        if found := re.fullmatch(r"(.+?) ?\((.+)\)", text):
            inner = self._find(found.group(2))
            return inner if inner is not None else self._find(found.group(1))
        if len(text) >= 5:
            near = {n for form, n in self.names if _distance_one(text, form)}
            if len(near) == 1:
                return near.pop()
        return None


class Words:
    """Evidence of words in notes and in running text: log odds of the two frequencies."""

    def __init__(self, odds: dict[str, float] | None = None) -> None:
        self.odds = odds or {}
        self._outside: dict[str, str] = {}

    @staticmethod
    def counts(texts: Iterable[str]) -> tuple[Counter[str], Counter[str], set[str]]:
        """Words in brackets that hold notes only, words outside of any, and the words that stand
        in round brackets: only of these is the evidence ever asked for."""
        notes: Counter[str] = Counter()
        said: Counter[str] = Counter()
        asked: set[str] = set()
        for text in texts:
            at = 0
            for found in _NOTES.finditer(text):
                said.update(_WORD.findall(text[at : found.start()].lower()))
                if found.group(0)[0] != "(" or found.group(0).startswith("(("):
                    notes.update(_WORD.findall(found.group(0).lower()))
                at = found.end()
            said.update(_WORD.findall(text[at:].lower()))
            for inner in _ROUND.findall(text):
                asked.update(_WORD.findall(inner.lower().replace("’", "'")))
        return notes, said, asked

    @classmethod
    def weighed(cls, counted: Iterable[tuple[str, int, int]], in_notes: int, in_text: int) -> Words:
        """From words with their two counts, and the totals of all words."""
        n, m = in_notes + 100, in_text + 100
        return cls({w: math.log((a + 0.1) / n) - math.log((b + 0.1) / m) for w, a, b in counted})

    @classmethod
    def of(cls, texts: Iterable[str]) -> Words:
        """Counted in brackets that hold notes only, and outside of any."""
        notes, said, _ = cls.counts(texts)
        return cls.weighed(((w, notes[w], said[w]) for w in notes.keys() | said.keys()), sum(notes.values()), sum(said.values()))

    def outside(self, token: str) -> str:
        """Class of a token of running text."""
        found = self._outside.get(token)
        if found is None:
            core = _EDGES.sub("", token)
            # "mm" after a number too: speech has no unit signs
            found = "mark" if not core else "sound" if SOUND.fullmatch(core) else "word"
            if len(self._outside) < 500_000:
                self._outside[token] = found
        return found

    def inside(self, token: str) -> str:
        """Class of a token in a round bracket."""
        core = _EDGES.sub("", token).lower().replace("’", "'")
        if not core or SOUND.fullmatch(core):
            return "in_sound"
        if core in FUNCTION_WORDS or not any(c.isalpha() for c in core):
            return "in_function"
        odds = [self.odds[w] for w in _WORD.findall(core) if w in self.odds]
        if odds and abs(max(odds)) >= CLEAR_ODDS:
            return "in_note" if max(odds) > 0 else "in_said"
        return "in_verbal" if not odds and _VERBAL.fullmatch(core) else "in_new"


Token = tuple[int, int, str, int | None]
_SPECIAL = re.compile(r"[\[\](){}<>*♪@:|\n\r\u2028\u2029]")


def lex(text: str, roster: Roster, words: Words) -> list[Token]:
    """Tokens of a row: start, end, class, and of a label its number."""
    if not _SPECIAL.search(text):  # no label, clock, bracket or line end
        return [(found.start(), found.end(), words.outside(found.group(0)), None) for found in _PIECE.finditer(text)]
    out: list[Token] = []
    at, fresh, n, closes = 0, True, len(text), -1
    while (found := _SOMETHING.search(text, at)) is not None:
        at = found.start()
        if fresh and closes < at and (label := _LABEL.match(text, at)) and (number := roster.number(label.group("name"))) is not None:
            out.append((at, label.end(), "label", number))
            at, fresh = label.end(), False
            continue
        found = LEXER.match(text, at)
        kind, token, end = found.lastgroup, found.group(0), found.end()
        number, inside = None, at < closes
        if at == closes:
            cls = "in_close"
        elif kind in ("cue", "marked"):
            cls = "in_group" if inside else "clock_marked"
        elif kind == "clock":
            follows = re.match(r"\s+[-–—]\s", text[end : end + 8])
            cls = "clock_long" if token.count(":") == 2 else "clock_dash" if fresh and follows else "clock"
            if inside:
                cls = "in_function"  # a time somebody says
        elif kind == "line":
            cls, fresh = "line", True
        elif kind == "group":
            cls = "in_group" if inside else "note"
            if not inside and token[0] in "[<" and fresh and (number := roster.number(token)) is not None:
                cls = "label"
        elif kind == "round":
            cls, end, closes = "in_open", at + 1, text.index(")", at)
        else:
            cls = words.inside(token) if inside else words.outside(token)
        out.append((at, end, cls, number))
        if cls in ("word", "sound", "label", "clock") or cls in _INSIDE:
            fresh = False
        at = end
        if at >= n:
            break
    return out


_FLAT = np.zeros((len(STATES), len(STATES)))


class Tagger:
    """A hidden Markov model over token classes: log transition, outside and inside round
    brackets, and emission; ``words`` is the evidence words are classed by.

    Outside and inside brackets are two regimes: a state's emissions are normalised in each
    of them. The way into a bracket favours no state, and after it things go on as in speech."""

    def __init__(self, transition: np.ndarray, inside: np.ndarray, emission: np.ndarray, words: Words | None = None) -> None:
        self.transition, self.inside, self.emission, self.words = transition, inside, emission, words or Words()
        self.after = np.tile(transition[STATES.index("speech")], (len(STATES), 1))

    @classmethod
    def prior(cls, words: Words | None = None) -> Tagger:
        """Counts to begin with, as if seen: which classes a state emits, which states follow."""
        emits = np.full((len(STATES), len(CLASSES)), 0.01)
        for state, counts in {
            "speaker": {"label": 60},
            "timestamp": {"clock_marked": 60, "clock_long": 20, "clock_dash": 20, "clock": 0.5},
            "annotation": {
                "note": 60, "in_group": 5, "in_note": 24, "in_said": 4, "in_function": 2, "in_new": 13, "in_verbal": 24, "in_sound": 0.5,
            },
            "filler": {"sound": 60, "mark": 20},
            "speech": {
                "word": 200, "clock": 20, "mark": 10, "sound": 0.2, "clock_long": 0.2, "in_note": 2, "in_said": 20, "in_function": 20,
                "in_new": 11, "in_verbal": 3,
            },
            "pause": {"in_sound": 60, "in_group": 20},
        }.items():
            for c, n in counts.items():
                emits[STATES.index(state), CLASSES.index(c)] = n
        follows = np.full((len(STATES), len(STATES)), 5.0)
        follows[:, STATES.index("pause")] = 0.01
        # in a bracket a tag holds to its end, but for pauses in what is spoken
        inside = np.full((len(STATES), len(STATES)), 1e-6)
        speech, note, pause = (STATES.index(x) for x in ("speech", "annotation", "pause"))
        inside[note, note] = 1.0
        inside[speech, speech], inside[speech, pause], inside[pause, speech], inside[pause, pause] = 0.8, 0.2, 0.8, 0.2
        return cls(cls._rows(follows), cls._rows(inside), cls._emission(emits), words)

    @staticmethod
    def _rows(table: np.ndarray) -> np.ndarray:
        return np.log(table / table.sum(1, keepdims=True))

    @classmethod
    def _emission(cls, emits: np.ndarray) -> np.ndarray:
        out = np.zeros_like(emits)
        brackets = {CLASSES.index("in_open"), CLASSES.index("in_close")}
        inner = [i for i, c in enumerate(CLASSES) if c in _INSIDE and i not in brackets]
        outer = [i for i, c in enumerate(CLASSES) if c not in _INSIDE]
        for block in (inner, outer):
            out[:, block] = cls._rows(emits[:, block])
        closed = [i for i, s in enumerate(STATES) if s not in ("annotation", "speech")]
        out[np.ix_(closed, sorted(brackets))] = -20.0  # only notes and asides have brackets
        return out

    def step(self, before: str, cls: str) -> np.ndarray:
        """Transitions from a token of one class to one of another."""
        if cls == "in_open":
            return _FLAT
        if before == "in_close":
            return self.after
        return self.inside if cls in _INSIDE else self.transition

    def score(self, classes: Sequence[str], path: Sequence[int]) -> float:
        """Log probability of states for a line of classes, up to a constant."""
        own = sum(self.emission[t, CLASSES.index(c)] for c, t in zip(classes, path))
        return float(own + sum(self.step(x, c)[a, b] for x, c, a, b in zip(classes, classes[1:], path, path[1:])))

    def decode(self, classes: Sequence[str]) -> tuple[int, ...]:
        """The most likely states (Viterbi); row and line starts are given, not tagged (-1)."""
        tags: list[int] = [-1] * len(classes)
        begin = 0
        for stop in [i for i, c in enumerate(classes) if c in ("start", "line")] + [len(classes)]:
            seen = classes[begin:stop]
            if seen:
                score, back = self.emission[:, CLASSES.index(seen[0])], []
                for before, c in zip(seen, seen[1:]):
                    step = score[:, None] + self.step(before, c)
                    back.append(step.argmax(0))
                    score = step.max(0) + self.emission[:, CLASSES.index(c)]
                best = int(score.argmax())
                path = [best]
                for pointers in reversed(back):
                    path.append(best := int(pointers[best]))
                tags[begin:stop] = reversed(path)
            begin = stop + 1
        return tuple(tags)

    def fitted(self, sequences: Iterable[Sequence[str]], rounds: int = 2, weight: float = 50.0) -> Tagger:
        """Re-estimated on what it decodes (Viterbi training), with the prior as
        pseudo-counts of ``weight`` times its probabilities. Transitions inside brackets are
        kept: they are what makes a bracket one thing."""
        model, counted = self, Counter(tuple(s) for s in sequences)
        for _ in range(rounds):
            model = self.estimated(*model.tallies(counted.items()), weight)
        return model

    def tallies(self, counted: Iterable[tuple[Sequence[str], int]]) -> tuple[np.ndarray, np.ndarray]:
        """How often states follow each other and emit classes in what is decoded of sequences,
        each with its number. Tallies of parts add up to those of the whole."""
        follows, emits = np.zeros_like(self.transition), np.zeros_like(self.emission)
        for s, n in counted:
            tags = self.decode(s)
            for i, (c, t) in enumerate(zip(s, tags)):
                if t >= 0:
                    emits[t, CLASSES.index(c)] += n
                    if i and tags[i - 1] >= 0 and self.step(s[i - 1], c) is self.transition:
                        follows[tags[i - 1], t] += n
        return follows, emits

    def estimated(self, follows: np.ndarray, emits: np.ndarray, weight: float = 50.0) -> Tagger:
        """The tagger of tallies, with this one as the prior."""
        follows, emits = follows + np.exp(self.transition) * weight, emits + np.exp(self.emission) * weight * 4
        # runs of words are one observation, so the way from speech to speech is undercounted:
        # it is at least as frequent as all others
        speech = STATES.index("speech")
        follows[speech, speech] = max(follows[speech, speech], follows[speech].sum() - follows[speech, speech])
        return Tagger(self._rows(follows), self.inside, self._emission(emits), self.words)


def collapsed(classes: Sequence[str]) -> tuple[tuple[str, ...], list[int]]:
    """Runs of a class outside brackets as one, and for each token its run."""
    out: list[str] = []
    runs: list[int] = []
    for c in classes:
        if not out or out[-1] != c or c in _INSIDE:
            out.append(c)
        runs.append(len(out) - 1)
    return tuple(out), runs


_SPEECH, _SPEAKER = STATES.index("speech"), STATES.index("speaker")


def said(text: str | None, label: str | None, roster: Roster, decode, words: Words | None = None) -> list[tuple[int | None, int, str]]:
    """What is said in a row: speaker number, number of words, text, in order."""
    speaker = roster.number(label)
    if not text:
        return []
    tokens = lex(text, roster, words or Words())
    sequence, runs = collapsed([t[2] for t in tokens])
    tags = decode(sequence)
    pieces: list[tuple[int | None, list[str]]] = [(speaker, [])]
    end = 0
    for (start, stop, _, number), run in zip(tokens, runs):
        tag = tags[run]
        if tag == _SPEECH:
            if pieces[-1][1] and start == end:  # no white space between the two
                pieces[-1][1][-1] += text[start:stop]
            else:
                pieces[-1][1].append(text[start:stop])
            end = stop
        elif tag == _SPEAKER and number is not None:
            pieces.append((number, []))
    out: list[tuple[int | None, int, str]] = []
    for number, own in pieces:
        count = sum(any(map(str.isalnum, w)) for w in own)
        if count and out and out[-1][0] == number:
            out[-1] = (number, out[-1][1] + count, out[-1][2] + " " + " ".join(own))
        elif count:
            out.append((number, count, " ".join(own)))
    return out


_SAID = T.ArrayType(
    T.StructType(
        [T.StructField("speaker_no", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("text", T.StringType())]
    )
)


def _rosters(roster: DataFrame) -> DataFrame:
    """uniq_id and its speakers as one text; a dialogue has a handful."""
    entry = F.to_json(F.array(F.col("speaker_no").cast("int").cast("string"), "display_name", "role_title"), {"ignoreNullFields": "false"})
    return roster.where(F.col("speaker_no").isNotNull()).groupBy("uniq_id").agg(F.array_join(F.sort_array(F.collect_set(entry)), "\n").alias("_roster"))


def _roster_of(entries: str | None) -> Roster:
    rows = [json.loads(line) for line in entries.split("\n")] if entries else []
    return Roster((int(n), name, role) for n, name, role in rows)


def _said_column(tagger: Tagger):
    tables, odds = (tagger.transition, tagger.inside, tagger.emission), tagger.words.odds

    @F.arrow_udf(_SAID)
    def column(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        words = Words(odds)  # once a task, as are the memories below
        decode = lru_cache(maxsize=100_000)(Tagger(*tables).decode)
        build = lru_cache(maxsize=10_000)(_roster_of)
        for texts, labels, rosters in batches:
            offsets, numbers, counts, kept = [0], [], [], []
            for text, label, entries in zip(texts.to_pylist(), labels.to_pylist(), rosters.to_pylist()):
                for number, n, joined in said(text, label, build(entries), decode, words):
                    numbers.append(number)
                    counts.append(n)
                    kept.append(joined)
                offsets.append(len(counts))
            fields = [pa.array(numbers, pa.int32()), pa.array(counts, pa.int32()), pa.array(kept, pa.string())]
            yield pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, ["speaker_no", "n_words", "text"]),
            )

    return column


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        notes, said, asked = Words.counts(batch.column("text").to_pylist())
        words = list(notes.keys() | said.keys() | asked)
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in (notes, said)), pa.array([w in asked for w in words], pa.bool_())],
            ["word", "notes", "said", "asked"],
        )


def _sequences(odds: dict[str, float]):
    def lexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, nobody = Words(odds), Roster(())
        for batch in batches:
            found = Counter(" ".join(collapsed([t[2] for t in lex(text, nobody, words)])[0]) for text in batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["classes", "n"])

    return lexed


def _tallied(tables: tuple[np.ndarray, np.ndarray, np.ndarray]):
    def tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Tagger(*tables)
        follows, emits = np.zeros_like(model.transition), np.zeros_like(model.emission)
        for batch in batches:
            f, e = model.tallies((s.split(), n) for s, n in zip(batch.column("classes").to_pylist(), batch.column("n").to_pylist()))
            follows, emits = follows + f, emits + e
        yield pa.RecordBatch.from_arrays([pa.array([x.ravel().tolist()], pa.list_(pa.float64())) for x in (follows, emits)], ["follows", "emits"])

    return tallies


def fitted_tagger(rows: DataFrame, rounds: int = 2) -> Tagger:
    """The tagger with word evidence and parameters from all distinct texts.

    Words and sequences of classes are counted, and sequences decoded, where the texts are; the
    driver gets the words that stand in round brackets, and one pair of tables a task."""
    texts = stored_table(rows.where(F.length("text") > 0).select("text").distinct(), "texts")
    counts = texts.mapInArrow(_word_counts, "word string, notes bigint, said bigint, asked boolean")
    counts = cut_lineage(counts.groupBy("word").agg(F.sum("notes").alias("notes"), F.sum("said").alias("said"), F.max("asked").alias("asked")))
    total = counts.agg(F.coalesce(F.sum("notes"), F.lit(0)), F.coalesce(F.sum("said"), F.lit(0))).first()
    asked = counts.where("asked and notes + said > 0").select("word", "notes", "said").collect()
    words = Words.weighed(asked, *total)
    found = texts.mapInArrow(_sequences(words.odds), "classes string, n bigint").groupBy("classes").agg(F.sum("n").alias("n"))
    found = stored_table(found, "sequences")  # read in each round
    prior = model = Tagger.prior(words)
    for _ in range(rounds):
        parts = found.mapInArrow(_tallied((model.transition, model.inside, model.emission)), "follows array<double>, emits array<double>").collect()
        follows, emits = (sum((np.array(p[k]).reshape(x.shape) for p in parts), np.zeros_like(x)) for k, x in (("follows", prior.transition), ("emits", prior.emission)))
        model = prior.estimated(follows, emits)
    return model


def one_rendering(rows: DataFrame) -> DataFrame:
    """One row per record and ordinal (columns record_id, ordinal, label, text, loaded_at):
    one with text before one without, then the first loaded, then the least."""
    order = F.struct(
        F.coalesce(F.length(F.trim("text")) == 0, F.lit(True)).alias("b"), F.col("loaded_at").isNull().alias("n"), "loaded_at", "text",
        "label", "uniq_id",
    )
    return rows.groupBy("record_id", "ordinal").agg(F.min(order).alias("_o")).select("record_id", "ordinal", "_o.text", "_o.label", "_o.uniq_id")


def clean_turns(rows: DataFrame, roster: DataFrame, tagger: Tagger | None = None, texts: bool = False) -> DataFrame:
    """Turns of records: record_id, turn_no, speaker_no, n_words (and text).

    ``rows``: record_id, uniq_id, ordinal, label, text, loaded_at. A turn is what one
    speaker says until another says a word; rows without words make and end none. Rows of
    which no label names a speaker have the speaker null, one speaker more. Null ordinals
    come first and count as one ordinal. A null record is a record; dialogues without a
    roster know numbered labels only. ``texts`` gathers each turn's text, so ask for it only
    where a single turn fits in memory.

    A record is handled in stretches of ORDINALS ordinals, whose first and last turns are
    then joined, so a record with a third of all rows is many tasks.
    """
    tagger = tagger or fitted_tagger(rows)
    single = one_rendering(rows).join(_rosters(roster), "uniq_id", "left")
    spoken = single.select("record_id", "ordinal", F.posexplode(_said_column(tagger)("text", "label", "_roster")).alias("piece", "s"))
    spoken = spoken.select("record_id", "ordinal", "piece", "s.speaker_no", "s.n_words", *(["s.text"] if texts else []))
    spoken = spoken.withColumn("stretch", F.coalesce(F.floor(F.col("ordinal") / ORDINALS).cast("long"), F.lit(-(1 << 60)).cast("long")))
    order = Window.partitionBy("record_id", "stretch").orderBy("ordinal", "piece")
    starts = F.row_number().over(order) == 1
    changes = ~F.col("speaker_no").eqNullSafe(F.lag("speaker_no").over(order))
    spoken = spoken.withColumn("_new", (starts | changes).cast("long"))
    spoken = spoken.withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.struct("ordinal", "piece")
    gathered = [F.sort_array(F.collect_list(F.struct("ordinal", "piece", "text"))).alias("_texts")] if texts else []
    islands = spoken.groupBy("record_id", "stretch", "island").agg(
        F.max("speaker_no").alias("speaker_no"), F.sum("n_words").alias("n_words"), F.min(first).alias("_first"), *gathered,
    )
    islands = cut_lineage(islands)  # read twice below; the texts are tagged once
    ends = islands.groupBy("record_id", "stretch").agg(
        F.max("island").alias("_n"), F.min_by(F.struct("speaker_no"), "island").alias("_a"), F.max_by(F.struct("speaker_no"), "island").alias("_z")
    )
    along = Window.partitionBy("record_id").orderBy("stretch")
    ends = ends.withColumn(
        "_joins", F.coalesce(F.lag("_z").over(along).eqNullSafe(F.col("_a")) & (F.row_number().over(along) > 1), F.lit(False)).cast("long"),
    )
    ends = ends.withColumn(
        "_base",
        F.coalesce(F.sum(F.col("_n") - F.col("_joins")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_joins"),
    )
    same = F.col("record_id").eqNullSafe(F.col("_r")) & (F.col("stretch") == F.col("_s"))
    numbered = islands.join(
        ends.select(F.col("record_id").alias("_r"), F.col("stretch").alias("_s"), "_base"), same,
    ).withColumn("turn_no", (F.col("_base") + F.col("island")).cast("int"))
    out = numbered.groupBy("record_id", "turn_no").agg(
        F.max("speaker_no").alias("speaker_no"), F.sum("n_words").cast("int").alias("n_words"),
        *([F.array_join(F.transform(F.sort_array(F.flatten(F.collect_list("_texts"))), lambda x: x["text"]), " ").alias("text")] if texts else []),
    )
    return out.select("record_id", "turn_no", "speaker_no", "n_words", *(["text"] if texts else []))


def segment_rows(segments: DataFrame) -> DataFrame:
    return segments.select(
        F.col("request_id").alias("record_id"), "uniq_id", F.col("seg_ord").alias("ordinal"), F.col("speaker").alias("label"), "text",
        "loaded_at",
    )


def score_rows(turns: DataFrame) -> DataFrame:
    return turns.select(
        F.col("uniq_id").alias("record_id"), "uniq_id", F.col("turn_index").alias("ordinal"), F.col("speaker_id").alias("label"),
        F.col("reference_text").alias("text"), "loaded_at",
    )


def transcript_turns(segments: DataFrame, score_turns: DataFrame, roster: DataFrame, texts: bool = False) -> DataFrame:
    """Clean turns of both tables: origin, record_id, turn_no, speaker_no, n_words."""
    tag = lambda df, origin: df.withColumn("record_id", F.struct(F.lit(origin).alias("o"), F.col("record_id").alias("r")))
    rows = tag(segment_rows(segments), "segment").unionByName(tag(score_rows(score_turns), "score"))
    tagger = fitted_tagger(rows.select("text"))
    out = clean_turns(rows, roster, tagger, texts)
    return out.select(F.col("record_id.o").alias("origin"), F.col("record_id.r").alias("record_id"), *out.columns[1:])
