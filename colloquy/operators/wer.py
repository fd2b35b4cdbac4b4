"""Word error rates of multi-speaker transcripts, and n-gram overlap.

A session is one row of word arrays, so a batch of sessions is one Arrow batch. The
distances are numpy dynamic programmes; speakers are assigned exactly.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass
from difflib import SequenceMatcher
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.manifests import content_hash
from . import streams as by_stream
from .diarization import assignment


@dataclass(frozen=True)
class Pins:
    """What word error rates were computed with; ``pin_hash`` stands for all of it."""

    collar_seconds: float = 5.0
    word_timing: str = "character_based"
    reference_sort: str = "segment"
    hypothesis_sort: str = "segment"
    method: str = "published definitions"

    def pin_hash(self) -> str:
        return content_hash(asdict(self))


#: Largest number of cells of the assignment search that is tried where no other is given; beyond it, refused.
MOST_CELLS = 2_000_000_000
#: Searches of more cells go stream by stream instead of through one table, to the same count.
TABLE_CELLS = 50_000


def distance(a: list[str], b: list[str], allowed: np.ndarray | None = None) -> int:
    """Word edit distance; ``allowed[i, j]`` says whether a[i] and b[j] may be aligned."""
    codes: dict[str, int] = {}
    x = np.array([codes.setdefault(w, len(codes)) for w in a], np.int64)
    y = np.array([codes.setdefault(w, len(codes)) for w in b], np.int64)
    index = np.arange(len(y) + 1)
    row = index.copy()
    for i, w in enumerate(x):
        step = (y != w).astype(np.int64)
        if allowed is not None:
            step = np.where(allowed[i], step, 2)
        new = np.empty_like(row)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + step)
        row = np.minimum.accumulate(new - index) + index
    return int(row[-1])


Span = tuple[float, float]
#: Numbers that the tables of ``pair_distances`` have at once, about.
PAIR_CELLS = 1 << 22


def running_least(table: np.ndarray) -> None:
    """The running least along the first axis, in place. Where there are many columns by
    doubling: a few vector steps instead of one number after the other."""
    n, width = len(table), 1
    if table.size < 64 * n:
        np.minimum.accumulate(table, axis=0, out=table)
        return
    while width < n:
        np.minimum(table[width:], table[:-width], out=table[width:])
        width *= 2


def _padded(rows: list, width: int, none) -> np.ndarray:
    out = np.full((len(rows), width, *np.shape(none)), none)
    for i, own in enumerate(rows):
        if len(own):
            out[i, : len(own)] = own
    return out


def pair_distances(
    ref: list[list[str]], hyp: list[list[str]], times: tuple[list[list[Span]], list[list[Span]]] | None = None, collar: float = 0.0,
) -> np.ndarray:
    """``distance`` of all pairs of streams at once: [0, i, j] free, and with the ``times`` of all
    words [1, i, j] within the collar."""
    codes: dict[str, int] = {}
    code = lambda rows: [[codes.setdefault(w, len(codes)) for w in own] for own in rows]
    width = max(map(len, hyp), default=0)
    ends = np.array([len(h) for h in hyp], int)
    y = _padded(code(hyp), width, -1)
    kinds = 1 if times is None else 2
    out = np.zeros((kinds, len(ref), len(hyp)), np.int64)
    if not ref or not hyp:
        return out
    if times is not None:
        span = _padded(times[1], width, (0.0, 0.0))
        low, high = span[..., 0] - collar, span[..., 1] + collar
    part = max(1, PAIR_CELLS // (len(hyp) * (width + 1)))
    for first in range(0, len(ref), part):
        own = ref[first : first + part]
        sizes = np.array([len(r) for r in own], int)
        x = _padded(code(own), int(sizes.max()), -2)
        if times is not None:
            spoken = _padded(times[0][first : first + part], int(sizes.max()), (0.0, 0.0))
        # distances less the place in the stream: so insertions cost nothing, and are a running least
        table = np.zeros((kinds, len(own), len(hyp), width + 1), np.int32)
        for i in range(x.shape[1] + 1):
            for r in np.flatnonzero(sizes == i):
                out[:, first + r] = table[:, r, np.arange(len(hyp)), ends] + ends
            if i == x.shape[1]:
                break
            step = np.empty((kinds, len(own), len(hyp), width), np.int32)
            step[0] = (x[:, i, None, None] != y).astype(np.int32) - 1
            if times is not None:
                near = (spoken[:, i, 0, None, None] < high) & (low < spoken[:, i, 1, None, None])
                step[1] = np.where(near, step[0], 1)
            step += table[..., :-1]
            table += 1
            np.minimum(table[..., 1:], step, out=table[..., 1:])
            np.minimum.accumulate(table, axis=-1, out=table)
    return out


def least_total(cost: np.ndarray, ref: list[list[str]], hyp: list[list[str]]) -> int:
    """Least total over one-to-one assignments of streams; one without partner costs all its words."""
    n = max(len(ref), len(hyp))
    if not n:
        return 0
    square = np.zeros((n, n), np.int64)
    square[: len(ref), : len(hyp)] = cost
    square[: len(ref), len(hyp) :] = np.array([len(r) for r in ref], int)[:, None]
    square[len(ref) :, : len(hyp)] = np.array([len(h) for h in hyp], int)
    if n <= 4:
        rows = square.tolist()
        return min(sum(rows[i][j] for i, j in enumerate(way)) for way in permutations(range(n)))
    return int(sum(square[i, j] for i, j in assignment((square.max() + 1 - square).astype(float))))


def cp_errors(ref: list[list[str]], hyp: list[list[str]]) -> int:
    """Least total distance over one-to-one assignments of speakers; a speaker without
    partner costs all its words."""
    return least_total(pair_distances(ref, hyp)[0], ref, hyp)


def orc_cells(n_ref: int, hyp: list[list[str]]) -> float:
    """Size of the search of ``orc_errors``: utterances times all positions in the streams."""
    size = float(max(n_ref, 1))
    for h in hyp:
        size *= len(h) + 1
    return size


def orc_errors(
    ref: list[list[str]], hyp: list[list[str]], allowed: list[list[np.ndarray]] | None = None, most: float = MOST_CELLS,
) -> int | None:
    """Least total distance if each reference utterance, in order, may go to any hypothesis
    stream; None where the search is over ``most`` cells. ``allowed[u][k][i, j]`` says whether
    word i of utterance u and word j of stream k may be aligned."""
    cells = orc_cells(len(ref), hyp)
    if cells > most:
        return None
    if not hyp:
        return sum(map(len, ref))
    codes: dict[str, int] = {}
    code = lambda words: np.array([codes.setdefault(x, len(codes)) for x in words], np.int64)
    streams = [code(h) for h in hyp]
    if cells > TABLE_CELLS:
        return by_stream.least_errors([code(u) for u in ref], streams, allowed)
    # Distances less the places in all streams: insertions cost nothing and are a running least
    # along an axis. The table never grows along any axis, and neither a word nor the least of
    # two such tables changes that, so words between utterances need no step of their own.
    kind = np.int16 if sum(map(len, ref)) + sum(map(len, hyp)) < 1 << 14 else np.int32
    best = np.zeros(tuple(len(h) + 1 for h in hyp), kind)
    for u, words in enumerate(ref):
        spoken = code(words)
        found = None
        for axis, stream in enumerate(streams):
            turned = np.moveaxis(best, axis, 0)
            own = np.ascontiguousarray(turned).reshape(len(stream) + 1, -1)
            for i, word in enumerate(spoken):
                step = (stream != word).astype(kind) - kind(1)
                if allowed is not None:
                    step = np.where(allowed[u][axis][i], step, kind(1))
                new = own + kind(1)
                np.minimum(new[1:], own[:-1] + step[:, None], out=new[1:])
                running_least(new)
                own = new
            own = np.moveaxis(own.reshape(turned.shape), 0, axis)
            found = own if found is None else np.minimum(found, own)
        best = found
    return int(best[tuple(-1 for _ in hyp)]) + sum(map(len, hyp))


def word_times(start: float, end: float, words: list[str]) -> list[tuple[float, float]]:
    """Spans of words by their lengths in characters."""
    total = sum(map(len, words)) or 1
    out, at = [], start
    for w in words:
        stop = at + (end - start) * len(w) / total
        out.append((at, stop))
        at = stop
    return out


def within_collar(ref: list[tuple[float, float]], hyp: list[tuple[float, float]], collar: float) -> np.ndarray:
    """Which words may be aligned: spans that overlap when the hypothesis is widened."""
    r, h = np.array(ref, float).reshape(-1, 2), np.array(hyp, float).reshape(-1, 2)
    return (r[:, None, 0] < h[None, :, 1] + collar) & (h[None, :, 0] - collar < r[:, None, 1])


_RESULT = T.StructType(
    [T.StructField("errors", T.LongType()), T.StructField("ref_words", T.LongType()), T.StructField("hyp_words", T.LongType())]
)


@F.pandas_udf(_RESULT)
def _cp(refs: pd.Series, hyps: pd.Series) -> pd.DataFrame:
    lists = lambda own: [list(x) for x in own] if own is not None else []
    rows = []
    for r, h in zip(refs, hyps):
        r, h = lists(r), lists(h)
        rows.append((cp_errors(r, h), sum(map(len, r)), sum(map(len, h))))
    return pd.DataFrame(rows, columns=_RESULT.names)


def cp_wer(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """Per session (columns session, speaker, ordinal, words on either side): errors, words
    and ``cp_wer`` (null without reference words). Speakers' words are joined in order; a
    session on one side only is scored against nothing. A session must fit in memory."""

    def streams(df: DataFrame, name: str) -> DataFrame:
        own = df.groupBy("session", "speaker").agg(
            F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "words"))), lambda x: x["words"])).alias("w")
        )
        return own.groupBy("session").agg(F.transform(F.sort_array(F.collect_list(F.struct("speaker", "w"))), lambda x: x["w"]).alias(name))

    rows = streams(ref, "r").join(streams(hyp, "h"), "session", "full")
    rows = rows.select("session", _cp("r", "h").alias("x")).select("session", "x.*")
    return rows.withColumn("cp_wer", F.round(F.try_divide(F.col("errors").cast("double"), F.col("ref_words").cast("double")), 6))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("ref", T.StringType()), T.StructField("hyp", T.StringType())])))
def aligned_pairs(refs: pd.Series, hyps: pd.Series) -> pd.Series:
    """Token pairs by longest matching blocks; a side without partner is null."""
    out = []
    for r, h in zip(refs, hyps):
        r, h = list(r) if r is not None else [], list(h) if h is not None else []
        pairs = []
        for tag, a, b, c, d in SequenceMatcher(None, r, h, autojunk=False).get_opcodes():
            for k in range(max(b - a, d - c)):
                pairs.append({"ref": r[a + k] if a + k < b else None, "hyp": h[c + k] if c + k < d else None})
        out.append(pairs)
    return pd.Series(out)


def ngrams(tokens: Column, n: int) -> Column:
    last = F.size(tokens) - n
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(tokens, i + 1, F.lit(n)), " ")),
    ).otherwise(F.array().cast("array<string>"))


Segment = tuple[float, float, list[str]]


def tcp_errors(ref: list[list[Segment]], hyp: list[list[Segment]], collar: float = 5.0) -> int:
    """Time-constrained ``cp_errors``: streams of segments (start, end, words) in order of their
    starts; words are timed by their length, and only words within the collar may be aligned."""

    def timed(stream: list[Segment]) -> tuple[list[str], list[tuple[float, float]]]:
        own = sorted(stream, key=lambda s: s[:2])
        return [w for s in own for w in s[2]], [t for s in own for t in word_times(*s)]

    a, b = [timed(s) for s in ref], [timed(s) for s in hyp]
    words = [x for x, _ in a], [y for y, _ in b]
    return least_total(pair_distances(*words, ([x for _, x in a], [y for _, y in b]), collar)[1], *words)


def tcorc_errors(ref: list[Segment], hyp: list[list[Segment]], collar: float = 5.0, most: float = MOST_CELLS) -> int | None:
    """Time-constrained ``orc_errors``: reference segments in order of their starts go to any
    stream of hypothesis segments, and only words within the collar may be aligned."""
    ordered = sorted(ref, key=lambda s: s[:2])
    streams = [sorted(s, key=lambda x: x[:2]) for s in hyp]
    words = [[w for s in own for w in s[2]] for own in streams]
    if orc_cells(len(ordered), words) > most:
        return None
    times = [[t for s in own for t in word_times(*s)] for own in streams]
    near = [within_collar([t for s in ordered for t in word_times(*s)], t, collar) for t in times]
    ends = np.cumsum([0, *(len(s[2]) for s in ordered)])
    allowed = [[n[i:j] for n in near] for i, j in zip(ends, ends[1:])]
    return orc_errors([s[2] for s in ordered], words, allowed, most)


def confusion_cost(speaker_aware: Column, speaker_free: Column) -> Column:
    """What wrong speakers cost: the difference of two error counts on the same pair."""
    return speaker_aware - speaker_free


def slice_outcome(ref_words: Column, hyp_words: Column, cells: Column, most: float = MOST_CELLS) -> Column:
    """How a slice is scored, first that holds: ``no_reference`` (null score), ``no_hypothesis``
    (1.0), ``refused`` (the search is too large) or ``scored``."""
    return F.when(ref_words == 0, "no_reference").when(hyp_words == 0, "no_hypothesis").when(cells > most, "refused").otherwise("scored")


_ERRORS = T.StructType([T.StructField(n, T.LongType()) for n in ("ref_words", "hyp_words", "cp", "orc", "tcp", "tcorc")] + [T.StructField("cells", T.DoubleType())])


def _session_errors(collar: float, most: float):
    def streams(segments) -> dict:
        out: dict = {}
        for s in segments if segments is not None else []:
            out.setdefault(s["speaker"], []).append((s["start_s"], s["end_s"], list(s["words"])))
        return out

    def ordered(segments) -> list:
        return sorted(
            ((s["start_s"], s["end_s"], list(s["words"])) for s in segments if len(s["words"])), key=lambda s: s[:2],
        ) if segments is not None else []

    @F.pandas_udf(_ERRORS)
    def errors(refs: pd.Series, hyps: pd.Series) -> pd.DataFrame:
        rows = []
        for r, h in zip(refs, hyps):
            a, b = ([sorted(own, key=lambda s: s[:2]) for own in streams(x).values()] for x in (r, h))
            own, other = ([[w for s in stream for w in s[2]] for stream in x] for x in (a, b))
            turns = ordered(r)
            n, m, cells = sum(map(len, own)), sum(map(len, other)), orc_cells(len(turns), other)
            if not n or not m:
                rows.append((n, m, n + m, n + m, n + m, n + m, cells))
                continue
            times = tuple([[t for s in stream for t in word_times(*s)] for stream in x] for x in (a, b))
            cp, tcp = (least_total(cost, own, other) for cost in pair_distances(own, other, times, collar))
            rows.append(
                (
                    n, m, cp, orc_errors([t[2] for t in turns], other, None, most), tcp,
                    tcorc_errors(turns, b, collar, most), cells,
                )
            )
        return pd.DataFrame(rows, columns=_ERRORS.names).astype({n: "Int64" for n in _ERRORS.names[:-1]})

    return errors


def session_scores(ref: DataFrame, hyp: DataFrame, collar: float = 5.0, most: float = math.inf) -> DataFrame:
    """Four error counts of each session (columns session, speaker, start_s, end_s, words on
    either side): ``cp`` (speakers assigned one to one), ``orc`` (utterances to any stream),
    ``tcp`` and ``tcorc`` (the same within a collar of seconds), with words, ``outcome`` (see
    slice_outcome), rates and confusion costs.

    Null without reference words. Every session is counted whole, whatever its size; only if
    ``most`` is given, what needs a search over so many cells is null. Segments of the same times are in the order of a column ``ordinal``, if there is
    one, then of speakers and words. Null speakers are a speaker; a session on one side is scored against nothing. A
    session's segments must fit in one task."""

    def side(df: DataFrame, name: str) -> DataFrame:
        place = F.col("ordinal") if "ordinal" in df.columns else F.lit(0)
        item = F.struct("start_s", "end_s", place.alias("ordinal"), "speaker", "words")
        return df.groupBy("session").agg(F.sort_array(F.collect_list(item)).alias(name))

    rows = side(ref, "_r").join(side(hyp, "_h"), "session", "full").select(
        "session", _session_errors(collar, most)("_r", "_h").alias("x"),
    ).select("session", "x.*")
    rows = rows.withColumn("outcome", slice_outcome(F.col("ref_words"), F.col("hyp_words"), F.col("cells"), most)).drop("cells")
    rate = lambda c: F.round(F.try_divide(c.cast("double"), F.col("ref_words").cast("double")), 6)
    for name in ("cp", "orc", "tcp", "tcorc"):
        rows = rows.withColumn(f"{name}_wer", rate(F.col(name)))
    return rows.withColumn("confusion", rate(confusion_cost(F.col("tcp"), F.col("tcorc")))).withColumn(
        "confusion_free", rate(confusion_cost(F.col("cp"), F.col("orc"))),
    )
