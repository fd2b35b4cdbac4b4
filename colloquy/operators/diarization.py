"""Diarization scores from reference and hypothesis segments.

Speakers' segments become disjoint periods first. Counts of active speakers come from a
sweep: +1 at each start, -1 at each end, summed along time within tiles of 2**17 ms; what
a tile begins with, and where the next event after it is, comes from one row a tile. No set
of speakers is ever built, no period is blown up, however long, and a long or crowded
meeting is many tiles. Events are sorted, not gathered by moment: a sort spills, a table of
all moments of a crowded tile has to be held.
"""

from __future__ import annotations

import mmap
import os
import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, stored_table
from .overlaps import overlap_join
from .periods import speaking_periods

TILE_MS = 1 << 17
#: Shared times: periods and speakers of a block, least width of a tile, tiles of a meeting.
BLOCK_PERIODS, BLOCK_SPEAKERS = 1 << 16, 512
SHARE_MS, MOST_TILES = 1 << 22, 64
#: Shared times that a worker gathers before it hands them on, and those of one block more.
SHARED_CELLS = 1 << 18
#: Mapping: bytes of shared times in a worker's memory, rows that bid, bids a row and raise.
HELD_BYTES, LEAST_BIDDERS, MOST_BIDS = 1 << 24, 32, 32


def side_periods(segments: DataFrame) -> DataFrame:
    """meeting_id, side, speaker, s, e: disjoint periods in milliseconds."""
    return speaking_periods(segments).where("kind = 'period'").select(
        "meeting_id", "side", "speaker", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"),
    )


def numbered_speakers(periods: DataFrame) -> DataFrame:
    """meeting_id, side, speaker, ``no`` from 0 in the order of names, and ``block``: the speakers
    of a side in parts of about BLOCK_PERIODS periods, at most BLOCK_SPEAKERS speakers each.
    Meetings without an id have no speakers to compare."""
    counts = periods.where("meeting_id is not null").groupBy("meeting_id", "side", "speaker").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("meeting_id", "side").orderBy("speaker")
    weight = F.greatest("n", F.lit(BLOCK_PERIODS // BLOCK_SPEAKERS))
    before = F.coalesce(F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select(
        "meeting_id", "side", "speaker", (F.row_number().over(order) - 1).alias("no"),
        F.floor(before / BLOCK_PERIODS).cast("int").alias("block"),
    )


def shared_times(no: np.ndarray, s: np.ndarray, e: np.ndarray, no2: np.ndarray, s2: np.ndarray, e2: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each speaker of one side (number, starts and ends of disjoint periods) the speakers of
    the other it shares time with, and the times.

    What a speaker has said until a moment grows by one within periods, so a period of the
    other side shares what was added between its bounds: no pair of periods is formed."""
    if not len(no) or not len(no2):
        return
    order, order2 = np.lexsort((s, no)), np.lexsort((s2, no2))
    no, s, e = no[order], s[order], e[order]
    no2, s2, e2 = no2[order2], s2[order2], e2[order2]
    at, at2 = np.flatnonzero(np.append(True, no[1:] != no[:-1])), np.flatnonzero(np.append(True, no2[1:] != no2[:-1]))
    others = no2[at2]
    origin = min(s[0], s.min(), s2.min())  # exact below 2**53 milliseconds of span
    low, high = (s2 - origin).astype(float), (e2 - origin).astype(float)
    for i, j in zip(at, np.append(at[1:], len(no))):
        bounds = np.empty(2 * (j - i))
        bounds[::2], bounds[1::2] = s[i:j] - origin, e[i:j] - origin
        said = np.zeros_like(bounds)
        said[1::2] = np.cumsum(bounds[1::2] - bounds[::2])
        said[2::2] = said[1:-1:2]
        ms = np.add.reduceat(np.interp(high, bounds, said) - np.interp(low, bounds, said), at2).astype(np.int64)
        some = np.flatnonzero(ms)
        if len(some):
            yield int(no[i]), others[some], ms[some]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks (meeting_id and lists _r and _h) to rows of ``shared_rows``. What is found
    is handed on pair by pair, small ones together, and never held for a batch."""

    def columns(lists: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
        flat = lists.flatten()
        return lists.offsets.to_numpy() - lists.offsets[0].as_py(), [flat.field(n).to_numpy(zero_copy_only=False) for n in ("no", "s", "e")]

    meetings, numbers, cells, hs, times = [], [], [0], [], []

    def made() -> pa.RecordBatch:
        joined = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.empty(0), kind)
        lists = lambda parts, kind: pa.ListArray.from_arrays(pa.array(cells, pa.int32()), joined(parts, kind))
        fields = [pa.array(meetings, pa.string()), pa.array(numbers, pa.int32()), lists(hs, pa.int32()), lists(times, pa.int64())]
        for x in (meetings, numbers, hs, times):
            x.clear()
        cells[:] = [0]
        return pa.RecordBatch.from_arrays(fields, ["meeting_id", "r", "h", "ms"])

    for batch in batches:
        if not len(batch):
            continue
        (a, left), (b, right) = columns(batch.column("_r")), columns(batch.column("_h"))
        for i, meeting in enumerate(batch.column("meeting_id").to_pylist()):
            for r, h, ms in shared_times(*[x[a[i] : a[i + 1]] for x in left], *[x[b[i] : b[i + 1]] for x in right]):
                meetings.append(meeting)
                numbers.append(r)
                hs.append(h)
                times.append(ms)
                cells.append(cells[-1] + len(h))
            if cells[-1] >= SHARED_CELLS:
                yield made()
    yield made()


def shared_rows(periods: DataFrame, numbered: DataFrame) -> DataFrame:
    """Times that speakers share: meeting_id, r, and arrays h and ms. A row holds part of what
    a reference speaker shares: that with one block of speakers in one tile of time.

    A task's group is two blocks of a meeting in a tile, so a meeting of thousands of speakers
    is many tasks. Tiles are at least SHARE_MS wide, and so wide that a meeting has about
    MOST_TILES of them: a very long period is that many rows at most."""
    limits = periods.where("meeting_id is not null").groupBy("meeting_id").agg(F.min("s").alias("_low"), F.max("e").alias("_high"))
    blocks = numbered.groupBy("meeting_id").pivot("side", ["ref", "hyp"]).agg(F.max("block"))
    span = F.greatest((F.col("_high") - F.col("_low")) / F.lit(float(SHARE_MS * MOST_TILES)), F.lit(1.0))
    width = (F.lit(SHARE_MS) * F.pow(F.lit(2.0), F.ceil(F.log2(span)))).cast("long")
    meetings = limits.join(blocks.where("ref is not null and hyp is not null"), "meeting_id").select("meeting_id", width.alias("_w"), F.col("ref").alias("_ref"), F.col("hyp").alias("_hyp"))
    rows = periods.join(numbered, ["meeting_id", "side", "speaker"]).join(meetings, "meeting_id")
    w = F.col("_w")
    tile = F.explode(F.sequence(F.floor(F.col("s") / w), F.floor((F.col("e") - 1) / w)))
    rows = rows.select("meeting_id", "side", "no", "block", "s", "e", "_w", "_ref", "_hyp", tile.alias("tile"))
    item = F.struct("no", F.greatest(F.col("s"), F.col("tile") * w).alias("s"), F.least(F.col("e"), (F.col("tile") + 1) * w).alias("e"))
    parts = rows.groupBy("meeting_id", "side", "block", "tile").agg(F.collect_list(item).alias("own"), F.first("_ref").alias("_ref"), F.first("_hyp").alias("_hyp"))

    def side(name: str, other: str, own: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col(f"_{other}"))).alias(f"_b{other}")
        return parts.where(F.col("side") == name).select("meeting_id", "tile", F.col("block").alias(f"_b{name}"), every, F.col("own").alias(own))

    both = side("ref", "hyp", "_r").join(side("hyp", "ref", "_h"), ["meeting_id", "tile", "_bref", "_bhyp"])
    return both.select("meeting_id", "_r", "_h").mapInArrow(_shared, "meeting_id string, r int, h array<int>, ms array<bigint>")


def _names(numbered: DataFrame, side: str, number: str, name: str) -> DataFrame:
    return numbered.where(F.col("side") == side).select("meeting_id", F.col("no").alias(number), F.col("speaker").alias(name))


def shared(periods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``numbered_speakers`` and ``shared_rows``."""
    numbered = cut_lineage(numbered_speakers(periods))
    return numbered, shared_rows(periods, numbered)


def speaker_overlap(periods: DataFrame, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Milliseconds that each reference and hypothesis speaker of a meeting share. ``known``:
    what ``shared`` gives, if it is there."""
    numbered, rows = known or shared(periods)
    cells = rows.select("meeting_id", "r", F.inline(F.arrays_zip("h", "ms")))
    cells = cells.groupBy("meeting_id", "r", "h").agg(F.sum("ms").alias("ms"))
    named = cells.join(_names(numbered, "ref", "r", "ref_speaker"), ["meeting_id", "r"]).join(_names(numbered, "hyp", "h", "hyp_speaker"), ["meeting_id", "h"])
    return named.select("meeting_id", "ref_speaker", "hyp_speaker", "ms")


def _assigned(load: Callable[[int, np.ndarray], None], n: int, largest: float) -> np.ndarray:
    """The column of each row in an assignment of largest total weight, n rows to n columns.
    ``load`` writes a row into an array, so only prices of rows and columns are held.

    Rows, if many, bid for columns with a raise that falls to 1 (an auction); that gives prices
    near the best ones. Rows whose column isn't exactly their best at these prices are assigned anew
    along shortest augmenting paths, which makes the result exact. Bids are bounded, as the
    paths lead to the end from any prices."""
    row, v, owner = np.empty(n), np.zeros(n), np.full(n, -1)
    raises = [1.0] if n >= LEAST_BIDDERS else []
    while raises and raises[-1] * 32 <= largest:
        raises.append(raises[-1] * 8)
    for raise_ in reversed(raises):
        owner, free, bids = np.full(n, -1), list(range(n)), 0
        while free and bids < MOST_BIDS * n:
            i = free.pop()
            load(i, row)
            np.subtract(row, v, out=row)
            j, bids = int(row.argmax()), bids + 1
            best, row[j] = row[j], -np.inf
            v[j] += best - row.max() + raise_
            if owner[j] >= 0:
                free.append(int(owner[j]))
            owner[j] = i
    u, column = np.zeros(n), np.full(n, -1)
    column[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    free = []  # what is not exactly best
    for i in range(n):
        load(i, row)
        np.subtract(row, v, out=row)
        u[i] = row.max()
        if column[i] >= 0 and row[column[i]] < u[i]:
            owner[column[i]] = column[i] = -1
        if column[i] < 0:
            free.append(i)
    least, way, slack, better = np.empty(n), np.empty(n, int), np.empty(n), np.empty(n, bool)
    for first in free:
        least.fill(np.inf)
        left, passed, at = v.copy(), [], []
        i, low = first, 0.0
        while True:
            load(i, row)
            np.subtract(left, row, out=slack)
            slack += low + u[i]
            np.less(slack, least, out=better)
            np.copyto(least, slack, where=better)
            way[better] = i
            j = int(least.argmin())
            low = least[j]
            if owner[j] < 0:
                break
            passed.append(j)
            at.append(low)
            left[j] = least[j] = np.inf
            i = int(owner[j])
        u[first] -= low
        if passed:
            u[owner[passed]] -= low - np.array(at)
            v[passed] += low - np.array(at)
        i = -1
        while i != first:
            i = int(way[j])
            owner[j] = i
            j, column[i] = int(column[i]), j
    return column


def _pairs(rows: Sequence[np.ndarray], width: int) -> list[tuple[int, int]]:
    """``assignment`` of rows that may end early; what is missing has no weight."""
    n = max(len(rows), width) if len(rows) and width else 0
    if not n:
        return []

    def load(i: int, out: np.ndarray) -> None:
        size = len(rows[i]) if i < len(rows) else 0
        if size:
            out[:size] = rows[i]
        out[size:] = 0

    column = _assigned(load, n, max(float(x.max()) for x in rows if len(x)))
    return [(i, int(j)) for i, (x, j) in enumerate(zip(rows, column)) if j < len(x) and x[j] > 0]


def assignment(weights: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of the largest total weight, each row and column at most once.
    Pairs of no weight are left out."""
    return _pairs(weights, weights.shape[1])


class _Times:
    """Times that the speakers of one meeting share, a row a reference speaker. Beyond
    HELD_BYTES rows are in files of the worker's scratch folder, mapped and not read in."""

    def __init__(self) -> None:
        self.numbers: list[int] = []
        self.rows: list[np.ndarray] = []
        self.width = self.held = self.stored = 0
        self.own = np.zeros(0, np.int64)

    def add(self, number: int, h: np.ndarray, ms: np.ndarray) -> None:
        """Part of the times of a speaker; those of a speaker follow each other."""
        if not self.numbers or self.numbers[-1] != number:
            self._end()
            self.numbers.append(number)
        most = int(h.max()) + 1
        if most > len(self.own):
            self.own = np.append(self.own, np.zeros(max(most, 2 * len(self.own)) - len(self.own), np.int64))
        self.own[h] += ms
        self.width = max(self.width, most)

    def _end(self) -> None:
        if len(self.rows) == len(self.numbers):
            return
        own = self.own[: self.width]
        self.rows.append(own.astype(np.uint32 if own.max() < 1 << 32 else np.int64))
        self.own[:] = 0
        self.held += self.rows[-1].nbytes
        if self.held > HELD_BYTES:
            self._store()

    def _store(self) -> None:
        with tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as f:
            for x in self.rows[self.stored :]:
                f.write(x.data)
            f.flush()
            mapped, at = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), 0
        for k in range(self.stored, len(self.rows)):
            x = self.rows[k]
            self.rows[k] = np.frombuffer(mapped, x.dtype, len(x), at)
            at += x.nbytes
        self.stored, self.held = len(self.rows), 0

    def mapping(self) -> list[tuple[int, int]]:
        self._end()
        return [(self.numbers[i], j) for i, j in _pairs(self.rows, self.width)]


def _mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``shared_rows`` in the order of meetings and reference speakers to meeting_id, r and h."""
    now, times = None, _Times()
    out: tuple[list, list, list] = ([], [], [])

    def close() -> None:
        for i, j in times.mapping():
            for x, value in zip(out, (now, i, j)):
                x.append(value)

    def made() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], ["meeting_id", "r", "h"])
        for x in out:
            x.clear()
        return batch

    for batch in batches:
        lists = [batch.column(n) for n in ("h", "ms")]
        starts = lists[0].offsets.to_numpy()
        h, ms = (x.values.to_numpy(zero_copy_only=False) for x in lists)
        shift = lists[1].offsets[0].as_py() - starts[0] if len(batch) else 0
        for k, (meeting, r) in enumerate(zip(batch.column("meeting_id").to_pylist(), batch.column("r").to_pylist())):
            if meeting != now:
                close()
                now, times = meeting, _Times()
            times.add(r, h[starts[k] : starts[k + 1]], ms[starts[k] + shift : starts[k + 1] + shift])
        yield made()
    close()
    yield made()


def speaker_mapping(periods: DataFrame, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One-to-one speaker mapping of the largest shared time per meeting: meeting_id,
    ref_speaker, hyp_speaker. Speakers are matched on whole segments whatever is scored.

    Meetings pass through a task one after the other, a reference speaker at a time, as rows
    of numbers; it holds a bounded part of the times that the speakers of one meeting share,
    and neither names nor segments."""
    numbered, rows = known or shared(periods)
    pairs = rows.repartition("meeting_id").sortWithinPartitions("meeting_id", "r").mapInArrow(_mapped, "meeting_id string, r int, h int")
    named = pairs.join(_names(numbered, "ref", "r", "ref_speaker"), ["meeting_id", "r"]).join(_names(numbered, "hyp", "h", "hyp_speaker"), ["meeting_id", "h"])
    return named.select("meeting_id", "ref_speaker", "hyp_speaker")


def matched_spans(periods: DataFrame, mapping: DataFrame) -> DataFrame:
    """Spans in which a mapped pair speaks on both sides: meeting_id, ref_speaker, s, e."""
    ref = periods.where("side = 'ref'").select(
        "meeting_id", F.col("speaker").alias("ref_speaker"), "s", "e",
    ).join(mapping, ["meeting_id", "ref_speaker"])
    hyp = periods.where("side = 'hyp'").select("meeting_id", F.col("speaker").alias("_h"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    both = overlap_join(ref, hyp, "meeting_id").where(F.col("hyp_speaker") == F.col("_h"))
    return both.select("meeting_id", "ref_speaker", F.greatest("s", "s2").alias("s"), F.least("e", "e2").alias("e"))


def _changes(spans: DataFrame) -> DataFrame:
    """What spans (meeting_id, kind, s, e) open and close: meeting_id, tile, at, and by how much
    the counts change, packed: ref and hyp in ``sides``, match and collar in ``marks``."""
    unit = lambda high, low: F.when(F.col("kind") == high, F.lit(1 << 32)).when(F.col("kind") == low, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    sides, marks = unit("ref", "hyp"), unit("match", "collar")
    end = lambda at, way: F.struct(F.col(at).alias("at"), (way * sides).alias("sides"), (way * marks).alias("marks"))
    rows = spans.select("meeting_id", F.inline(F.array(end("s", 1), end("e", -1))))
    return rows.select("meeting_id", F.floor(F.col("at") / TILE_MS).cast("long").alias("tile"), "at", "sides", "marks")


def elementary(periods: DataFrame, matched: DataFrame | None = None, collar_ms: int = 0) -> DataFrame:
    """Elementary intervals of each meeting: ms, n_ref and n_hyp speakers active, n_match
    matched pairs active, and n_collar collars of reference boundaries (collars of one period
    that meet are one).

    Events of one moment stay rows of their own: time passes after the last of them only."""
    spans = periods.where("side in ('ref', 'hyp')").select("meeting_id", F.col("side").alias("kind"), "s", "e")
    if matched is not None:
        spans = spans.unionByName(matched.select("meeting_id", F.lit("match").alias("kind"), "s", "e"))
    spans = stored_table(spans.where("s < e"), "spans")  # read for the tiles and for what is in them
    if collar_ms:
        near = lambda low, high: F.struct((F.col(low) - collar_ms).alias("s"), (F.col(high) + collar_ms).alias("e"))
        apart = F.col("e") - F.col("s") > 2 * collar_ms
        collars = F.inline(F.when(apart, F.array(near("s", "s"), near("e", "e"))).otherwise(F.array(near("s", "e"))))
        spans = spans.unionByName(spans.where("kind = 'ref'").select("meeting_id", F.lit("collar").alias("kind"), collars))
    changes = _changes(spans)
    # one row a tile with events: what is open at its start, and the first event after it
    tiles = changes.groupBy("meeting_id", "tile").agg(F.min("at").alias("_first"), F.sum("sides").alias("_sides"), F.sum("marks").alias("_marks"))
    along = Window.partitionBy("meeting_id").orderBy("tile")
    before = lambda c: F.coalesce(F.sum(c).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    tiles = tiles.select(
        "meeting_id", "tile", "_first", F.lead("_first").over(along).alias("_then"), before("_sides").alias("_sides"), before("_marks").alias("_marks"),
    )
    none = F.lit(0).cast("long")
    bounds = F.array(
        F.struct(F.col("_first").alias("at"), F.col("_sides").alias("sides"), F.col("_marks").alias("marks")),
        F.struct(F.col("_then").alias("at"), none.alias("sides"), none.alias("marks")),
    )
    rows = changes.unionByName(tiles.select("meeting_id", "tile", F.inline(bounds)).where("at is not null"))
    order = Window.partitionBy("meeting_id", "tile").orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    ms = F.lead("at").over(order) - F.col("at")
    steps = rows.select("meeting_id", ms.alias("ms"), F.sum("sides").over(upto).alias("sides"), F.sum("marks").over(upto).alias("marks")).where("ms > 0")
    high, low = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1)))
    steps = steps.select(
        "meeting_id", "ms", high("sides").alias("n_ref"), low("sides").alias("n_hyp"), high("marks").alias("n_match"), low("marks").alias("n_collar"),
    )
    return steps.where("n_ref > 0 or n_hyp > 0")


def error_times(elements: DataFrame, skip_overlap: bool = False, keys: tuple[str, ...] = ("meeting_id",)) -> DataFrame:
    """Milliseconds of reference speech, missed, false alarm, confusion and correct."""
    scored = elements.where("n_collar = 0")
    if skip_overlap:
        scored = scored.where("n_ref <= 1")
    r, h, m, ms = (F.col(c) for c in ("n_ref", "n_hyp", "n_match", "ms"))
    total = lambda x: F.coalesce(F.sum(x * ms), F.lit(0))
    return scored.groupBy(*keys).agg(
        total(r).alias("total_ms"), total(F.greatest(r - h, F.lit(0))).alias("missed_ms"),
        total(F.greatest(h - r, F.lit(0))).alias("false_alarm_ms"),
        total(F.least(r, h) - m).alias("confusion_ms"), total(m).alias("correct_ms"),
    )


def error_rate(missed: Column, false_alarm: Column, confusion: Column, total: Column) -> Column:
    """0.0 where there is no reference speech."""
    return F.round(F.coalesce(F.try_divide((missed + false_alarm + confusion).cast("double"), total.cast("double")), F.lit(0.0)), 6)


def meeting_scores(
    segments: DataFrame, conventions: tuple[tuple[str, int, bool], ...] = (("full", 0, False), ("forgiving", 250, True)),
) -> DataFrame:
    """Per meeting and convention (name, collar, overlap skipped): times and ``der``.

    Conventions with a collar share one; all are summed over the same elementary intervals
    in one pass. A meeting has a row for each convention, of zeros where nothing is scored."""
    collars = {c for _, c, _ in conventions if c}
    if len(collars) > 1:
        raise ValueError("conventions with different collars need a sweep each")
    periods = stored_table(side_periods(segments), "periods")  # read for the mapping and for the sweep
    matched = matched_spans(periods, cut_lineage(speaker_mapping(periods)))
    elements = elementary(periods, matched, max(collars, default=0))
    r, h, m, ms = (F.col(c) for c in ("n_ref", "n_hyp", "n_match", "ms"))
    kinds = {
        "total_ms": r, "missed_ms": F.greatest(r - h, F.lit(0)), "false_alarm_ms": F.greatest(h - r, F.lit(0)),
        "confusion_ms": F.least(r, h) - m, "correct_ms": m,
    }
    sums, cells = [], []
    for name, collar, skip in conventions:
        scored = (F.col("n_collar") == 0 if collar else F.lit(True)) & (r <= 1 if skip else F.lit(True))
        sums += [F.coalesce(F.sum(F.when(scored, x * ms)), F.lit(0)).alias(f"{name}_{k}") for k, x in kinds.items()]
        cells.append(F.struct(F.lit(name).alias("convention"), *[F.col(f"{name}_{k}").alias(k) for k in kinds]))
    rows = elements.groupBy("meeting_id").agg(*sums).select("meeting_id", F.inline(F.array(*cells)))
    return rows.withColumn("der", error_rate(F.col("missed_ms"), F.col("false_alarm_ms"), F.col("confusion_ms"), F.col("total_ms")))


def pooled(scores: DataFrame) -> DataFrame:
    """Times summed over meetings, the rate after the sum, one row a convention."""
    names = ("total_ms", "missed_ms", "false_alarm_ms", "confusion_ms", "correct_ms")
    rows = scores.groupBy("convention").agg(F.count(F.lit(1)).alias("meetings"), *[F.sum(n).alias(n) for n in names])
    return rows.withColumn("der", error_rate(F.col("missed_ms"), F.col("false_alarm_ms"), F.col("confusion_ms"), F.col("total_ms")))


def jaccard_errors(segments: DataFrame) -> DataFrame:
    """Per meeting the unweighted mean over reference speakers of one minus the Jaccard index
    with the mapped speaker; 1.0 for an unmapped one."""
    periods = stored_table(side_periods(segments), "periods")
    numbered, rows = shared(periods)
    known = numbered, stored_table(rows, "shared")  # read for the mapping and for the times
    overlap, mapping = speaker_overlap(periods, known), speaker_mapping(periods, known)
    length = periods.groupBy("meeting_id", "side", "speaker").agg(F.sum(F.col("e") - F.col("s")).alias("ms"))
    ref = length.where("side = 'ref'").select("meeting_id", F.col("speaker").alias("ref_speaker"), F.col("ms").alias("r_ms"))
    hyp = length.where("side = 'hyp'").select("meeting_id", F.col("speaker").alias("hyp_speaker"), F.col("ms").alias("h_ms"))
    rows = ref.join(mapping, ["meeting_id", "ref_speaker"], "left").join(hyp, ["meeting_id", "hyp_speaker"], "left").join(
        overlap, ["meeting_id", "ref_speaker", "hyp_speaker"], "left",
    )
    union = F.col("r_ms") + F.col("h_ms") - F.col("ms")
    error = F.when(F.col("hyp_speaker").isNull(), F.lit(1.0)).when(union <= 0, F.lit(0.0)).otherwise(1 - F.col("ms") / union)
    return rows.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("speakers"), F.round(F.avg(error), 6).alias("jer"))
