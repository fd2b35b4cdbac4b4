"""Least word errors where utterances go to streams: exact, without a table over all streams.

A table over the positions in all streams grows with the product of their lengths. Here each stream
has a table of its own: a price of each utterance is what a stream is paid for taking it, and what
the streams do best by themselves at these prices bounds the total from below. Prices are raised
where no stream wants an utterance and lowered where several do. What is left between the bound and
the best total found is searched over assignments; only those that can not be better are left out.
"""

from __future__ import annotations

import numpy as np

#: Part of an error in which prices are counted.
ONE = 16
#: Bytes of the tables of moves that are held; beyond it they are made for each use. What a search
#: holds is about as much at most.
MOVE_BYTES = 1 << 26
#: Places of a word in a stream beyond which they are taken together.
OFTEN = 16
#: Assignments that are looked at together, in a first look and in the whole search.
FEW, MANY = 24, 512


Step = tuple[list[int], int, np.ndarray | None]


def steps(words: np.ndarray, stream: np.ndarray, near: np.ndarray | None) -> list[Step]:
    """For each word: the places in the stream where it is itself and may be aligned; the first
    place where it may be aligned, and from there on the last such place (None: every place)."""
    out, own = [], {}
    for place, word in enumerate(stream.tolist()):
        own.setdefault(word, []).append(place)
    places = np.arange(len(stream))
    for i, word in enumerate(words.tolist()):
        same = own.get(word, [])
        if near is None or near[i].all():
            out.append((same, 0, None))
            continue
        first = int(near[i].argmax()) if near[i].any() else len(stream)
        last = np.maximum.accumulate(np.where(near[i], places, 0)[first:])
        out.append(([at for at in same if near[i][at]], first, last))
    return out


def moved(table: np.ndarray, word_steps: list[Step], none: int) -> np.ndarray:
    """``table`` (positions in the stream first), which holds least costs less the place, after
    the words are aligned from there. It never grows along the stream: so a word takes the last
    place it may have for another word, and a step for each place where it is itself."""
    one = table.dtype.type(ONE)
    for same, first, last in word_steps:
        new = table + one
        if last is None:
            np.minimum(new[1:], table[:-1], out=new[1:])
        elif len(last):
            np.minimum(new[first + 1 :], table[last], out=new[first + 1 :])
        if len(same) > OFTEN:
            step, width = np.full_like(new[1:], none), 1
            step[same] = table[same] - one
            while width < len(step):
                np.minimum(step[width:], step[:-width], out=step[width:])
                width *= 2
            np.minimum(new[1:], step, out=new[1:])
            same = []
        for at in same:
            part = new[at + 1 :]
            np.minimum(part, table[at] - one, out=part)
        table = new
    return np.minimum(table, table.dtype.type(none), out=table if word_steps else None)


class Streams:
    """Reference utterances and hypothesis streams as numbers; ``near[u][k][i, j]`` says whether
    word i of utterance u and word j of stream k may be aligned (None: all)."""

    def __init__(self, ref: list[np.ndarray], hyp: list[np.ndarray], near: list[list[np.ndarray]] | None) -> None:
        self.ref, self.hyp = ref, hyp
        self.words = sum(map(len, ref))
        self.kind = np.int16 if 2 * self.words * ONE < 12_000 else np.int32
        self.none = 14_000 if self.kind is np.int16 else 1 << 28
        # a price within the words of the utterance: any stream may lose all of them
        self.most = np.array([len(u) * ONE for u in ref], np.int64)
        cells = len(ref) * sum((len(h) + 1) ** 2 for h in hyp) * np.dtype(self.kind).itemsize
        self.steps = [[steps(u, h, near[t][k] if near else None) for k, h in enumerate(hyp)] for t, u in enumerate(ref)]
        self.moves = None
        if cells <= MOVE_BYTES:
            starts = [np.where(np.tri(len(h) + 1, dtype=bool), 0, self.none).astype(self.kind) for h in hyp]
            self.moves = [[self._moved(t, k, s) for k, s in enumerate(starts)] for t in range(len(ref))]
        else:
            turned = lambda t, k: near[t][k][::-1, ::-1] if near else None
            self.back = [[steps(u[::-1], h[::-1], turned(t, k)) for k, h in enumerate(hyp)] for t, u in enumerate(ref)]
        self.best = self.words  # all words lost; errors less the words of the streams
        self.prices = np.array([self._fair(t) for t in range(len(ref))], np.int64)
        self.bound, self.rest = self._bound(self.prices)

    def _moved(self, t: int, k: int, table: np.ndarray) -> np.ndarray:
        return moved(table, self.steps[t][k], self.none)

    def _before(self, t: int, k: int, after: np.ndarray) -> np.ndarray:
        """Least cost from each place if the stream takes the utterance, from that after it."""
        if self.moves:
            return (self.moves[t][k] + after[:, None]).min(0)
        return moved(after[::-1], self.back[t][k], self.none)[::-1]

    def _reached(self, t: int, k: int, place: int) -> np.ndarray:
        """Costs of the places after the utterance, taken from a place on."""
        if self.moves:
            return self.moves[t][k][:, place]
        start = np.zeros(len(self.hyp[k]) + 1, self.kind)
        start[:place] = self.none
        return self._moved(t, k, start)

    def _fair(self, t: int) -> int:
        own = sorted(int(self._reached(t, k, 0)[-1]) for k in range(len(self.hyp)))
        return sum(own[:2]) // len(own[:2])

    def _bound(self, prices: np.ndarray) -> tuple[int, list[list[np.ndarray]]]:
        """The bound at these prices, and what each stream has to pay from each utterance and place on."""
        rest = [[np.zeros(len(h) + 1, self.kind) for h in self.hyp]]
        for t in range(len(self.ref) - 1, -1, -1):
            price = self.kind(prices[t])
            rest.append([np.minimum(own, self._before(t, k, own) - price) for k, own in enumerate(rest[-1])])
        rest.reverse()
        return sum(int(own[0]) for own in rest[0]) + int(prices.sum()), rest

    def _wanted(self, prices: np.ndarray, rest: list[list[np.ndarray]]) -> np.ndarray:
        """How many streams take each utterance."""
        count, place = np.zeros(len(self.ref), np.int64), [0] * len(self.hyp)
        for t, after in enumerate(rest[1:]):
            for k, own in enumerate(after):
                if rest[t][k][place[k]] < own[place[k]]:
                    place[k] = int((self._reached(t, k, place[k]) + own).argmin())
                    count[t] += 1
        return count

    @property
    def proven(self) -> bool:
        return self.bound > (self.best - 1) * ONE

    def price(self, rounds: int, pace: float = 0.3, memory: float = 0.7, patience: int = 10) -> None:
        """Better prices: by steps along the utterances not wanted or wanted twice."""
        at, way, since = self.prices.astype(float), None, 0
        for _ in range(rounds):
            prices = np.clip(np.round(at), -self.most, self.most).astype(np.int64)
            bound, rest = self._bound(prices)
            if bound > self.bound:
                self.bound, self.rest, self.prices, since = bound, rest, prices, 0
                if self.proven:
                    return
            else:
                since += 1
                if since == patience:
                    pace, since = pace / 2, 0
                    if pace < 0.003:
                        return
            gap = 1 - self._wanted(prices, rest)
            if not gap.any():
                return
            way = gap.astype(float) if way is None else memory * way + (1 - memory) * gap
            at = at + pace * (self.best * ONE - bound) / max(float(way @ way), 0.3) * way

    def search(self, width: int, budget: float = np.inf) -> bool:
        """Goes through the assignments in order of their utterances, the ``width`` most promising
        of each kind first, and keeps the least total; True if none is left that could be better."""
        due = np.concatenate([np.cumsum(self.prices[::-1])[::-1], [0]])
        todo = [(0, np.zeros((1, len(self.hyp)), np.int64), np.zeros(1, np.int64) + self.bound, [np.zeros((1, len(h) + 1), self.kind) for h in self.hyp])]
        while todo:
            t, nodes, bounds, rows = todo.pop()
            open_ = bounds <= (self.best - 1) * ONE
            nodes, bounds = nodes[open_], bounds[open_]
            if not len(nodes):
                continue
            if budget <= 0:
                return False
            if len(nodes) > width:
                todo.append((t, nodes[width:], bounds[width:], rows))
                nodes = nodes[:width]
            budget -= len(nodes)
            left = (self.best - 1) * ONE - self.bound
            after, least, skip, take = [], [], [], []
            for k, own in enumerate(rows):
                used, place = np.unique(nodes[:, k], return_inverse=True)
                own = own[used]
                both = np.concatenate([own, self._moved(t, k, np.ascontiguousarray(own.T)).T])
                total = both + self.rest[t + 1][k]
                low = total.min(1)
                both[total - low[:, None] > left] = self.none  # places that no better total goes through
                kept: dict[bytes, int] = {}
                to = np.array([kept.setdefault(row.tobytes(), len(kept)) for row in both], np.int64)
                where = np.unique(to, return_index=True)[1]
                after.append(both[where])
                least.append(low[where].astype(np.int64))
                skip.append(to[: len(used)][place])
                take.append(to[len(used) :][place])
            new = np.concatenate([np.stack([(take if j == k else skip)[j] for j in range(len(rows))], 1) for k in range(len(rows))])
            bounds = sum(least[k][new[:, k]] for k in range(len(rows))) + due[t + 1]
            if t + 1 == len(self.ref):
                self.best = min(self.best, int(bounds.min()) // ONE)
                continue
            promising = np.flatnonzero(bounds <= (self.best - 1) * ONE)
            new, where = np.unique(new[promising], axis=0, return_index=True)
            bounds = bounds[promising][where]
            order = np.argsort(bounds, kind="stable")
            todo.append((t + 1, new[order], bounds[order], after))
        return True


def least_errors(ref: list[np.ndarray], hyp: list[np.ndarray], near: list[list[np.ndarray]] | None = None) -> int:
    """Least total word distance if each utterance, in order, may go to any of the streams."""
    words = sum(map(len, hyp))
    kept = [t for t, u in enumerate(ref) if len(u)]
    if not hyp or not kept:
        return words + sum(map(len, ref))
    own = Streams([ref[t] for t in kept], hyp, [near[t] for t in kept] if near else None)
    own.search(FEW, FEW * len(kept))
    for rounds in (30, 120):
        if own.proven:
            break
        own.price(rounds)
        own.search(FEW, FEW * len(kept))
    budget = 10_000
    row = sum(len(h) + 1 for h in hyp) * np.dtype(own.kind).itemsize
    many = max(FEW, min(MANY, MOVE_BYTES // (2 * row * len(kept))))
    while not own.proven and not own.search(many, budget):
        own.price(400)
        budget *= 8
    return own.best + words
