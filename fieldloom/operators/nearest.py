"""Nearest vectors of a stream of groups: some rows, then all those they are held against."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Pairs of a matrix product at once.
PAIRS = 1 << 21


def _plain(vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) by width, of the vectors that are not null and hold no null."""
    rows: dict[int, list[int]] = {}
    lists = vectors.to_pylist() if vectors.flatten().null_count else None
    widths = pa.compute.list_value_length(vectors).to_pylist()
    for i, n in enumerate(widths):
        if n is not None and not (lists and None in lists[i]):
            rows.setdefault(n, []).append(i)
    out = []
    for n, at in rows.items():
        flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        out.append((np.array(at), flat.reshape(len(at), n)))
    return out


class Part:
    """Rows of one group and the least squared distance of each so far."""

    def __init__(self, keys: list, vectors: pa.Array):
        self.keys, n = keys, len(keys)
        self.places: dict = {}
        for i, k in enumerate(keys):
            self.places.setdefault(k, []).append(i)
        self.met = np.zeros(n, np.int64)
        self.best, self.number, self.nan = np.full(n, np.inf), np.zeros(n, bool), np.zeros(n, bool)
        self.by_width = {m.shape[1]: (at, m) for at, m in _plain(vectors)}

    def meet(self, keys: list, vectors: pa.Array) -> None:
        same = [(i, j) for j, k in enumerate(keys) for i in self.places.get(k, ())]
        self.met += len(keys)
        np.subtract.at(self.met, [i for i, _ in same], 1)
        for cols, y in _plain(vectors):
            if y.shape[1] in self.by_width:
                at, x = self.by_width[y.shape[1]]
                row, col = {i: a for a, i in enumerate(at.tolist())}, {j: b for b, j in enumerate(cols.tolist())}
                apart = np.array([(row[i], col[j]) for i, j in same if i in row and j in col], np.int64).reshape(-1, 2)
                step = max(1, PAIRS // len(y))
                for a in range(0, len(at), step):
                    mine = apart[(apart[:, 0] >= a) & (apart[:, 0] < a + step)] - [a, 0]
                    self._near(at[a : a + step], x[a : a + step], y, mine)

    def _near(self, at: np.ndarray, x: np.ndarray, y: np.ndarray, same: np.ndarray) -> None:
        xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
        if not (np.isfinite(xx).all() and np.isfinite(yy).all()):  # by differences alone
            for a, v in enumerate(x):
                with np.errstate(all="ignore"):
                    d = ((y - v) ** 2).sum(axis=1)
                d = np.delete(d, same[same[:, 0] == a, 1])
                self.nan[at[a]] |= bool(np.isnan(d).any())
                if len(d := d[~np.isnan(d)]):
                    self.number[at[a]] = True
                    self.best[at[a]] = min(self.best[at[a]], d.min())
            return
        low = xx[:, None] + yy - 2 * (x @ y.T)
        low[same[:, 0], same[:, 1]] = np.inf
        error = (x.shape[1] + 8) * 2.0**-50 * (xx + yy.max(initial=0)) + 1e-300
        first = low.argmin(axis=1)
        some = np.flatnonzero(np.isfinite(low[np.arange(len(x)), first]))
        self.number[at[some]] = True
        self.best[at[some]] = np.minimum(self.best[at[some]], ((x[some] - y[first[some]]) ** 2).sum(axis=1))
        bound = np.where(self.best[at] > 0, self.best[at] + error, -np.inf)
        maybe = np.flatnonzero((low < bound[:, None]).ravel())
        for k in range(0, len(maybe), 100_000):
            a, b = np.divmod(maybe[k : k + 100_000], len(y))
            np.minimum.at(self.best, at[a], ((x[a] - y[b]) ** 2).sum(axis=1))

    def result(self) -> tuple[list, pa.Array]:
        kept = np.flatnonzero(self.met > 0)
        value = np.where(self.number, np.sqrt(self.best), np.nan)[kept]
        return [self.keys[i] for i in kept.tolist()], pa.array(value, mask=~(self.number | self.nan)[kept])


def run(name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over batches of (block, part, whether it is a reference row, key, vector) in that order."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, part, waiting = None, None, []

        def ready() -> Part:
            return Part([k for keys, _ in waiting for k in keys], pa.concat_arrays([v for _, v in waiting]))

        def out(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            if part:
                keys, value = part.result()
                yield pa.RecordBatch.from_arrays([pa.array(keys, kind), value], [name, "distance"])

        kind = None
        for batch in batches:
            kind = batch.column(3).type
            marks = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
            cuts = [0, *[i for i in range(1, len(marks)) if marks[i] != marks[i - 1]], len(marks)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if marks[a][:2] != group:
                    yield from out(kind)
                    group, part, waiting = marks[a][:2], None, []
                keys, vectors = batch.column(3)[a:b].to_pylist(), batch.column(4)[a:b]
                if not marks[a][2]:
                    waiting.append((keys, vectors))
                elif waiting:
                    part = part or ready()
                    part.meet(keys, vectors)
        yield from out(kind)

    return search
