"""Small helpers inside tasks: consecutive groups of a sorted Arrow stream, links folded into a spanning forest, ids of distinct words,
and free memory given back."""

from __future__ import annotations

import contextlib
import ctypes
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that a word takes in ``Known`` besides its own and its ids.
BESIDE = 160


def give_back() -> None:
    """Returns what Arrow's pool and malloc hold unused to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # not in every C library
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same for mapInArrow, giving free memory back after each batch and at the end. A Python worker outlives its tasks, and would
    hold it while other tasks and the JVM need it."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in run(batches):
                yield batch
                give_back()
        finally:
            give_back()

    return mapped


def spans(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The positions first, first + 1, ... of each span, ``many`` of them, in a row."""
    to = np.cumsum(many, dtype=np.int32)
    return np.repeat(first - to + many, many) + np.arange(to[-1] if len(to) else 0, dtype=np.int32)


def strings(column: pa.Array) -> list[str]:
    """A column of strings without line feeds as a list, faster than by to_pylist."""
    return column.to_numpy(zero_copy_only=False).tolist()


def byte_groups(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive groups of texts of about ``size`` bytes."""
    group = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // size
    starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    yield from zip(starts[:-1], starts[1:], strict=True)


class Known:
    """The ids of distinct strings, of which those of earlier calls are kept, with their ids in one array. Beyond ``most`` bytes those used
    last stay, in half of that.

    ``encode`` does for new strings what ``of`` does for all.
    """

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]], most: int):
        self.encode, self.most, self.calls = encode, most, 0
        self.row: dict[str, int] = {}
        self.ids, (self.first, self.many, self.last, self.size) = np.zeros(0, dtype="<u4"), np.zeros((4, 0), dtype=np.int32)

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, many): where among ids those of each of these strings, all distinct, begin, and how many it has."""
        self.calls += 1
        names = strings(words)
        at = np.fromiter(map(self.row.get, names, itertools.repeat(-1)), np.int32, len(names))
        new = np.flatnonzero(at < 0)
        fresh = words.take(pa.array(new))
        ids, first, many = self.encode(fresh)
        at[new] = len(self.first) + np.arange(len(new))
        self.row.update(zip([names[i] for i in new.tolist()], at[new].tolist(), strict=True))
        size = pc.binary_length(fresh).to_numpy() + 4 * many + BESIDE
        self.first, self.ids = np.concatenate([self.first, first + np.int32(len(self.ids))]), np.concatenate([self.ids, ids])
        self.many, self.size = np.concatenate([self.many, many]), np.concatenate([self.size, size])
        self.last = np.append(self.last, np.zeros(len(new), dtype=np.int32))
        self.last[at] = self.calls
        got = self.ids, self.first[at], self.many[at]
        if self.size.sum(dtype=np.int64) > self.most:
            order = np.argsort(-self.last, kind="stable")
            kept = np.sort(order[np.cumsum(self.size[order], dtype=np.int64) <= self.most // 2])
            names = list(self.row)
            self.row = {names[i]: k for k, i in enumerate(kept.tolist())}
            self.ids = self.ids[spans(self.first[kept], self.many[kept])]
            self.many, self.last, self.size = self.many[kept], self.last[kept], self.size[kept]
            self.first = np.cumsum(self.many, dtype=np.int32) - self.many
        return got


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The runs of equal keys (integers) of a stream sorted by them, each whole, whatever batches it spans."""
    held: list[pa.RecordBatch] = []
    last = None
    whole = lambda: held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in keys])
        starts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        if held and tuple(k[:, 0]) != last:
            yield whole()
            held = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield whole()
                held = []
        last = tuple(k[:, -1])
    if held:
        yield whole()


class Forest:
    """Links among n rows of a tile pair, kept as one label for each row, so that its links are as few as its rows."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, hits: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """hits[i, j]: row left[i] is linked with row right[j]."""
        for i in np.flatnonzero(hits.any(axis=1)):
            linked = np.unique(np.append(self.label[right[hits[i]]], self.label[left[i]]))
            if len(linked) > 1:
                self.label[np.isin(self.label, linked[1:])] = linked[0]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Each row that has a link with the row that stands for its tree."""
        child = np.flatnonzero(self.label != np.arange(len(self.label)))
        return child, self.label[child]
