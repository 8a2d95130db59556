"""Ranks among earlier rows, for many groups at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that are counted at a time where groups are small; a larger group is taken whole.
ROWS = 1 << 17


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether each row is the first of a run of equal values."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _since(new: np.ndarray) -> np.ndarray:
    """The place of the first row of each row's run."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def earlier(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows in the order of their group and time: how many rows of the group come before, how many of these have the
    same value and how many a smaller one.

    A merge count without recursion: on each level, neighbouring blocks of 1, 2, 4, … rows of a group are looked at in
    the order of their values, and rows of the right block count the smaller ones of the left block.
    """
    n = len(group)
    place = np.arange(n)
    first = _since(_starts(group))
    past = place - first
    by_value = np.lexsort((place, value, group))
    run = _starts(group[by_value], value[by_value])
    same, smaller = np.empty(n, np.int64), np.zeros(n, np.int64)
    same[by_value] = np.arange(n) - _since(run)
    longest = int(past.max(initial=0)) + 1
    for level in range((longest - 1).bit_length()):
        parent = first + (past >> (level + 1) << (level + 1))
        order = by_value[np.argsort(parent[by_value], kind="stable")]
        left = (past[order] >> level) & 1 == 0
        before = np.cumsum(left) - left  # left rows in front of each
        block, amount = parent[order], value[order]
        counted = before[_since(_starts(block, amount))] - before[_since(_starts(block))]
        right = ~left
        smaller[order[right]] += counted[right]
    return past, same, smaller


def counter(key: str, part: str, value: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow function for partitions sorted by key, part and time: all columns, and past, same and smaller counts of
    ``value`` within (key, part). Rows without a value count nothing and are not counted."""

    def count(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        there = pc.is_valid(table[value]).to_numpy()
        numbers = pc.drop_null(table[value]).to_numpy()
        out = []
        for found in earlier(group[there], numbers):
            whole = np.zeros(len(group), np.int64)
            whole[there] = found
            out.append(pa.array(whole, mask=~there))
        names = [*table.column_names, "_past", "_same", "_smaller"]
        yield from pa.table([*table.columns, *out], names=names).to_batches()

    def groups(table: pa.Table) -> np.ndarray:
        codes = pc.fill_null(pc.dictionary_encode(table[key]).combine_chunks().indices, -1).to_numpy(zero_copy_only=False)
        return np.cumsum(_starts(codes, table[part].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        wait = ROWS
        for batch in batches:
            kept.append(batch)
            rows = sum(b.num_rows for b in kept)
            if rows < wait:
                continue
            table = pa.Table.from_batches(kept)
            group = groups(table)
            done = int(np.searchsorted(group, group[-1]))  # the last group may go on
            if done:
                yield from count(table.slice(0, done), group[:done])
            kept = table.slice(done).to_batches()
            wait = max(ROWS, 2 * (rows - done))
        if kept:
            table = pa.Table.from_batches(kept)
            if table.num_rows:
                yield from count(table, groups(table))

    return run
