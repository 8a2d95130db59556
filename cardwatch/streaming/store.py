"""The feature store of a stream: what is known of each user, merchant, device and address, kept as state.

A row waits until the watermark has passed its time. Then the rows of a key are taken in the order of time and id, as the
batch features take them, so both give the same values. State is kept in small entries: one per minute with activity,
one per value that a distinct count needs, one summary, and waiting rows in packs. A batch reads the entries of its keys
and writes those it changed and a later row can still see: every access to the state is a message to the executor, so
their number follows the windows and not the rows. A row crosses to Python and back as its key, its time and one JSON
text to which a stage appends its features, as every cell that crosses has its price. An entity without activity for the
time to live is forgotten by an event-time timer.

A message costs as much as many rows, so batches with very many keys are better kept in a fixed number of buckets by the
hash of the key (:class:`BucketHistory`): the entries of a bucket are read and written together, a batch sends a few
messages per bucket, whatever its keys, and rows cross as frames. Small batches rewrite more that way. What a task of
buckets holds follows the windows and not the rows, even if one key has most of them: rows that can be closed are sorted in
runs outside of memory (:class:`Runs`), are taken some thousands at a time and leave as they are done.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import pickle
import tempfile
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cardwatch import schema as S
from cardwatch.functions.expressions import DAY_US, HOUR_US, cents, without_zone

MINUTE_US = 60_000_000
TIE = "transaction_id"
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
#: Waiting rows of one key that are stored as one entry.
PACK_ROWS = 10_000
#: Buckets of the keys of one stage: more of them make a small batch rewrite less, fewer make a large one cheaper.
BUCKETS = 1024
#: Bytes of the entries of one bucket that are stored as one value.
PART_BYTES = 1 << 24
#: Rows and bytes that are sorted in memory, bytes of a pack of such a run, and runs that become one.
RUN_ROWS, RUN_BYTES, RUN_PACK_BYTES, RUN_FAN = 1 << 16, 1 << 25, 1 << 20, 32
#: Rows whose features are computed together; all rows of one time are.
STEP_ROWS = 1 << 14


@dataclass(frozen=True)
class Entity:
    """The features of one key. ``counts`` are rows in the closed window before a row, itself left out; ``distinct`` are
    different values in the window before it; widths are in microseconds."""

    key: str
    counts: dict[str, int] = field(default_factory=dict)
    money: dict[str, tuple[str, int]] = field(default_factory=dict)
    distinct: dict[str, tuple[str, int]] = field(default_factory=dict)
    since_last: str | None = None
    change: tuple[str, str] | None = None
    age: str | None = None
    rate: str | None = None

    @property
    def features(self) -> dict[str, T.DataType]:
        whole = [*self.counts, *self.distinct, *([self.change[0]] if self.change else [])]
        real = [*self.money, *[n for n in (self.since_last, self.age, self.rate) if n]]
        return {n: T.LongType() for n in whole} | {n: T.DoubleType() for n in real}

    @property
    def sources(self) -> set[str]:
        """The columns that the features read beside time, amount and label."""
        return {c for c, _ in self.distinct.values()} | ({self.change[1]} if self.change else set())

    @property
    def widest(self) -> int:
        return max([*self.counts.values(), *[w for _, w in self.money.values()], 0])


USER = Entity(
    "user_id",
    counts={"feat_tx_count_user_1h": HOUR_US, "feat_tx_count_user_24h": DAY_US},
    money={"feat_amount_sum_user_24h": ("sum", DAY_US), "feat_amount_avg_user_24h": ("mean", DAY_US)},
    distinct={"feat_unique_countries_user_7d": ("country", 7 * DAY_US)},
    since_last="feat_time_since_last_tx_mins",
    change=("feat_country_change", "country"),
    rate="feat_user_fraud_rate_historical",
)
MERCHANT = Entity(
    "merchant_id", counts={"feat_tx_count_merchant_1h": HOUR_US}, rate="feat_merchant_fraud_rate_historical"
)
DEVICE = Entity(
    "device_id",
    distinct={
        "feat_unique_users_per_device_24h": ("user_id", DAY_US),
        "feat_unique_countries_per_device_7d": ("country", 7 * DAY_US),
    },
    age="feat_device_age_days",
    rate="feat_device_fraud_rate_historical",
)
ADDRESS = Entity("ip_id", distinct={"feat_unique_users_per_ip_24h": ("user_id", DAY_US)}, age="feat_ip_age_days")
ENTITIES = (USER, MERCHANT, DEVICE, ADDRESS)


def in_window(times: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and end, in ascending times, of those in the closed windows [at - width, at]."""
    return np.searchsorted(times, at - width, side="left"), np.searchsorted(times, at, side="right")


def distinct_before(seen: dict, values: list, at: np.ndarray, width: int) -> np.ndarray:
    """Number of different values in [at - width, at) for rows in time order, given the last time of earlier values.

    A row counts after its own time, until its value comes again or the window has passed.
    """
    last, starts, ends = {}, list(seen.values()), [t + width for t in seen.values()]
    places = {v: i for i, v in enumerate(seen)}
    for value, time in zip(values, at.tolist()):
        if value is None:
            continue
        if value in places:
            i = places[value]
            ends[i] = min(ends[i], time)
        places[value] = len(starts)
        starts.append(time)
        ends.append(time + width)
        last[value] = time
    seen.update(last)
    return np.searchsorted(np.sort(starts), at, side="left") - np.searchsorted(np.sort(ends), at, side="left")


def close_ms(us: int) -> int:
    """The watermark, in milliseconds, that closes a time."""
    return -(-us // 1000)


_SUMMARY = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("first_us", "last_us", "rows", "frauds", "expiry_ms")]
    + [T.StructField("value", T.StringType())]
)
_MINUTE = T.StructType([T.StructField("us", T.ArrayType(T.LongType())), T.StructField("cents", T.ArrayType(T.LongType()))])
_PACK = T.StructType([T.StructField("rows", T.BinaryType())])
_PART = T.StructType([T.StructField("bytes", T.BinaryType())])
_LONG = T.StructType([T.StructField("v", T.LongType())])
_TEXT = T.StructType([T.StructField("v", T.StringType())])

STORED = T.StructType(
    [
        T.StructField("minute", T.LongType()),
        T.StructField("us", T.ArrayType(T.LongType())),
        T.StructField("cents", T.ArrayType(T.LongType())),
        T.StructField("column", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("first_us", T.LongType()),
        T.StructField("last_us", T.LongType()),
        T.StructField("rows", T.LongType()),
        T.StructField("frauds", T.LongType()),
    ]
)


class EntityHistory(StatefulProcessor):
    """Adds the features of one entity to rows of an instant ``at`` and a JSON object ``row`` with ``us`` (the same time),
    ``cents``, ``is_fraud`` and ``counted``; rows that are not counted pass through in their order, without features and
    without a trace."""

    def __init__(self, entity: Entity, ttl_us: int | None):
        self.entity, self.ttl_us = entity, ttl_us
        self.output = Row("at", "row")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _PACK)
        self.summary = handle.getValueState("summary", _SUMMARY)
        self.minutes = handle.getMapState("minutes", _LONG, _MINUTE) if self.entity.widest else None
        self.seen = {c: handle.getMapState(f"seen_{c}", _TEXT, _LONG) for c, _ in self.entity.distinct.values()}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        *_, times, texts = zip(*map(tuple, rows))
        us = (min(times) - EPOCH) // dt.timedelta(microseconds=1)
        if close_ms(us) > mark:
            self._wait(list(texts), us)
            return iter(())
        return iter(self._close(key, [*self._waited(), *texts], mark))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = self._waited()
        if rows:
            return iter(self._close(key, rows, mark))
        known = self.summary.get()
        if known and self.ttl_us is not None and known[4] <= mark:
            self._forget()
        return iter(())

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        """Rows of :func:`stored_history`: a minute, a value, or the summary."""
        r = initialState
        if r.minute is not None:
            if self.minutes is not None:
                self.minutes.updateValue((r.minute,), (list(r.us), list(r.cents)))
        elif r.column is not None and r.first_us is None:
            if r.column in self.seen:
                self.seen[r.column].updateValue((r.value,), (r.last_us,))
        else:
            self.summary.update((r.first_us, r.last_us, r.rows, r.frauds, self._expire(r.last_us, None), r.value))

    def close(self) -> None:
        pass

    def _waited(self) -> list[str]:
        return [text for (pack,) in self.waiting.get() for text in pickle.loads(pack)]

    def _wait(self, texts: list[str], first_us: int) -> None:
        """Store rows in packs, a few entries per batch however many they are, with a timer for the first to close."""
        for i in range(0, len(texts), PACK_ROWS):
            self.waiting.appendValue((pickle.dumps(texts[i : i + PACK_ROWS], pickle.HIGHEST_PROTOCOL),))
        self.handle.registerTimer(close_ms(first_us))

    def _expire(self, last_us: int, before: int | None) -> int | None:
        """Move the timer that forgets the entity."""
        if self.ttl_us is None:
            return None
        if before is not None:
            self.handle.deleteTimer(before)
        expiry = close_ms(last_us + self.ttl_us) + 1
        self.handle.registerTimer(expiry)
        return expiry

    def _forget(self) -> None:
        for state in (self.summary, self.minutes, *self.seen.values()):
            if state is not None:
                state.clear()

    def _close(self, key, texts: list[str], mark: int) -> list[Row]:
        """Features of the rows that the watermark has passed; the others go on waiting."""
        rows = [(r["us"], r.get(TIE), r, text) for r, text in zip(map(json.loads, texts), texts)]
        done = sorted((r for r in rows if close_ms(r[0]) <= mark), key=lambda r: r[:2])
        left = [r for r in rows if close_ms(r[0]) > mark]
        self.waiting.clear()
        if left:
            self._wait([r[3] for r in left], min(r[0] for r in left))
        history = [r[2] for r in done if r[2]["counted"]]
        found: list[tuple] = []
        known = self.summary.get()
        while history:
            # Up to the first gap longer than the time to live; behind it the entity is a new one.
            last, end = known[1] if known else history[0]["us"], 0
            while end < len(history) and (self.ttl_us is None or history[end]["us"] - last <= self.ttl_us):
                last, end = history[end]["us"], end + 1
            if end:
                values, known = self._features(key, history[:end], known)
                found += values
            else:
                self._forget()
                known = None
            history = history[end:]
        values, shape = iter(found), "".join(f',"{n}":%r' for n in self.entity.features) + "}"
        return [
            self.output(EPOCH + dt.timedelta(microseconds=us), text[:-1] + shape % next(values) if r["counted"] else text)
            for us, _, r, text in done
        ]

    def _features(self, key, rows: list[dict], known: tuple | None) -> tuple[list[tuple], tuple]:
        entity, n = self.entity, len(rows)
        column = {name: [r.get(name) for r in rows] for name in ("us", "cents", "is_fraud", *entity.sources)}
        at = np.array(column["us"], np.int64)
        out: dict[str, list] = {}
        if self.minutes is not None:
            out |= self._activity(at, column["cents"], known)
        for name, (source, width) in entity.distinct.items():
            out[name] = [0] * n if key[0] is None else self._distinct(source, column[source], at, width, known)
        first = known[0] if known else column["us"][0]
        if entity.since_last:
            before = [known[1] if known else None, *column["us"][:-1]]
            out[entity.since_last] = [
                S.NO_PREVIOUS_TX_MINUTES if b is None else (t - b) / 60e6 for t, b in zip(column["us"], before)
            ]
        value = known[5] if known else None
        if entity.change:
            name, source = entity.change
            out[name] = []
            for v in column[source]:
                out[name].append(int(v is not None and value is not None and v != value))
                value = value if v is None else v
        if entity.age:
            out[entity.age] = [(t - first) / 86400e6 for t in column["us"]]
        past, frauds = (known[2], known[3]) if known else (0, 0)
        rates = []
        for fraud in column["is_fraud"]:
            rates.append(frauds / past if past else 0.0)
            past, frauds = past + 1, frauds + (fraud or 0)
        if entity.rate:
            out[entity.rate] = rates
        last = column["us"][-1]
        summary = (first, last, past, frauds, self._expire(last, known[4] if known else None), value)
        self.summary.update(summary)
        return list(zip(*(out[name] for name in entity.features))), summary

    def _activity(self, at: np.ndarray, cents_: list, known: tuple | None) -> dict[str, list]:
        """Counts and sums over windows; the new rows join the entries of their minutes. A new key has no entries."""
        entity, minutes = self.entity, self.minutes
        stored = {k[0]: v for k, v in minutes.iterator()} if known else {}
        times = np.array([t for us, _ in stored.values() for t in us], np.int64)
        money = np.array([c for _, cs in stored.values() for c in cs], np.int64)
        own = np.array([c or 0 for c in cents_], np.int64)
        times, money = np.concatenate([times, at]), np.concatenate([money, own])
        order = np.argsort(times, kind="stable")
        times, total = times[order], np.concatenate([[0], np.cumsum(money[order])])
        out = {}
        for name, width in entity.counts.items():
            first, end = in_window(times, at, width)
            out[name] = (end - first - 1).tolist()
        for name, (kind, width) in entity.money.items():
            first, end = in_window(times, at, width)
            sums = total[end] - total[first]
            out[name] = ((sums - own) / 100 if kind == "sum" else sums / 100 / (end - first)).tolist()
        # Minutes that no later row can look back to are not written, and go if they were.
        oldest = (int(at[-1]) - entity.widest) // MINUTE_US
        start = int(np.searchsorted(at, oldest * MINUTE_US))
        active, firsts = np.unique(at[start:] // MINUTE_US, return_index=True)
        ends = [*(firsts[1:] + start).tolist(), len(at)]
        for minute, first, end in zip(active.tolist(), (firsts + start).tolist(), ends):
            us, cs = stored.get(minute, ([], []))
            minutes.updateValue((minute,), ([*us, *at[first:end].tolist()], [*cs, *own[first:end].tolist()]))
        for minute in stored:
            if minute < oldest:
                minutes.removeKey((minute,))
        return out

    def _distinct(self, source: str, values: list, at: np.ndarray, width: int, known: tuple | None) -> list:
        state = self.seen[source]
        texts = [None if v is None else str(v) for v in values]
        seen = {k[0]: v[0] for k, v in state.iterator()} if known else {}
        gone = [v for v, t in seen.items() if t + width < int(at[0])]
        for v in gone:
            del seen[v]
        kept = {*seen, *gone}
        counts = distinct_before(seen, texts, at, width)
        live = int(at[-1]) - width  # values last seen before this are out of every later window
        for v in {t for t in texts if t is not None}:
            if seen[v] >= live:
                state.updateValue((v,), (seen[v],))
        for v in kept:
            if seen.get(v, live - 1) < live:
                state.removeKey((v,))
        return counts.tolist()


class Entries(dict):
    """The entries of one kind of a key, while its rows are taken."""

    def iterator(self) -> Iterator[tuple]:
        return iter(list(self.items()))

    def updateValue(self, key: tuple, value: tuple) -> None:
        self[key] = value

    def removeKey(self, key: tuple) -> None:
        del self[key]


class _Unstored:
    """Takes the summary of a key that is stored with the entries of its bucket."""

    def update(self, value: tuple) -> None:
        pass


class Packs:
    """A list whose values are read one at a time. The values of a list state are one value of the store, which is read
    as a whole, and end with the longest one it can hold."""

    def __init__(self, values):
        self.values, self.last = values, 0

    def appendValue(self, value: tuple) -> None:
        # By the clock, so that no size has to be read and written.
        self.last = max(time.time_ns(), self.last + 1)
        self.values.updateValue((self.last,), value)

    def get(self) -> Iterator[tuple]:
        return (self.values.getValue(key) for key in sorted(self.values.keys()))

    def clear(self) -> None:
        self.values.clear()


class Runs:
    """Rows to be read in the order of time, however many there are: runs of a bounded size are sorted and lie in packs in
    a file without a name, of which a reader holds about one pack per run; many runs are made one."""

    def __init__(self):
        self.us, self.texts, self.bytes = [], [], 0
        self.runs: list[tuple[int, list[tuple[int, Callable]]]] = []
        self.file = tempfile.SpooledTemporaryFile(RUN_BYTES)

    def __bool__(self) -> bool:
        return bool(self.texts or self.runs)

    def add(self, us: np.ndarray, texts: list[str]) -> None:
        if not texts:
            return
        self.us.append(us)
        self.texts += texts
        self.bytes += sum(map(len, texts))
        if len(self.texts) >= RUN_ROWS or self.bytes >= RUN_BYTES:
            self._store(0, [self._run()])

    def steps(self) -> Iterator[tuple[np.ndarray, list[str]]]:
        packs = [p for _, run in self.runs for p in run]
        if self.texts:
            us, texts = self._run()
            packs += [(int(us[i]), lambda p=p: (us[p], texts[p])) for i, p in _parts(texts)]
        return in_order(packs)

    def _run(self) -> tuple[np.ndarray, list[str]]:
        """What is in memory, sorted."""
        us = np.concatenate(self.us)
        order = np.argsort(us, kind="stable")
        run = us[order], [self.texts[i] for i in order.tolist()]
        self.us, self.texts, self.bytes = [], [], 0
        return run

    def _store(self, level: int, pieces: Iterator[tuple[np.ndarray, list[str]]]) -> None:
        packs = []
        for us, texts in pieces:
            for i, part in _parts(texts):
                self.file.seek(0, os.SEEK_END)
                packs.append((int(us[i]), lambda at=self.file.tell(): self._read(at)))
                pickle.dump((us[part], texts[part]), self.file, pickle.HIGHEST_PROTOCOL)
        self.runs.append((level, packs))
        alike = [run for own, run in self.runs if own == level]
        if len(alike) == RUN_FAN:
            self.runs = [r for r in self.runs if r[0] != level]
            self._store(level + 1, in_order([p for run in alike for p in run]))

    def _read(self, at: int) -> tuple[np.ndarray, list[str]]:
        self.file.seek(at)
        return pickle.load(self.file)


def _parts(texts: list[str]) -> list[tuple[int, slice]]:
    """Slices of about the bytes of a pack."""
    n = max(1, len(texts) * RUN_PACK_BYTES // max(1, sum(map(len, texts))))
    return [(i, slice(i, i + n)) for i in range(0, len(texts), n)]


def in_order(packs: list[tuple[int, Callable]]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """The rows of sorted packs, given by their first times and how to read them, in the order of time: some thousands at a
    time, all rows of one time together. A pack is read when the rows before its first time run out."""
    packs = sorted(packs, key=lambda p: p[0])
    us, texts = np.empty(0, np.int64), []
    for (_, read), following in zip(packs, [*packs[1:], None]):
        more, own = read()
        us, texts = np.concatenate([us, more]), texts + own
        ready = len(us) if following is None else int((us < following[0]).sum())
        if following is not None and ready < STEP_ROWS:
            continue
        order = np.argsort(us, kind="stable")
        us, texts = us[order], [texts[i] for i in order.tolist()]
        start = 0
        while start < ready:
            end = min(start + STEP_ROWS, ready)
            end = int(np.searchsorted(us[:ready], us[end - 1], side="right"))
            yield us[start:end], texts[start:end]
            start = end
        us, texts = us[ready:], texts[ready:]


class BucketHistory(EntityHistory):
    """Adds the features of one entity to rows of a bucket, an instant ``at``, its microseconds ``us`` and a JSON object
    ``row`` with the key, ``us``, ``cents``, ``is_fraud`` and ``counted``; rows that are not counted pass through in their
    order, without features and without a trace."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _PACK)
        self.known = handle.getListState("known", _PART)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        done, firsts = Runs(), []
        for frame in rows:
            us, texts = frame.iloc[:, -2].to_numpy(np.int64), frame.iloc[:, -1].tolist()
            firsts += self._wait_in_packs(*self._divide(us, texts, mark, done))
        self._wake(firsts)
        if done:
            yield from self._close_all(done, mark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._close_all(Runs(), timerValues.getCurrentWatermarkInMs())

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Rows of :func:`stored_history` as JSON texts: a minute, a value, or the summary."""
        before, known = self._load()
        for r in map(json.loads, initialState.iloc[:, -1]):
            own = r.get(self.entity.key)
            r = {f.name: r.get(f.name) for f in STORED}
            summary = self._take(known.get(own))
            if r["minute"] is not None:
                if self.minutes is not None:
                    self.minutes.updateValue((r["minute"],), (r["us"], r["cents"]))
            elif r["column"] is not None and r["first_us"] is None:
                if r["column"] in self.seen:
                    self.seen[r["column"]].updateValue((r["value"],), (r["last_us"],))
            else:
                summary = (r["first_us"], r["last_us"], r["rows"], r["frauds"], self._expire(r["last_us"], None), r["value"])
            known[own] = (summary, self.minutes, self.seen)
        self._store(before, known, timerValues.getCurrentWatermarkInMs())

    def _take(self, entries: tuple | None) -> tuple | None:
        """Make the entries of a key the current ones; without any it is a new key. Returns the summary."""
        self.summary = _Unstored()
        summary, self.minutes, self.seen = entries or (
            None,
            Entries() if self.entity.widest else None,
            {c: Entries() for c, _ in self.entity.distinct.values()},
        )
        return summary

    def _load(self) -> tuple[int | None, dict]:
        """The timer of the bucket and the entries of its keys."""
        stored = b"".join(bytes(part) for (part,) in self.known.get())
        return pickle.loads(stored) if stored else (None, {})

    def _store(self, before: int | None, known: dict, mark: int) -> None:
        """Store what is not forgotten, with a timer for the next key to forget."""
        kept = {k: e for k, e in known.items() if e[0] is None or e[0][4] is None or e[0][4] > mark}
        timer = min((e[0][4] for e in kept.values() if e[0] and e[0][4] is not None), default=None)
        if timer != before:
            if before is not None and before > mark:
                self.handle.deleteTimer(before)
            if timer is not None:
                self.handle.registerTimer(timer)
        if not kept:
            self.known.clear()
            return
        stored = pickle.dumps((timer, kept), pickle.HIGHEST_PROTOCOL)
        self.known.put([(stored[i : i + PART_BYTES],) for i in range(0, len(stored), PART_BYTES)])

    def _expire(self, last_us: int, before: int | None) -> int | None:
        """The watermark that forgets the entity; the timer is the bucket's."""
        return None if self.ttl_us is None else close_ms(last_us + self.ttl_us) + 1

    def _divide(self, us: np.ndarray, texts: list[str], mark: int, done: Runs) -> tuple[np.ndarray, list[str]]:
        """Put the rows that the watermark has passed into ``done`` and return the others."""
        closed = us <= mark * 1000
        if closed.all():
            done.add(us, texts)
            return us[:0], []
        done.add(us[closed], [t for t, c in zip(texts, closed.tolist()) if c])
        return us[~closed], [t for t, c in zip(texts, closed.tolist()) if not c]

    def _wait_in_packs(self, us: np.ndarray, texts: list[str]) -> list[int]:
        """Store rows; returns the first of their times."""
        for i in range(0, len(texts), PACK_ROWS):
            part = slice(i, i + PACK_ROWS)
            self.waiting.appendValue((pickle.dumps((us[part], texts[part]), pickle.HIGHEST_PROTOCOL),))
        return [int(us.min())] if texts else []

    def _wake(self, firsts: list[int]) -> None:
        if firsts:
            self.handle.registerTimer(close_ms(min(firsts)))

    def _close_all(self, done: Runs, mark: int) -> Iterator[pd.DataFrame]:
        """Features of the rows that the watermark has passed, ``done`` and waiting ones; the others go on waiting."""
        packs, firsts = 0, []
        with tempfile.SpooledTemporaryFile(RUN_BYTES) as left:
            for packs, (pack,) in enumerate(self.waiting.get(), 1):
                pickle.dump(self._divide(*pickle.loads(pack), mark, done), left, pickle.HIGHEST_PROTOCOL)
            if packs:
                self.waiting.clear()
            left.seek(0)
            for _ in range(packs):
                firsts += self._wait_in_packs(*pickle.load(left))
        self._wake(firsts)
        before, known = self._load()
        for us, texts in done.steps():
            yield self._step(us.tolist(), texts, known)
        if known:
            self._store(before, known, mark)

    def _step(self, us: list[int], texts: list[str], known: dict) -> pd.DataFrame:
        """Features of rows in the order of time, whose keys' entries in ``known`` they change."""
        rows = [(t, r.get(TIE), r, text) for t, r, text in zip(us, map(json.loads, texts), texts)]
        by_key: dict[object, list[tuple]] = {}
        for r in sorted(rows, key=lambda r: r[:2]):
            by_key.setdefault(r[2].get(self.entity.key), []).append(r)
        shape = "".join(f',"{n}":%r' for n in self.entity.features) + "}"
        times, out = [], []
        for key, own in by_key.items():
            values = iter(self._replay(key, [r[2] for r in own if r[2]["counted"]], known))
            times += [r[0] for r in own]
            out += [text[:-1] + shape % next(values) if r["counted"] else text for _, _, r, text in own]
        at = pd.Series(np.array(times, "datetime64[us]")).dt.tz_localize("UTC")
        return pd.DataFrame({"at": at, "row": out})

    def _replay(self, key, history: list[dict], known: dict) -> list[tuple]:
        """Features of the rows of one key, whose entries in ``known`` they change."""
        found: list[tuple] = []
        summary = self._take(known.get(key))
        while history:
            # Up to the first gap longer than the time to live; behind it the entity is a new one.
            last, end = summary[1] if summary else history[0]["us"], 0
            while end < len(history) and (self.ttl_us is None or history[end]["us"] - last <= self.ttl_us):
                last, end = history[end]["us"], end + 1
            if end:
                values, summary = self._features((key,), history[:end], summary)
                found += values
            else:
                summary = self._take(None)
            history = history[end:]
        if found:
            known[key] = (summary, self.minutes, self.seen)
        return found


class PackedHistory(BucketHistory):
    """The same for buckets with any number of waiting rows: a pack of them is a value of its own."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = Packs(handle.getMapState("packs", _LONG, _PACK))
        self.known = handle.getListState("known", _PART)


def stored_history(tx: DataFrame, entity: Entity, before: str, ttl_days: int | None = 7) -> DataFrame:
    """What the state of ``entity`` has to start with for a stream from the instant ``before`` on: a row per active
    minute, per value of a distinct count and per key, from the stored transactions before it.

    Counted and combined before the shuffles; the longest row holds one minute of one key.
    """
    at = F.unix_micros("at")
    past = tx.where(F.col("at") < F.lit(before).cast("timestamp")).withColumns({"us": at, "cents": cents(F.col("amount"))})
    now = F.unix_micros(F.lit(before).cast("timestamp"))
    key = F.col(entity.key).alias(entity.key)
    keyed = past.withColumn("_id", F.struct("us", "transaction_id"))
    if ttl_days is not None:
        # Only what came after the last gap longer than the time to live belongs to the entity of today.
        order = f"(PARTITION BY {entity.key} ORDER BY us, transaction_id)"
        gap = keyed.withColumn("_gap", F.expr(f"us - lag(us) OVER {order} > {ttl_days * DAY_US}"))
        starts = gap.groupBy(entity.key).agg(F.max(F.when(F.col("_gap"), F.col("_id"))).alias("_start"), F.max("us").alias("_last"))
        starts = starts.withColumnRenamed(entity.key, "_key")
        keyed = keyed.join(starts, keyed[entity.key].eqNullSafe(F.col("_key")))
        keyed = keyed.where((F.col("_last") + ttl_days * DAY_US >= now) & (F.col("_start").isNull() | (F.col("_id") >= F.col("_start"))))

    def shaped(df: DataFrame) -> DataFrame:
        return df.select(key, *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in STORED])

    rows = F.sort_array(F.collect_list(F.struct("us", F.coalesce("cents", F.lit(0)).alias("cents"))))
    parts = []
    if entity.widest:
        recent = keyed.where(F.col("us") >= now - entity.widest - MINUTE_US)
        minute = F.floor(F.col("us") / MINUTE_US).cast("long").alias("minute")
        by_minute = recent.groupBy(entity.key, minute).agg(rows.alias("rows"))
        parts.append(shaped(by_minute.select(entity.key, "minute", F.col("rows.us").alias("us"), F.col("rows.cents").alias("cents"))))
    for source, width in entity.distinct.values():
        recent = keyed.where(F.col(source).isNotNull() & (F.col("us") >= now - width))
        last = recent.groupBy(entity.key, F.col(source).cast("string").alias("value")).agg(F.max("us").alias("last_us"))
        parts.append(shaped(last.withColumn("column", F.lit(source))))
    source = F.col(entity.change[1]) if entity.change else F.lit(None).cast("string")
    summary = keyed.groupBy(entity.key).agg(
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.count(F.lit(1)).alias("rows"),
        F.sum("is_fraud").alias("frauds"),
        F.max_by(source, F.when(source.isNotNull(), F.col("_id"))).alias("value"),
    )
    parts.append(shaped(summary))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")


def with_history(
    tx: DataFrame,
    entities: tuple[Entity, ...] = ENTITIES,
    ttl_days: int | None = 7,
    stored: dict[str, DataFrame] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """A stream of transactions with the history features of ``entities``, one stateful stage and one shuffle each.

    ``tx`` has the instant ``at`` with a watermark; a column ``counted`` may say which rows belong to the history.
    Rows come out when the watermark has passed them. ``stored`` may give frames of :func:`stored_history` by key.
    ``buckets`` keeps the state of that many groups of keys and not of each key, for batches of very many keys or of keys
    with very many rows.
    """
    simple = [f.name for f in tx.schema if not isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.ArrayType))]
    kept = [c for c in simple if c not in ("us", "cents", "counted")]
    counted = F.col("counted") if "counted" in tx.columns else F.lit(True)
    extra = [counted.alias("counted"), F.unix_micros("at").alias("us"), cents(F.col("amount")).alias("cents")]
    rows = tx.select("at", F.to_json(F.struct(*kept, *extra)).alias("row"))
    fields = {f.name: f.dataType for f in tx.select(*kept, counted.alias("counted")).schema}
    ttl_us = None if ttl_days is None else ttl_days * DAY_US
    for entity in entities:
        first = (stored or {}).get(entity.key)
        kind = fields[entity.key]
        key = F.from_json("row", T.StructType([T.StructField(entity.key, kind)]))[entity.key]
        made = {"outputStructType": "at timestamp, row string", "outputMode": "Append", "timeMode": "EventTime", "eventTimeColumnName": "at"}
        if buckets is None:
            rows = rows.select(key.alias(entity.key), "at", "row").groupBy(entity.key).transformWithState(
                statefulProcessor=EntityHistory(entity, ttl_us),
                initialState=None if first is None else first.groupBy(entity.key),
                **made,
            )
        else:
            if first is not None:
                state = F.to_json(F.struct(entity.key, *[f.name for f in STORED])).alias("state")
                first = first.select(_bucket(F.col(entity.key).cast(kind), buckets), state).groupBy("bucket")
            keyed = rows.select(_bucket(key, buckets), "at", F.unix_micros("at").alias("us"), "row").groupBy("bucket")
            rows = keyed.transformWithStateInPandas(
                statefulProcessor=PackedHistory(entity, ttl_us), initialState=first, **made
            )
        fields |= entity.features
    values = F.from_json("row", T.StructType([T.StructField(n, kind) for n, kind in fields.items()])).alias("_values")
    names = [*kept, *(["counted"] if "counted" in tx.columns else []), *[n for e in entities for n in e.features]]
    opened = rows.select("at", without_zone(F.col("at")).alias("ts"), values)
    after = len(kept)
    columns = [F.col("_values")[n].alias(n) for n in names]
    return opened.select(*columns[:after], "at", "ts", *columns[after:])
