"""State of one user: an entry for each active minute of the last week, forgotten after a week without any."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR = 60
DAY = 24 * HOUR
WEEK = 7 * DAY

MINUTE_MS = 60_000
OUTPUT = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("minute", T.LongType()),
        T.StructField("tx_1h", T.LongType()),
        T.StructField("tx_24h", T.LongType()),
        T.StructField("tx_7d", T.LongType()),
        T.StructField("cents_24h", T.LongType()),
    ]
)


def trailing(minutes: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """Sum of the values in (minute - width, minute] for ascending minutes."""
    total = np.concatenate([[0], np.cumsum(values)])
    first = np.searchsorted(minutes, minutes - width, side="right")
    return total[1:] - total[first]


class UserVelocity(StatefulProcessor):
    """A batch reads the entries of its users, adds the new minutes and removes those older than a week; the other entries
    are not written again. A timer at the end of the last minute's week ends a user who does not return."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.minutes = handle.getMapState("minutes", "minute long", "n long, cents long")
        self.expiry = handle.getValueState("expiry", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[["minute", "n", "cents"]]
        stored = [(k[0], *v) for k, v in self.minutes.iterator()]
        old = pd.DataFrame(stored, columns=["minute", "n", "cents"]).astype("int64")
        both = pd.concat([old.assign(fresh=False), new.assign(fresh=True)]).sort_values("minute")
        minute = both["minute"].to_numpy("int64")
        n, cents = both["n"].to_numpy("int64"), both["cents"].to_numpy("int64")
        out = pd.DataFrame(
            {
                "user_id": key[0],
                "minute": minute,
                "tx_1h": trailing(minute, n, HOUR),
                "tx_24h": trailing(minute, n, DAY),
                "tx_7d": trailing(minute, n, WEEK),
                "cents_24h": trailing(minute, cents, DAY),
            }
        )
        latest = int(minute.max())
        for m, *values in new.astype("int64").to_numpy().tolist():
            if m > latest - WEEK:
                self.minutes.updateValue((m,), tuple(values))
        for m, *_ in stored:
            if m <= latest - WEEK:
                self.minutes.removeKey((m,))
        self._wake(latest)
        yield out[both["fresh"].to_numpy()]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.expiry.exists() and self.expiry.get()[0] <= timerValues.getCurrentWatermarkInMs():
            self.minutes.clear()
            self.expiry.clear()
        return iter(())

    def _wake(self, latest: int) -> None:
        """Move the timer that ends the user."""
        if self.expiry.exists():
            self.handle.deleteTimer(self.expiry.get()[0])
        expiry = (latest + WEEK + 1) * MINUTE_MS
        self.expiry.update((expiry,))
        self.handle.registerTimer(expiry)

    def close(self) -> None:
        pass
