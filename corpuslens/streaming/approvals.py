"""The state of open approvals per user, for ``transformWithStateInPandas``."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql.streaming import StatefulProcessor

# The processor travels with its code: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ARRAYS = "ts array<long>, sequence array<long>"


def stretches(first: np.ndarray, last: np.ndarray, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of searches, each a (time, sequence) pair of its first and last, joined where the pause is under ``ttl``.

    ``first`` and ``last`` have one row per stretch or single search, in any order.
    """
    order = np.lexsort((first[:, 1], first[:, 0]))
    first, last = first[order], last[order]
    if not len(first):
        return first, last
    # the latest search reached so far; stretches may overlap when events come out of order
    by_last = np.lexsort((last[:, 1], last[:, 0]))
    rank = np.empty(len(last), np.int64)
    rank[by_last] = np.arange(len(last))
    reach = last[by_last[np.maximum.accumulate(rank)]]
    begin = np.concatenate([[True], first[1:, 0] - reach[:-1, 0] >= ttl])
    return first[begin], reach[np.concatenate([begin[1:], [True]])]


def decided(ts: np.ndarray, sequence: np.ndarray, first: np.ndarray, last: np.ndarray, ttl: int) -> np.ndarray:
    """Whether a search follows each edit within ``ttl``, by stretches in order."""
    if not len(first):
        return np.zeros(len(ts), bool)
    # the first stretch whose last search comes after the edit
    at = np.searchsorted(last[:, 0], ts, "left")
    tied = (at < len(last)) & (last[np.minimum(at, len(last) - 1), 0] == ts) & (last[np.minimum(at, len(last) - 1), 1] < sequence)
    at = at + tied
    found = at < len(last)
    own = first[np.minimum(at, len(last) - 1)]
    before = (own[:, 0] > ts) | ((own[:, 0] == ts) & (own[:, 1] > sequence))  # the edit lies before the stretch
    return found & (~before | (own[:, 0] - ts < ttl))


class OpenApprovals(StatefulProcessor):
    """Approvals without a decision, by time to live since 1970, and the stretches of searches a late edit may need."""

    def __init__(self, ttl: int):
        self.ttl = ttl  # microseconds

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "bucket long", _ARRAYS)
        self.searches = handle.getValueState("searches", "first_ts array<long>, first_sequence array<long>, last_ts array<long>, last_sequence array<long>")

    def _known(self) -> tuple[np.ndarray, np.ndarray]:
        held = self.searches.get() if self.searches.exists() else None
        if held is None:
            return np.empty((0, 2), np.int64), np.empty((0, 2), np.int64)
        return tuple(np.array([held[i], held[i + 1]], np.int64).T.reshape(-1, 2) for i in (0, 2))

    def _rows(self, key, sequence: np.ndarray, state: str) -> pd.DataFrame:
        return pd.DataFrame({"user_id": np.full(len(sequence), key[0], np.int64), "approval_id": sequence, "state": state})

    def handleInputRows(self, key, rows, timerValues):
        first, last = self._known()
        edits = np.empty((0, 2), np.int64)
        for batch in rows:
            own = batch[["at", "sequence"]].to_numpy(np.int64)
            search = (batch["event_type"] == "search").to_numpy()
            if search.any():
                first, last = stretches(np.concatenate([first, own[search]]), np.concatenate([last, own[search]]), self.ttl)
            edits = np.concatenate([edits, own[~search]])
            ok = decided(edits[:, 0], edits[:, 1], first, last, self.ttl)
            if ok.any():
                yield self._rows(key, edits[ok, 1], "approved")
                edits = edits[~ok]
        # approvals that were open: a search of this batch may decide them
        for (bucket,), held in list(self.open.iterator()):
            ts, sequence = (np.array(held[i], np.int64) for i in (0, 1))
            now = decided(ts, sequence, first, last, self.ttl)
            if now.any():
                yield self._rows(key, sequence[now], "approved")
                if now.all():
                    self.open.removeKey((bucket,))
                    self.handle.deleteTimer(self._timer(bucket))
                else:
                    self.open.updateValue((bucket,), (ts[~now].tolist(), sequence[~now].tolist()))
        for bucket in np.unique(edits[:, 0] // self.ttl).tolist():
            mine = edits[edits[:, 0] // self.ttl == bucket]
            held = self.open.getValue((bucket,)) if self.open.containsKey((bucket,)) else ([], [])
            self.open.updateValue((bucket,), ([*held[0], *mine[:, 0].tolist()], [*held[1], *mine[:, 1].tolist()]))
            self.handle.registerTimer(self._timer(bucket))
        # an edit that may still come is not older than the watermark: searches before that decide nothing any more
        wanted = last[:, 0] >= timerValues.getCurrentWatermarkInMs() * 1000
        first, last = first[wanted], last[wanted]
        if len(first):
            self.searches.update((first[:, 0].tolist(), first[:, 1].tolist(), last[:, 0].tolist(), last[:, 1].tolist()))
        else:
            self.searches.clear()

    def _timer(self, bucket: int) -> int:
        """When all that could decide an approval of the bucket has come, in milliseconds."""
        return int((bucket + 2) * self.ttl // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        bucket = expiredTimerInfo.getExpiryTimeInMs() * 1000 // self.ttl - 2
        if self.open.containsKey((bucket,)):
            held = self.open.getValue((bucket,))
            self.open.removeKey((bucket,))
            yield self._rows(key, np.array(held[1], np.int64), "expired")

    def close(self) -> None:
        pass
