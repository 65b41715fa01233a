"""The state of open approvals against a look at all events."""

import random

import numpy as np

from corpuslens.streaming.approvals import decided, stretches


def brute(edits, searches, ttl):
    return [any((s, q) > (t, p) and s < t + ttl for s, q in searches) for t, p in edits]


def test_stretches_decide_like_all_searches():
    rng = random.Random(7)
    for _ in range(400):
        ttl, n = rng.choice([3, 10, 30]), rng.randint(0, 30)
        ids = rng.sample(range(1000), 2 * n + 10)
        searches = [(rng.randint(0, 120), ids.pop()) for _ in range(n)]
        edits = [(rng.randint(0, 120), ids.pop()) for _ in range(10)]
        first = last = np.empty((0, 2), np.int64)
        left = list(searches)
        while left:  # in arbitrary batches, out of order
            k = rng.randint(1, len(left))
            part, left = np.array(left[:k], np.int64), left[k:]
            first, last = stretches(np.concatenate([first, part]), np.concatenate([last, part]), ttl)
        e = np.array(edits, np.int64)
        assert decided(e[:, 0], e[:, 1], first, last, ttl).tolist() == brute(edits, searches, ttl)
        assert len(first) <= 120 // ttl + 1  # whatever the number of searches is


def test_a_hot_user_keeps_one_stretch():
    first = last = np.empty((0, 2), np.int64)
    for i in range(10):
        ts = np.arange(i * 100_000, (i + 1) * 100_000) * 1_000_000
        part = np.column_stack([ts, np.arange(len(ts)) + i * 100_000])
        first, last = stretches(np.concatenate([first, part]), np.concatenate([last, part]), 1_800_000_000)
    assert len(first) == 1 and last[0, 1] == 999_999
