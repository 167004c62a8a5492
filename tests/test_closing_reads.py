"""What the closing of postings asks of its state, with maps in the place of Spark's."""

import pandas as pd

from postlens.streaming.closing import Closing

DAY = 86_400_000


class Map(dict):
    asked = passes = 0
    updateValue, removeKey = dict.__setitem__, dict.__delitem__

    def containsKey(self, key):
        self.asked += 1
        return key in self

    def getValue(self, key):
        self.asked += 1
        return self.get(key)

    def keys(self):
        return iter(list(super().keys()))

    def iterator(self):
        self.passes += 1
        return iter(list(self.items()))


class Handle:
    def __init__(self):
        self.timers = []

    def getMapState(self, *_):
        return Map()

    def registerTimer(self, at):
        self.timers.append(at)


class At:
    def __init__(self, millis):
        self.millis = millis

    def getCurrentWatermarkInMs(self):
        return self.millis

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_a_batch_asks_once_for_a_posting_and_runs_that_end_together_are_one_pass():
    closing, handle = Closing(DAY, 30), Handle()
    closing.init(handle)
    frames = [pd.DataFrame({"run_id": [run] * 3, "uid": ["a" if run < 3 else None, "b", f"c{run}"]}) for run in range(1, 9)]
    opened = list(closing.handleInputRows(("board",), iter(frames), At(0)))
    assert {(u, r) for x in opened for u, r in zip(x["uid"], x["run"], strict=True)} == {("a", 2), ("b", 8)} | {(f"c{r}", r) for r in range(1, 9)}
    assert closing.postings.asked == 10
    closed = [x for at in sorted(handle.timers) if at < 8 * DAY for x in closing.handleExpiredTimer(("board",), At(8 * DAY), At(at))]
    assert closing.postings.passes == 1
    assert {(u, r, bool(c), n) for x in closed for u, r, c, n in zip(x["uid"], x["run"], x["closed"], x["change"], strict=True)} == {("a", 3, True, 2)} | {(f"c{r}", r + 1, True, 2) for r in range(1, 6)}
    assert sorted(closing.awaited) == [(7,), (8,)] and all(closing.postings[(f"c{r}",)] == (r, r < 6, 2 if r < 6 else 1) for r in range(1, 9))
