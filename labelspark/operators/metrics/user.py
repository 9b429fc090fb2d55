"""User metrics with mergeable states (L-5).

A metric is four functions: ``init`` gives an empty state, ``update`` takes a
state and arrays of truths and scores, ``merge`` takes two states, ``finish``
turns one into a number.  States are built in the tasks, one for each key and
task, and merged in two steps, so neither the rows nor the states of all tasks
meet in one place.  What counts of tp, fp, fn, tn can't give (calibration,
losses, distances of distributions) is written this way and used by name.
"""

from __future__ import annotations

import pickle
from collections.abc import Mapping, Sequence
from typing import Any, Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys a task holds states for before it sends them on.
_HELD = 4096
#: Tasks whose states are merged in the first step.
_FAN = 1024


class UserMetric(Protocol):
    def init(self) -> Any: ...
    def update(self, state: Any, truth: np.ndarray, score: np.ndarray) -> Any: ...
    def merge(self, a: Any, b: Any) -> Any: ...
    def finish(self, state: Any) -> float | None: ...


class Mean:
    """Base of metrics that are the mean of something per row."""

    def of(self, truth: np.ndarray, score: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def init(self):
        return 0, 0.0

    def update(self, state, truth, score):
        return state[0] + len(truth), state[1] + float(self.of(truth, score).sum())

    def merge(self, a, b):
        return a[0] + b[0], a[1] + b[1]

    def finish(self, state):
        return state[1] / state[0] if state[0] else None


class Brier(Mean):
    """Mean squared distance of score and truth."""

    def of(self, truth, score):
        return (score - truth) ** 2


class LogLoss(Mean):
    """Mean negative log-likelihood; scores are held within ``eps`` of 0 and 1."""

    def __init__(self, eps: float = 1e-15):
        self.eps = eps

    def of(self, truth, score):
        p = np.clip(score, self.eps, 1 - self.eps)
        return -np.where(truth == 1, np.log(p), np.log1p(-p))


class CalibrationError:
    """Expected calibration error over ``bins`` equal ranges of the score."""

    def __init__(self, bins: int = 10):
        self.bins = bins

    def init(self):
        return np.zeros((3, self.bins))  # rows, truths, scores

    def update(self, state, truth, score):
        b = np.clip(np.floor(score * self.bins), 0, self.bins - 1).astype(int)
        return state + [np.bincount(b, w, self.bins) for w in (np.ones(len(b)), truth, score)]

    def merge(self, a, b):
        return a + b

    def finish(self, state):
        n = state[0].sum()
        return float(np.abs(state[1] - state[2]).sum() / n) if n else None


#: Metrics by name; :func:`register_metric` adds to it.
METRICS: dict[str, UserMetric] = {"brier": Brier(), "log_loss": LogLoss(), "ece": CalibrationError()}


def register_metric(name: str, metric: UserMetric) -> None:
    METRICS[name] = metric


def user_metrics(pred: DataFrame, metrics: Sequence[str] | Mapping[str, UserMetric], keys: Sequence[str] = (),
                 score: str = "score", truth: str = "truth") -> DataFrame:
    """One row for each value of ``keys`` (null is a value) with one double for
    each metric, given by name or as objects.  Rows whose score or truth is null
    don't count.  Without keys there is always one row."""
    import pyarrow as pa

    own = dict(metrics) if isinstance(metrics, Mapping) else {m: METRICS[m] for m in metrics}
    keys = list(keys)
    rows = pred.where(F.col(score).isNotNull() & F.col(truth).isNotNull()).select(
        *keys, F.col(truth).cast("double").alias("_truth"), F.col(score).cast("double").alias("_score"))
    key_fields = [rows.schema[k] for k in keys]
    sent = T.StructType([*key_fields, T.StructField("_part", T.IntegerType()), T.StructField("_state", T.BinaryType())])
    out = T.StructType([*key_fields, *[T.StructField(m, T.DoubleType()) for m in own]])

    def partial(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[tuple, list] = {} if keys else {(): [m.init() for m in own.values()]}
        types = None

        def flush():
            columns = [pa.array([k[i] for k in held], t) for i, t in enumerate(types or [])]
            states = pa.array([pickle.dumps(s) for s in held.values()], pa.binary())
            return pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(held), pa.int32()), states], names=sent.names)

        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            t, s = batch.column("_truth").to_numpy(), batch.column("_score").to_numpy()
            groups: dict[tuple, list[int]] = {}
            if keys:
                for i, k in enumerate(zip(*(batch.column(k).to_pylist() for k in keys))):
                    groups.setdefault(k, []).append(i)
            else:
                groups[()] = slice(None)
            for k, at in groups.items():
                states = held.get(k) or [m.init() for m in own.values()]
                held[k] = [m.update(x, t[at], s[at]) for m, x in zip(own.values(), states)]
            if len(held) > _HELD:
                yield flush()
                held.clear()
        if held and (types is not None or not keys):
            yield flush()

    def merged(table: pa.Table) -> list:
        table = table.sort_by([("_part", "ascending")])
        states = [pickle.loads(s) for s in table["_state"].to_pylist()]
        total = states[0]
        for s in states[1:]:
            total = [m.merge(a, b) for m, a, b in zip(own.values(), total, s)]
        return total

    def some(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).select([*keys, "_part"])
        return first.append_column("_state", pa.array([pickle.dumps(merged(table))], pa.binary()))

    def last(table: pa.Table) -> pa.Table:
        got = [m.finish(s) for m, s in zip(own.values(), merged(table))]
        result = table.slice(0, 1).select(keys)
        for name, value in zip(own, got):
            result = result.append_column(name, pa.array([value], pa.float64()))
        return result

    states = rows.mapInArrow(partial, sent)
    fan = F.floor(F.col("_part") / _FAN)
    return states.groupBy(*keys, fan).applyInArrow(lambda t: some(t), sent).groupBy(*keys).applyInArrow(lambda t: last(t), out)
