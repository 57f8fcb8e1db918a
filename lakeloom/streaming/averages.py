"""Online averages as stateful streams: EWMA with a time to live, and means of windows published into an EWMA.

State is a few numbers for each key. Rows of a batch are folded in order of time, then value; across batches they come in the
order of batches, and a row older than the state counts at the state's time. A silent key's state goes once the watermark
has passed it by twice its time to live.

Published means: a window closes with the first sample that makes it both long enough and full enough; its mean is one step of
the EWMA, and the next window begins there. A window that outlives the time to live without closing is given up, and begins
anew with the sample that found it so. Silence beyond the time to live ends the window and the EWMA. A mean freezes with
the first sample that comes `freeze_after_ms` or more after the first of all, if it has a mean by then; from then on it doesn't change
(and its state stays, silent or not).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import astuple, dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class MeanConfig:
    """Publication rules of windowed means; times in milliseconds."""

    # Defaults of the model.
    alpha: float = 0.2
    ttl_ms: float = 10_000.0
    interval_ms: float = 1_000.0
    min_samples: int = 100
    freeze_after_ms: float = 0.0

    def __post_init__(self) -> None:
        if not 0 < self.alpha <= 1 or self.ttl_ms < self.interval_ms or self.min_samples < 1:
            raise ValueError("alpha must lie in (0, 1], the time to live must not be below the interval, and samples are needed")


@dataclass
class PublishedMean:
    """One key's mean. Times are NaN where there is nothing yet: no mean, no window, no sample."""

    mean: float = float("nan")
    at: float = float("nan")  # last publication
    samples: int = 0  # in published windows
    origin: float = float("nan")  # first sample since the last silence
    latest: float = float("nan")  # last sample
    begin: float = float("nan")  # of the open window
    total: float = 0.0
    pending: int = 0
    frozen: bool = False

    def usable(self, now: float, config: MeanConfig) -> bool:
        return self.frozen or 0 <= now - self.at <= config.ttl_ms

    def _open(self, at: float) -> None:
        self.begin, self.total, self.pending = at, 0.0, 0

    def _publish(self, at: float, config: MeanConfig) -> None:
        value, a = self.total / self.pending, config.alpha
        self.mean = (1 - a) * self.mean + a * value if self.usable(at, config) else value
        self.samples += self.pending
        self.at = at
        self._open(at)

    def _take(self, values: np.ndarray) -> None:
        self.total += float(values.sum())
        self.pending += len(values)

    def _stretch(self, t: np.ndarray, v: np.ndarray, config: MeanConfig) -> None:
        """Samples without a silence between them. Each round goes to the sample at which something happens next."""
        done = 0
        cold = int(np.searchsorted(t, self.origin + config.freeze_after_ms)) if config.freeze_after_ms > 0 else len(t)
        while done < len(t):
            given_up = int(np.searchsorted(t, self.begin + config.ttl_ms, side="right"))
            closed = max(int(np.searchsorted(t, self.begin + config.interval_ms)), done + config.min_samples - self.pending - 1, done)
            frozen = max(cold, done)
            if frozen < len(t) and not self.usable(t[frozen], config):
                frozen = len(t)
            at = min(given_up, closed, frozen, len(t))
            self._take(v[done:at])
            done = at
            if at == len(t):
                return
            if at == given_up:
                self._open(t[at])
                continue
            if at == closed:
                self._take(v[at : at + 1])
                self._publish(t[at], config)
                done = at + 1
            if at >= cold:
                self.frozen = True
                return

    def observe(self, times: Sequence[float], values: Sequence[float], config: MeanConfig) -> PublishedMean:
        """Folds in samples that are sorted by time."""
        t, v = np.asarray(times, dtype=np.float64), np.asarray(values, dtype=np.float64)
        if self.frozen or not len(t):
            return self
        t = np.maximum.accumulate(t if np.isnan(self.latest) else np.maximum(t, self.latest))
        gap = np.diff(t, prepend=self.latest)
        cuts = np.flatnonzero(~(gap <= config.ttl_ms))  # NaN: the first sample of all
        for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(t)]])):
            if self.frozen:
                break
            if a in cuts:
                self.at, self.origin, self.samples = float("nan"), t[a], 0
                self._open(t[a])
            if a < b:
                self._stretch(t[a:b], v[a:b], config)
                self.latest = float(t[b - 1])
        return self


def ewma_step(state: tuple[float, float, int] | None, t: float, value: float, alpha: float, ttl_ms: float) -> tuple[float, float, int]:
    """(mean, time, samples) after a sample: the first, or one past the time to live, starts anew."""
    if state is not None and t >= state[1] and t - state[1] <= ttl_ms:
        return (1 - alpha) * state[0] + alpha * value, t, state[2] + 1
    return value, t, (state[2] if state else 0) + 1


def _usable_rows(parts: Iterator[pd.DataFrame], ts_ms: str, value: str) -> pd.DataFrame:
    rows = pd.concat(list(parts))[[ts_ms, value]].astype(float)
    rows = rows[np.isfinite(rows[value]) & (rows[value] >= 0) & np.isfinite(rows[ts_ms])]
    return rows.sort_values([ts_ms, value], kind="stable")


def _with_event_time(events: DataFrame, ts_ms: str, lateness: str) -> DataFrame:
    return events.withColumn("_event", F.timestamp_millis(F.col(ts_ms).cast("bigint"))).withWatermark("_event", lateness)


def ewma_stream(events: DataFrame, by: Sequence[str], ts_ms: str, value: str, alpha: float = 0.2, ttl_ms: float = 60_000.0, lateness: str = "10 seconds") -> DataFrame:
    """(by..., ewma, updated_ms, samples, first_ms): a key's state after each batch that has rows of it. Values that aren't finite or
    are below 0 are skipped. first_ms: when the key's present state began."""
    kinds = ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in by)

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s, first = (tuple(state.get)[:3], state.get[3]) if state.exists else (None, None)
        rows = _usable_rows(parts, ts_ms, value)
        for t, v in zip(rows[ts_ms], rows[value]):
            first = t if first is None else first
            s = ewma_step(s, max(t, s[1]) if s else t, v, alpha, ttl_ms)
        if s is not None:
            state.update((float(s[0]), float(s[1]), int(s[2]), float(first)))
            state.setTimeoutTimestamp(max(int(s[1] + 2 * ttl_ms), state.getCurrentWatermarkMs() + 1))
            yield pd.DataFrame([[*key, float(s[0]), float(s[1]), int(s[2]), float(first)]], columns=[*by, "ewma", "updated_ms", "samples", "first_ms"])

    schema = f"{kinds}, ewma double, updated_ms double, samples bigint, first_ms double"
    return _with_event_time(events, ts_ms, lateness).groupBy(*by).applyInPandasWithState(fold, schema, "mean double, at double, samples bigint, first double", "update", GroupStateTimeout.EventTimeTimeout)


def within_capacity(estimates: DataFrame, capacity: int, first: str = "first_ms", *ties: str) -> DataFrame:
    """The `capacity` estimates that came last into being: the oldest go first, however recently they were updated."""
    return estimates.orderBy(F.desc(first), *ties).limit(capacity)


def with_fallback(wanted: DataFrame, estimates: DataFrame, key: Sequence[str], kind: str, value: str = "ewma") -> DataFrame:
    """wanted with `estimate`: that of the whole key, else the mean of its kind's estimates, weighted by samples, else null."""
    exact = estimates.select(*key, F.col(value).alias("_exact"))
    by_kind = estimates.groupBy(kind).agg((F.sum(F.col(value) * F.col("samples")) / F.sum("samples")).alias("_kind"))
    return wanted.join(exact, list(key), "left").join(by_kind, kind, "left").select(*wanted.columns, F.coalesce("_exact", "_kind").alias("estimate"))


def mean_stream(events: DataFrame, by: Sequence[str], ts_ms: str, value: str, config: MeanConfig | None = None, lateness: str = "10 seconds") -> DataFrame:
    """(by..., mean, samples, published_ms, frozen): published means of keys that have one, after each batch with rows of them."""
    config = config or MeanConfig()
    kinds = ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in by)

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = _usable_rows(parts, ts_ms, value)
        s = (PublishedMean(*state.get) if state.exists else PublishedMean()).observe(rows[ts_ms], rows[value], config)
        if np.isnan(s.latest):
            return
        state.update(tuple(f(x) for f, x in zip((float, float, int, float, float, float, float, int, bool), astuple(s))))
        if not s.frozen:
            state.setTimeoutTimestamp(max(int(s.latest + 2 * config.ttl_ms), state.getCurrentWatermarkMs() + 1))
        if s.usable(s.latest, config):
            yield pd.DataFrame([[*key, float(s.mean), int(s.samples), float(s.at), bool(s.frozen)]], columns=[*by, "mean", "samples", "published_ms", "frozen"])

    schema = f"{kinds}, mean double, samples bigint, published_ms double, frozen boolean"
    types = {"float": "double", "int": "bigint", "bool": "boolean"}
    kept = ", ".join(f"{f.name} {types[f.type]}" for f in fields(PublishedMean))
    return _with_event_time(events, ts_ms, lateness).groupBy(*by).applyInPandasWithState(fold, schema, kept, "update", GroupStateTimeout.EventTimeTimeout)
