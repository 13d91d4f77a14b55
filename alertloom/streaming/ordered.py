"""Keyed streams in event order: rows wait in state until the watermark has passed them, then go through a vectorized step.

Late rows that the watermark still allows therefore take their place in the order, and a stream gives what the batch
operator gives, whatever the order of arrival. Each stream is in append mode and can feed the next one; the operators
use arbitrary state with event-time timers, which needs the RocksDB state store (`use_rocksdb`)."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from alertloom import fixed
from alertloom.functions import columns as C
from alertloom.operators.models import LinearScorer
from alertloom.session import ship_package

#: Event time of a row in microseconds, whatever the session's time zone.
TIME = "__us"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def with_event_time(df: DataFrame, delay: str | None, ts: str = "ts") -> DataFrame:
    """Event time and a watermark; a stream that has them already, from the operator before, keeps its own (`delay` None)."""
    return df if delay is None else df.withColumn("event_time", F.timestamp_seconds(F.col(ts))).withWatermark("event_time", delay)


def packed(rows: pd.DataFrame) -> bytes:
    """A key's few rows as bytes; a pickle takes a fraction of the time of an Arrow stream of them and keeps the types."""
    return pickle.dumps(rows, protocol=5)


def unpacked(data: bytes) -> pd.DataFrame:
    return pickle.loads(data)


def in_order(rows: pd.DataFrame, order: Sequence[str]) -> pd.DataFrame:
    """Stable sort with missing values last. Numbers are sorted by numpy, as sort_values costs much for the few rows of a key."""
    keys = [rows[c] for c in order]
    if all(isinstance(k.dtype, np.dtype) and k.dtype.kind in "iuf" for k in keys):
        return rows.take(np.lexsort([k.to_numpy() for k in reversed(keys)]))
    return rows.sort_values(list(order), kind="stable")


class InOrder(StatefulProcessor):
    """Keeps the rows of a key that are not older than the watermark and hands over the others in order.

    A subclass gives `order` (columns), `columns` (of the rows it needs), `carry` (the schema of what it remembers) and
    `advance(key, carry, ready, upto)`: ready rows in order, `upto` the watermark in microseconds; it returns the new
    carry (None: forget the key), the rows to emit (or None) and when, in event-time microseconds, to be called again without rows (or None)."""

    order: Sequence[str]
    columns: Sequence[str]
    carry: str

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", f"pending binary, timer bigint, {self.carry}")

    def handleInputRows(self, key, rows, timerValues):
        yield from self.turn(key, list(rows), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self.turn(key, [], timerValues)

    def close(self) -> None:
        pass

    def turn(self, key, fresh: list[pd.DataFrame], clock):
        pending, timer, *carry = self.kept.get() if self.kept.exists() else (None, None, *[None] * len(self.carry.split(",")))
        wanted = [TIME, *self.columns]
        places = [self.names.index(c) for c in wanted]
        frames = [f.iloc[:, places].set_axis(wanted, axis=1) for f in fresh if len(f)]
        if pending is not None:
            frames.insert(0, unpacked(pending))
        rows = None if not frames else frames[0].reset_index(drop=True) if len(frames) == 1 else pd.concat(frames, ignore_index=True)
        upto = clock.getCurrentWatermarkInMs() * 1000
        if rows is None:
            ready, waiting = pd.DataFrame(columns=wanted), None
        else:
            due = rows[TIME].to_numpy() <= upto
            ready, waiting = (in_order(rows, self.order), None) if due.all() else (in_order(rows[due], self.order), rows[~due]) if due.any() else (rows.iloc[:0], rows)
        carry, out, wake = self.advance(key, carry, ready, upto)
        times = [int(waiting[TIME].min())] if waiting is not None and len(waiting) else []
        times += [wake] if wake is not None else []
        due_ms = -(-min(times) // 1000) if times else None
        if due_ms is not None:
            due_ms = max(due_ms, upto // 1000 + 1)
        if timer is not None and timer != due_ms:
            if timer > clock.getCurrentWatermarkInMs():
                self.handle.deleteTimer(timer)
        if due_ms is not None and due_ms != timer:
            self.handle.registerTimer(due_ms)
        if carry is None and due_ms is None:
            self.kept.clear()
        else:
            keep = packed(waiting) if waiting is not None and len(waiting) else None
            self.kept.update((keep, due_ms, *(carry if carry is not None else [None] * len(self.carry.split(",")))))
        if out is not None and len(out):
            yield out

    def advance(self, key, carry: list, ready: pd.DataFrame, upto: int):
        raise NotImplementedError


def run_in_order(rows: DataFrame, keys: Sequence[str], step: InOrder, schema: str, event_time: str = "") -> DataFrame:
    """The step over each key. `event_time` names the column of the result, if any, that the next stateful operator goes by."""
    ship_package(rows.sparkSession)
    use_rocksdb(rows.sparkSession)
    rows = rows.withColumn(TIME, F.unix_micros("event_time"))
    step.names = rows.columns  # the frames' own names are lost where the optimizer has merged expressions
    return rows.groupBy(*keys).transformWithStateInPandas(step, schema, "append", "EventTime", eventTimeColumnName=event_time)


class Stitcher(InOrder):
    """Session of each request of a client: a pause of over `gap_s` seconds starts a new one. Remembers the start of the session and the
    time of the last request, until the pause is over."""

    order, carry = ("ts", "line_id"), "last double, start double"

    def __init__(self, gap_s: float, columns: Sequence[str]):
        self.gap_s, self.columns = float(gap_s), ["event_time", *columns]

    def advance(self, key, carry, ready, upto):
        last, start = carry
        if len(ready):
            ts = ready["ts"].to_numpy(dtype=float)
            before = np.r_[np.nan if last is None else last, ts[:-1]]
            is_new = np.isnan(before) | (ts - before > self.gap_s)
            begun = pd.Series(np.where(is_new, ts, np.nan)).ffill().fillna(0.0 if start is None else start).to_numpy()
            names = {b: hashlib.sha1("|".join([*[k for k in key if k is not None], f"{b:.0f}"]).encode()).hexdigest()[:24] for b in set(begun.tolist())}
            gone = np.floor(np.maximum(ts - np.where(is_new, ts, before), 0.0) * 1000)
            added = {"src_ip": key[0], "uah": key[1], "session_id": [names[b] for b in begun.tolist()], "is_new_session": is_new, "delta_ms": pd.array(np.where(is_new, None, gone), dtype="Int64")}
            out = pd.DataFrame({**{c: ready[c] for c in self.columns}, **added}, index=ready.index)
            last, start = float(ts[-1]), float(begun[-1])
        else:
            out = None
        if last is None:
            return None, out, None
        over = int((last + self.gap_s) * 1e6) + 1
        return (None, out, None) if upto > over else ([last, start], out, over + 1)


def stitch_stream(requests: DataFrame, gap_s: float = fixed.SESSION_GAP_S, delay: str | None = "10 minutes") -> DataFrame:
    """Per-request sessions of a live log, as `web.stitch_sessions` gives them: the rows with uah, session_id,
    is_new_session and delta_ms. A request comes out once the watermark has passed it, so late ones within `delay`
    are in their place. A client's state is dropped after the pause. requests: line_id, ts, src_ip, ua and any others."""
    rows = with_event_time(requests, delay).withColumn("uah", C.ua_hash(F.col("ua")))
    others = [c for c in rows.columns if c not in ("event_time", "src_ip", "uah")]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ["event_time", *others, "src_ip", "uah"]) + ", session_id string, is_new_session boolean, delta_ms bigint"
    return run_in_order(rows.select("event_time", *others, "src_ip", "uah"), ["src_ip", "uah"], Stitcher(gap_s, others), schema, "event_time")


PREFIX_FEATURES = ["log_n", "log_delta_mean", "log_delta_std", "frac_4xx", "frac_5xx", "log_duration_ms"]


def prefix_vectors(n, sum_d, sum_d2, n_d, c4, c5, t0, t1) -> np.ndarray:
    """Session features of the requests seen so far, one row per tick, from running totals."""
    some = np.maximum(n_d, 1)
    mean = sum_d / some
    var = np.maximum(0.0, sum_d2 / some - mean * mean)
    return np.stack([np.log1p(n), np.log1p(np.maximum(mean, 0.0)), np.log1p(np.sqrt(var)), c4 / n, c5 / n, np.log1p(np.maximum(0.0, (t1 - t0) * 1000.0))], axis=1)


def probability(scorer: LinearScorer, vectors: np.ndarray, names: Sequence[str]) -> np.ndarray:
    place = [list(names).index(c) for c in scorer.cols]
    z = scorer.intercept + vectors[:, place] @ np.asarray(scorer.coef, dtype=float)
    return 1.0 / (1.0 + np.exp(-np.clip(z, -700.0, 700.0)))


def run_lengths(hits: np.ndarray, before: int) -> np.ndarray:
    """How many hits in a row there are at each place, counting `before` that came earlier."""
    place = np.arange(1, len(hits) + 1)
    miss = np.maximum.accumulate(np.where(hits, 0, place))
    return np.where(hits, place - miss + np.where(miss == 0, before, 0), 0)


class SessionAlerter(InOrder):
    """Flags a session after `k` ticks in a row reach the threshold; a tick comes every `every` requests and once more when the session
    has been silent for `idle` seconds."""

    order, columns = ("ts", "line_id"), ("ts", "line_id", "status", "delta_ms")
    carry = "n bigint, sum_d double, sum_d2 double, n_d bigint, c4 bigint, c5 bigint, t0 double, t1 double, run bigint, done boolean"

    def __init__(self, scorer: LinearScorer, tau: float, every: int, k: int, idle: float):
        self.scorer, self.tau, self.every, self.k, self.idle = scorer, tau, every, k, idle

    def flags(self, totals: np.ndarray, run: int) -> np.ndarray:
        return run_lengths(probability(self.scorer, prefix_vectors(*totals), PREFIX_FEATURES) >= self.tau, run)

    def advance(self, key, carry, ready, upto):
        if carry[0] is None:
            carry = [0, 0.0, 0.0, 0, 0, 0, float(ready["ts"].iloc[0]) if len(ready) else 0.0, 0.0, 0, False]
        *total, run, done = carry
        found = []
        if len(ready) and not done:
            d = pd.to_numeric(ready["delta_ms"]).to_numpy(dtype=float, na_value=np.nan)
            status, ts = ready["status"].fillna(0).to_numpy(dtype=float), ready["ts"].to_numpy(dtype=float)
            known, d = ~np.isnan(d), np.nan_to_num(d)
            steps = [np.ones(len(ready)), d, d * d, known, (status >= 400) & (status < 500), (status >= 500) & (status < 600)]
            sums = [was + np.cumsum(s) for was, s in zip(total, steps)]
            all_totals = np.stack([*sums, np.full(len(ready), total[6]), ts])
            at = np.flatnonzero(sums[0] % self.every == 0)
            if len(at):
                runs = self.flags(all_totals[:, at], run)
                hit = np.flatnonzero(runs >= self.k)
                if len(hit):
                    done = True
                    n, *_, t0, t1 = all_totals[:, at[hit[0]]]
                    found.append((int(n), t1 - t0))
                run = int(runs[-1])
            total = all_totals[:, -1].tolist()
        elif len(ready):
            total[0], total[7] = total[0] + len(ready), float(ready["ts"].iloc[-1])
        over = int((total[7] + self.idle) * 1e6) + 1
        if total[0] and upto > over:
            if not done and total[0] % self.every:
                if self.flags(np.asarray(total, dtype=float)[:, None], run)[-1] >= self.k:
                    found.append((int(total[0]), total[7] - total[6]))
            carry, wake = None, None
        else:
            carry = [int(total[0]), total[1], total[2], int(total[3]), int(total[4]), int(total[5]), total[6], total[7], int(run), bool(done)]
            wake = over + 1
        out = pd.DataFrame([(key[0], *f) for f in found], columns=["session_id", "seen", "flag_after_s"])
        return carry, out, wake


def alert_sessions(requests: DataFrame, scorer: LinearScorer, tau: float, every: int = 5, k: int = 2, idle: float = fixed.SESSION_GAP_S, delay: str | None = "10 minutes") -> DataFrame:
    """Sessions flagged after `k` ticks in a row, in event order: session_id, seen, flag_after_s. The scorer works on PREFIX_FEATURES.
    requests: session_id, ts, line_id, status, delta_ms, as `stitch_stream` gives them (then with delay None)."""
    rows = with_event_time(requests, delay).select("event_time", "session_id", *SessionAlerter.columns)
    return run_in_order(rows, ["session_id"], SessionAlerter(scorer, tau, every, k, idle), "session_id string, seen bigint, flag_after_s double")


def window_vectors(codes: np.ndarray, targets: np.ndarray, ts: np.ndarray, depth: np.ndarray, ai: np.ndarray, there: np.ndarray, actions: Sequence[str]) -> tuple[np.ndarray, list[str]]:
    """Window features of many windows at once: matrices [window, place] with the newest event last; `there` marks places that hold an event,
    code -1 an action that is none of `actions`, target code -1 no target."""
    n = there.sum(1)
    gaps = np.where(there[:, 1:] & there[:, :-1], np.diff(ts, axis=1), np.nan)
    some = (n > 1)[:, None]
    gaps = np.where(some, gaps, 0.0)
    first = ts[np.arange(len(ts)), there.argmax(1)]
    ordered = np.sort(np.where(there, targets, -1), axis=1)
    distinct = ((ordered[:, 1:] != ordered[:, :-1]) & (ordered[:, 1:] >= 0)).sum(1) + (ordered[:, 0] >= 0)
    filled = lambda x, empty: np.where(there, np.nan_to_num(x), empty)
    out = {
        "dt_mean": np.nanmean(gaps, axis=1), "dt_median": np.nanmedian(gaps, axis=1), "dt_std": np.nanstd(gaps, axis=1),
        "events_per_sec": n / (ts[:, -1] - first + 1e-6), "distinct_targets": distinct.astype(float), "target_churn": distinct / n,
        "depth_max": filled(depth, -np.inf).max(1), "depth_mean": filled(depth, 0.0).sum(1) / n,
        "ai_artifact_mean": filled(ai, 0.0).sum(1) / n, "ai_artifact_max": filled(ai, -np.inf).max(1),
    }
    codes = np.where(there, codes, -1)
    pairs = np.where((codes[:, 1:] >= 0) & (codes[:, :-1] >= 0), codes[:, :-1] * len(actions) + codes[:, 1:], -1)
    for i, a in enumerate(actions):
        out[f"act_{a}"] = (codes == i).sum(1) / n
        for j, b in enumerate(actions):
            out[f"seq_{a}_{b}"] = (pairs == i * len(actions) + j).sum(1) / np.maximum(n - 1, 1)
    return np.stack(list(out.values()), axis=1), list(out)


class CampaignAlerter(InOrder):
    """First alert of a campaign: the last `size` events are scored after every `stride` events, once half a window is there."""

    order, columns = ("ts", "event_id"), ("ts", "event_id", "action", "target", "depth", "artifact_ai")
    carry = "recent binary, seen bigint, alerted boolean, latest double"

    def __init__(self, scorer: LinearScorer, tau: float, actions: Sequence[str], size: int, stride: int, idle_s: float):
        self.scorer, self.tau, self.actions, self.size, self.stride, self.idle_s = scorer, tau, list(actions), size, stride, idle_s

    def advance(self, key, carry, ready, upto):
        recent, seen, alerted, latest = carry
        seen, alerted, out = seen or 0, bool(alerted), None
        if len(ready):
            latest = float(ready["ts"].iloc[-1])
            if not alerted:
                kept = unpacked(recent) if recent is not None else ready.iloc[:0]
                rows = pd.concat([kept, ready], ignore_index=True) if len(kept) else ready.reset_index(drop=True)
                seen, out = seen + len(ready), self.score(key, rows, seen - len(kept), len(kept))
                alerted = out is not None
                recent = None if alerted else packed(rows.iloc[-(self.size - 1):])
        if latest is None:
            return None, out, None
        over = int((latest + self.idle_s) * 1e6) + 1
        return (None, out, None) if upto > over else ([recent, int(seen), alerted, latest], out, over + 1)

    def score(self, key, rows: pd.DataFrame, before: int, old: int) -> pd.DataFrame | None:
        """The first tick that reaches the threshold. rows: `old` kept events, whose ticks have been scored, then new ones; `before`
        events came ahead of them all."""
        number = np.arange(before + 1, before + len(rows) + 1)
        ticks = np.flatnonzero((number % self.stride == 0) & (number >= self.size // 2) & (np.arange(len(rows)) >= old))
        if not len(ticks):
            return None
        codes = pd.Categorical(rows["action"], categories=self.actions).codes.astype(np.int64)
        targets = pd.factorize(rows["target"])[0]
        number_of = lambda c: pd.to_numeric(rows[c]).to_numpy(dtype=float, na_value=np.nan)
        place = ticks[:, None] + np.arange(1 - self.size, 1)
        there = place >= 0
        take = lambda x: x[np.maximum(place, 0)]
        vectors, names = window_vectors(take(codes), take(targets), take(number_of("ts")), take(number_of("depth")), take(number_of("artifact_ai")), there, self.actions)
        risk = probability(self.scorer, vectors, names)
        hit = np.flatnonzero(risk >= self.tau)
        if not len(hit):
            return None
        at = ticks[hit[0]]
        return pd.DataFrame({"campaign_id": [key[0]], "ts": [float(rows["ts"].iloc[at])], "risk": [float(risk[hit[0]])], "events_seen": [int(number[at])]})


def alert_campaigns(
    events: DataFrame, scorer: LinearScorer, tau: float, actions: Sequence[str] = fixed.ACTIONS, size: int = fixed.WINDOW_EVENTS,
    stride: int = fixed.WINDOW_STRIDE, idle: str = "30 days", delay: str | None = "1 day",
) -> DataFrame:
    """First alert of each campaign in event order: campaign_id, ts, risk, events_seen. Events wait until the watermark has passed
    them, so late ones within `delay` are in their place. A campaign alerts once; its state is dropped when it has been silent for
    `idle` of event time, and one that comes back after that starts anew."""
    step = CampaignAlerter(scorer, tau, actions, size, stride, pd.Timedelta(idle).total_seconds())
    rows = with_event_time(events, delay).select("event_time", "campaign_id", *step.columns)
    return run_in_order(rows, ["campaign_id"], step, "campaign_id string, ts double, risk double, events_seen bigint")


class PaneTotals(InOrder):
    """Trailing totals from panes. A total changes when a pane ends and when it has been in for the whole window; each change is a row."""

    order, carry = (TIME,), "ends binary, totals binary"

    def __init__(self, keys: Sequence[str], window_us: int, sums: Sequence[str]):
        self.keys, self.window_us, self.columns = list(keys), window_us, ["n", *[f"sum_{c}" for c in sums]]

    def advance(self, key, carry, ready, upto):
        width = len(self.columns)
        held = np.frombuffer(carry[0], np.int64) if carry[0] else np.empty(0, np.int64)
        totals = np.frombuffer(carry[1], np.int64).reshape(-1, width) if carry[1] else np.empty((0, width), np.int64)
        now = totals.sum(0)
        fresh = ready[TIME].to_numpy(dtype=np.int64) + 1 if len(ready) else np.empty(0, np.int64)
        made = ready[self.columns].fillna(0).to_numpy(dtype=np.int64).reshape(-1, width)
        ends, totals = np.r_[held, fresh], np.concatenate([totals, made])
        gone = ends + self.window_us <= upto
        times = np.r_[fresh, ends[gone] + self.window_us]
        changes = np.concatenate([made, -totals[gone]])
        out = None
        if len(times):
            at, place = np.unique(times, return_inverse=True)
            moved = np.zeros((len(at), width), np.int64)
            np.add.at(moved, place, changes)
            value = now + np.cumsum(moved, axis=0)
            out = pd.DataFrame({"window_end": at / 1e6, **dict(zip(self.keys, key)), **{c: value[:, i] for i, c in enumerate(self.columns)}})
        ends, totals = ends[~gone], totals[~gone]
        if not len(ends):
            return None, out, None
        return [ends.tobytes(), np.ascontiguousarray(totals).tobytes()], out, int(ends.min()) + self.window_us


def trailing_rates(rows: DataFrame, keys: Sequence[str], window: str = "60 seconds", slide: str = "2 seconds", delay: str = "10 seconds", sums: Sequence[str] = ()) -> DataFrame:
    """Counts and whole-number sums per key over a trailing window, in append mode: window_end, keys, n and sum_<column>.

    Rows are summed once, in tumbling panes of `slide`; the panes of a key are kept as long as the window, and a row comes out
    at each pane end at which the totals change, the last of them (n = 0) when nothing is left. The totals of any pane end are those of the
    latest row at or before it. Input rows are never copied, whatever window and slide are."""
    spans = [pd.Timedelta(x).value // 1000 for x in (window, slide)]
    if spans[0] % spans[1]:
        raise ValueError(f"{window} is no multiple of {slide}")
    pane = F.window("event_time", slide).alias("w")
    panes = with_event_time(rows, delay).groupBy(pane, *keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).cast("long").alias(f"sum_{c}") for c in sums])
    panes = panes.select(F.window_time("w").alias("event_time"), *keys, "n", *[f"sum_{c}" for c in sums])
    kinds = {f.name: f.dataType.simpleString() for f in panes.schema.fields}
    schema = "window_end double, " + ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n bigint" + "".join(f", sum_{c} bigint" for c in sums)
    return run_in_order(panes, keys, PaneTotals(keys, spans[0], sums), schema)
