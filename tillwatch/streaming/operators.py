"""Structured Streaming forms of the operators.

Row-wise transforms (masking, payload parsing, keys, actions) and the diagnosis join take
streaming DataFrames as they are. What needs memory across batches is here. Sources must carry
event time as ``timestamp``; the RocksDB state store has to be configured (``build_session``).
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tillwatch import constants as K
from tillwatch.functions.policy import PolicyConfig
from tillwatch.functions.poisson import poisson_tail_value
from tillwatch.functions.timegrid import scoped_bank
from tillwatch.operators.detectors import ewma_step
from tillwatch.operators.diagnosis import diagnose


def epoch_us(moment: pd.Timestamp) -> int:
    return moment.value // 1000


# --- deduplication -------------------------------------------------------------------------


def drop_redeliveries(deliveries: DataFrame, lateness: str = "24 hours") -> DataFrame:
    """Cheap deduplication on ``event_id``; expiry follows the watermark, so it is approximate."""
    return deliveries.withWatermark("received_at", lateness).dropDuplicatesWithinWatermark(["event_id"])


#: Groups that ids are dealt over where one has little state. A call per group and batch costs far more than a row in it, so
#: many ids share a group; choose more if a group's live ids do not fit a task.
SHARDS = 256


def shard(key: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard")


def _micros(moments: pd.Series) -> list[int]:
    return moments.to_numpy("datetime64[us]").astype("int64").tolist()


class OneTimer:
    """The one timer of a key: the earliest moment at which its state has to be looked at again.

    A timer per row would call Python, and read and write the state, once per row when the watermark moves on.
    """

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "ms long")

    def at_latest(self, ms: int) -> None:
        """Look again at ``ms``, unless that is due earlier."""
        before = self.pending.get()
        if before is not None:
            if before[0] <= ms:
                return
            self.handle.deleteTimer(before[0])
        self.again(ms)

    def again(self, ms: int | None) -> None:
        """Once the timer has fired: the next moment, or none."""
        if ms is None:
            self.pending.clear()
            return
        self.handle.registerTimer(ms)
        self.pending.update((ms,))


def _kept(state: object, rows: list[tuple]) -> None:
    if rows:
        state.put(rows)
    else:
        state.clear()


class FirstSighting(StatefulProcessor):
    """Keeps one moment per id: when it was last let through. A key is a shard of ids, its state read and written as a whole."""

    def __init__(self, ttl_us: int) -> None:
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "event_id string, us long")
        self.timer = OneTimer(handle)

    def _over_ms(self, us: int) -> int:
        """When an id let through at ``us`` is forgotten, on a grid so that a shard is not searched for every single id."""
        step = max(1, self.ttl_us // 24)
        return -(-(us + self.ttl_us) // step) * step // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen, kept = dict(self.seen.get()), []
        batch = pd.concat(list(rows))
        for us, event_id in sorted(zip(_micros(batch["received_at"]), batch["event_id"], strict=True), key=lambda x: x[0]):
            kept_at = seen.get(event_id)
            if kept_at is None or us - kept_at >= self.ttl_us:
                seen[event_id] = us
                kept.append((event_id, _moment(us)))
        if kept:
            _kept(self.seen, list(seen.items()))
            self.timer.at_latest(self._over_ms(min(seen.values())))
            yield _frame(kept, SIGHTING_SCHEMA)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Forget the ids whose time to live is over."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        seen = [(event_id, us) for event_id, us in self.seen.get() if us + self.ttl_us > passed]
        _kept(self.seen, seen)
        self.timer.again(self._over_ms(min(us for _, us in seen)) if seen else None)
        return iter(())

    def close(self) -> None:
        pass


SIGHTING_SCHEMA = "event_id string, received_at timestamp"


def first_sightings(
    deliveries: DataFrame, ttl_seconds: int = K.DEDUP_TTL_SECONDS, lateness: str = "10 minutes", shards: int = SHARDS
) -> DataFrame:
    """Exact fixed time to live from the first sighting; duplicates do not extend it."""
    return (
        deliveries.select("event_id", "received_at", shard("event_id", shards)).withWatermark("received_at", lateness).groupBy("shard")
        .transformWithStateInPandas(FirstSighting(ttl_seconds * 1_000_000), SIGHTING_SCHEMA, "Append", "EventTime")
    )


# --- counts and bursts ---------------------------------------------------------------------


def tumbling_counts(failures: DataFrame, lateness: str = "30 minutes", width_seconds: int = K.BUCKET_SECONDS) -> DataFrame:
    """Counts per entity and closed bucket; a bucket is emitted once the watermark passes it."""
    timed = failures.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return (
        timed.withWatermark("created_at", lateness)
        .groupBy(
            F.window("created_at", f"{width_seconds} seconds"), "method",
            scoped_bank(F.col("method"), F.col("bank")).alias("bank"),
        )
        .agg(F.count("*").alias("n"))
        .select("method", "bank", F.window_time("window").alias("bucket_end"), F.col("window.start").alias("bucket_start"), "n")
    )


BURST_SCHEMA = "method string, bank string, bucket_start timestamp, bucket_end timestamp, n long, score double, is_burst boolean"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Rows under a schema of plain types, with its types also where there is no row."""
    fields = [part.split() for part in schema.split(", ")]
    kinds = {"timestamp": "datetime64[us]", "long": "Int64", "int": "Int32", "double": "float64", "boolean": "bool", "string": "object"}
    frame = pd.DataFrame(rows, columns=[name for name, _ in fields])
    return frame.astype({name: kinds[kind] for name, kind in fields})


def _moment(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us")


class BurstWatch(StatefulProcessor):
    """Scores each bucket of an entity against its trailing baseline once the watermark closes it.

    A count waits in state until an event-time timer fires at or after the end of its bucket, so counts may come in
    any order before that. An entity has one timer, for what comes first, and scores all that is closed when it fires. State is what waits, the last non-empty buckets within the history, and the moving
    moments. Empty buckets are read off the distance between bucket positions. When the history has
    passed without a failure, a detector that looks back over the history only forgets the entity.
    """

    def __init__(self, detector: str, origin_us: int, width_seconds: int) -> None:
        self.detector, self.width_us = detector, width_seconds * 1_000_000
        self.origin = origin_us // self.width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.timer = OneTimer(handle)
        self.waiting = handle.getValueState("waiting", "idx array<long>, n array<long>")
        self.recent = handle.getValueState("recent", "idx array<long>, n array<long>")
        self.moments = handle.getValueState("moments", "at long, mean double, variance double")

    def _poisson(self, idx: int, n: int, past: list[tuple[int, int]]) -> tuple[float, bool]:
        length = min(idx - self.origin, K.HISTORY_BUCKETS)
        if length < K.MIN_HISTORY:
            return 0.0, False
        rate = (sum(c for _, c in past) + 1.0) / (length + 1.0)
        tail = poisson_tail_value(n, rate)
        return -math.log(max(tail, 1e-300)), tail < K.P_THRESHOLD

    def _rolling(self, idx: int, n: int, past: list[tuple[int, int]]) -> tuple[float, bool]:
        length = min(idx - self.origin, K.HISTORY_BUCKETS)
        if length < K.MIN_HISTORY:
            return 0.0, False
        mean = sum(c for _, c in past) / length
        sd = math.sqrt(max(0.0, sum(c * c for _, c in past) / length - mean * mean))
        if sd < K.ZERO_SD:
            return n - mean, n > mean
        return (n - mean) / sd, (n - mean) / sd > K.Z_THRESHOLD

    def _ends_ms(self, idx: int) -> int:
        return -(-(idx + 1) * self.width_us // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        counts = dict(zip(*self.waiting.get(), strict=True)) if self.waiting.exists() else {}
        batch = pd.concat(list(rows))
        for us, n in zip(_micros(batch["bucket_start"]), batch["n"], strict=True):
            idx = us // self.width_us
            counts[idx] = counts.get(idx, 0) + int(n)
        self.waiting.update((list(counts), list(counts.values())))
        self.timer.at_latest(self._ends_ms(min(counts)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        closed = timerValues.getCurrentWatermarkInMs() * 1000 // self.width_us
        counts = dict(zip(*self.waiting.get(), strict=True)) if self.waiting.exists() else {}
        past = list(zip(*self.recent.get(), strict=True)) if self.recent.exists() else []
        at, mean, variance = self.moments.get() if self.moments.exists() else (self.origin, 0.0, 0.0)
        out = []
        for idx in sorted(i for i in counts if i < closed):
            n = counts.pop(idx)
            past = [(i, c) for i, c in past if i >= idx - K.HISTORY_BUCKETS]
            if self.detector == "fixed_threshold":
                score, burst = float(n), n > K.FIXED_THRESHOLD
            elif self.detector == "poisson_surprise":
                score, burst = self._poisson(idx, n, past)
            elif self.detector == "rolling_zscore":
                score, burst = self._rolling(idx, n, past)
            else:
                base, spread, mean, variance = ewma_step(mean, variance, float(n), idx - at, K.EWMA_ALPHA)
                at, sd = idx + 1, math.sqrt(spread)
                score = (n - base) if sd < K.ZERO_SD else (n - base) / sd
                burst = n > base if sd < K.ZERO_SD else score > K.Z_THRESHOLD
                if idx - self.origin < K.MIN_HISTORY:
                    score, burst = 0.0, False
            past.append((idx, n))
            start = idx * self.width_us
            out.append((key[0], key[1], _moment(start), _moment(start + self.width_us - 1), n, float(score), bool(burst)))
        past = [(i, c) for i, c in past if i >= closed - K.HISTORY_BUCKETS]
        for state, columns in ((self.waiting, list(counts.items())), (self.recent, past)):
            if columns:
                state.update(tuple(map(list, zip(*columns))))
            else:
                state.clear()
        if self.detector == "ewma_zscore":
            self.moments.update((int(at), float(mean), float(variance)))
        due = [min(counts)] if counts else []
        due += [past[-1][0] + K.HISTORY_BUCKETS] if past else []
        self.timer.again(self._ends_ms(min(due)) if due else None)
        yield _frame(out, BURST_SCHEMA)

    def close(self) -> None:
        pass


def watch_bursts(
    counts: DataFrame, origin_us: int, detector: str = "poisson_surprise", width_seconds: int = K.BUCKET_SECONDS
) -> DataFrame:
    """Burst calls at bucket close over counts with a watermark on ``bucket_end``, such as ``tumbling_counts``.

    The watermark goes on with ``bucket_end`` to the next stateful operator.
    """
    return counts.groupBy("method", "bank").transformWithStateInPandas(
        BurstWatch(detector, origin_us, width_seconds), BURST_SCHEMA, "Append", "EventTime", eventTimeColumnName="bucket_end"
    )


INCIDENT_SCHEMA = (
    "method string, bank string, detector string, incident_no long, start timestamp, end timestamp, n_buckets long, "
    "total_count long, peak_score double"
)


class IncidentWatch(StatefulProcessor):
    """One automaton per entity: a burst opens an incident, further bursts within the gap extend it, and a timer ends it.

    Quiet buckets after a burst are kept apart and count only if the next burst comes within the gap. The timer
    stands where the last bucket that could still extend the incident is closed; it emits the incident once.
    """

    def __init__(self, detector: str, max_gap: int, width_seconds: int) -> None:
        self.detector, self.max_gap, self.width_us = detector, max_gap, width_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.timer = OneTimer(handle)
        self.open = handle.getValueState("open", "first long, last long, total long, peak double, quiet long, quiet_peak double")
        self.number = handle.getValueState("number", "closed long")

    def _emitted(self, key, first: int, last: int, total: int, peak: float) -> tuple:
        number = (self.number.get()[0] if self.number.exists() else 0) + 1
        self.number.update((number,))
        start, end = first * self.width_us, (last + 1) * self.width_us
        return key[0], key[1], self.detector, number, _moment(start), _moment(end), last - first + 1, total, peak

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, out = (self.open.get() if self.open.exists() else None), []
        for row in pd.concat(list(rows)).sort_values("bucket_start").itertuples(index=False):
            idx, n, score = epoch_us(row.bucket_start) // self.width_us, int(row.n), float(row.score)
            near = now is not None and idx - now[1] <= self.max_gap + 1
            if row.is_burst:
                if near:
                    first, _, total, peak, quiet, quiet_peak = now
                    now = (first, idx, total + quiet + n, max(peak, quiet_peak, score), 0, score)
                else:
                    if now is not None:
                        out.append(self._emitted(key, *now[:4]))
                    now = (idx, idx, n, score, 0, score)
            elif near:
                now = (*now[:4], now[4] + n, max(now[5], score))
        if now is not None:
            self.open.update(now)
            self.timer.at_latest(self._over_ms(now[1]))
        yield _frame(out, INCIDENT_SCHEMA)

    def _over_ms(self, last: int) -> int:
        return -(-(last + self.max_gap + 2) * self.width_us // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out, now = [], self.open.get()
        if now is not None and self._over_ms(now[1]) <= timerValues.getCurrentWatermarkInMs():
            out.append(self._emitted(key, *now[:4]))
            self.open.clear()
            now = None
        self.timer.again(None if now is None else self._over_ms(now[1]))
        yield _frame(out, INCIDENT_SCHEMA)

    def close(self) -> None:
        pass


def watch_incidents(
    bursts: DataFrame, detector: str = "poisson_surprise", max_gap: int = K.MAX_GAP_BUCKETS, width_seconds: int = K.BUCKET_SECONDS
) -> DataFrame:
    """Incidents of scored buckets (``watch_bursts``), each once, when nothing can extend it any more."""
    return bursts.groupBy("method", "bank").transformWithStateInPandas(
        IncidentWatch(detector, max_gap, width_seconds), INCIDENT_SCHEMA, "Append", "EventTime"
    )


def incidents_from_failures(
    failures: DataFrame, origin_us: int, detector: str = "poisson_surprise", lateness: str = "30 minutes",
    max_gap: int = K.MAX_GAP_BUCKETS, width_seconds: int = K.BUCKET_SECONDS,
) -> DataFrame:
    """Counts, burst calls and incidents as one stream of three chained stateful operators."""
    bursts = watch_bursts(tumbling_counts(failures, lateness, width_seconds), origin_us, detector, width_seconds)
    return watch_incidents(bursts, detector, max_gap, width_seconds)


# --- contact history -----------------------------------------------------------------------

CONTACT_SCHEMA = (
    "customer_id string, payment_id string, created_at timestamp, contacts_in_window int, "
    "seconds_since_last_contact double, verdict string"
)


class ContactHistory(StatefulProcessor):
    """Contact cap and cooldown on the requests of a shard of customers, in event order.

    Requests wait in state until a timer says that the watermark has passed them, and are then decided customer by customer in
    order of (created_at, payment_id), whatever order they came in. Only accepted contacts are remembered, and of those a
    customer's last ``contact_cap``; they are forgotten when neither limit can reach back to them.
    """

    def __init__(self, config: PolicyConfig) -> None:
        self.config = config
        self.window_us, self.cooldown_us = config.contact_window_seconds * 1_000_000, config.cooldown_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "customer_id string, us long, payment_id string")
        self.history = handle.getListState("history", "customer_id string, us long")
        self.timer = OneTimer(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows))
        moments = _micros(batch["created_at"])
        self.waiting.appendList(list(zip(batch["customer_id"], moments, batch["payment_id"], strict=True)))
        self.timer.at_latest(-(-min(moments) // 1000))
        return iter(())

    def _decided(self, customer: str | None, requests: list[tuple], contacts: list[int]) -> Iterator[tuple]:
        """The verdicts on requests (us, payment_id) in order; ``contacts`` takes in those accepted."""
        for us, payment_id in sorted(requests):
            count = sum(1 for at in contacts if at >= us - self.window_us)
            since = (us - contacts[-1]) / 1e6 if contacts else None
            if count >= self.config.contact_cap:
                verdict = "per_customer_contact_cap"
            elif contacts and us - contacts[-1] < self.cooldown_us:
                verdict = "contact_cooldown"
            else:
                verdict = "accepted"
                contacts[:] = [*contacts, us][-max(1, self.config.contact_cap):]
            yield customer, payment_id, _moment(us), count, since, verdict

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed, reach = timerValues.getCurrentWatermarkInMs() * 1000, max(self.window_us, self.cooldown_us)
        due, contacts, left, out = defaultdict(list), defaultdict(list), [], []
        for customer, us, payment_id in self.waiting.get():
            if us <= passed:
                due[customer].append((us, payment_id))
            else:
                left.append((customer, us, payment_id))
        for customer, us in self.history.get():
            contacts[customer].append(us)
        for customer, requests in due.items():
            out.extend(self._decided(customer, requests, contacts[customer]))
        kept = [(customer, at) for customer, line in contacts.items() for at in line if at >= passed - reach]
        _kept(self.waiting, left)
        _kept(self.history, kept)
        step = max(1, reach // 24)
        moments = [-(-us // 1000) for _, us, _ in left] + [-(-(at + reach) // step) * step // 1000 + 2 for _, at in kept]
        self.timer.again(min(moments, default=None))
        yield _frame(out, CONTACT_SCHEMA)

    def close(self) -> None:
        pass


def contact_verdicts(
    requests: DataFrame, config: PolicyConfig = PolicyConfig(), lateness: str = "1 hour", shards: int = SHARDS
) -> DataFrame:
    """Verdict per contact request ``(customer_id, payment_id, created_at)``, once the watermark has passed it.

    Requests may come out of order by up to ``lateness``. A later one is dropped and counted by Spark (``late_rows``). The time
    since the last contact is null when that lies beyond both limits.
    """
    rows = requests.select(
        "customer_id", "payment_id", F.col("created_at").cast("timestamp").alias("created_at"), shard("customer_id", shards))
    return rows.withWatermark("created_at", lateness).groupBy("shard").transformWithStateInPandas(
        ContactHistory(config), CONTACT_SCHEMA, "Append", "EventTime"
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that stateful operators of the query have dropped as older than the watermark."""
    return sum(state.numRowsDroppedByWatermark for progress in query.recentProgress for state in progress.stateOperators)


# --- enrichment and downtime state ------------------------------------------------------------


def diagnose_stream(failures: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Stream-static join with the diagnosis table."""
    return diagnose(failures, diagnoses)


class NewestDowntime(StatefulProcessor):
    """Lets a webhook through unless a newer one of its downtime was seen.

    State is the time of the newest webhook. That of a resolved downtime lives until the watermark passes it: from then
    on Spark drops every older webhook of it as late, so nothing is left to compare.
    """

    def __init__(self, columns: list[str]) -> None:
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "us long, resolved boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = pd.concat(list(rows)).sort_values("updated_at", kind="stable").iloc[-1:]
        us, resolved = epoch_us(last["updated_at"].iloc[0]), last["status"].iloc[0] == "resolved"
        if self.newest.exists() and self.newest.get()[0] > us:
            yield last.iloc[:0][self.columns]
            return
        self.newest.update((us, bool(resolved)))
        if resolved:
            self.handle.registerTimer(-(-us // 1000))
        yield last[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.newest.exists():
            us, resolved = self.newest.get()
            if resolved and us <= timerValues.getCurrentWatermarkInMs() * 1000:
                self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def current_downtimes(webhooks: DataFrame, lateness: str = "7 days") -> DataFrame:
    """The newest state of each downtime whenever it changes; write it in ``update`` mode.

    Webhooks may come out of order by up to ``lateness``, measured on ``updated_at``; later ones are dropped and counted
    (``late_rows``). State holds the open downtimes and those resolved within the lateness.
    """
    plain = webhooks.select(*[
        F.col(f.name).cast("timestamp") if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name) for f in webhooks.schema.fields])
    newest = plain.withWatermark("updated_at", lateness).groupBy("id").transformWithStateInPandas(
        NewestDowntime(plain.columns), plain.schema, "Update", "EventTime")
    return newest.select(*[F.col(f.name).cast(f.dataType) for f in webhooks.schema.fields])
