"""Streams with state of their own: charts in order of event time, decisions that wait for an outcome, batches for destinations.

Each is a stateful processor with timers; its state lives in RocksDB and in the checkpoint, so a restart goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import values

_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started in here keep their state in RocksDB, which stateful processors need. A started query keeps what held then."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


class _Chart(StatefulProcessor):
    """State of a metric: rows that the watermark has not passed, and the last values that it has."""

    def __init__(self, size: int, sigma: float, least: int, warmup: int) -> None:
        self.size, self.sigma, self.least, self.warmup = size, sigma, least, warmup

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, value double")
        self.kept = handle.getListState("kept", "value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        new = [(r.us, r.value) for r in rows if r.us is not None and r.value is not None and r.us > passed * 1000]  # later ones are too late
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(-(-min(new)[0] // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(x) for x in self.waiting.get())
        ready = [x for x in waiting if x[0] <= passed]
        if len(ready) < len(waiting):
            self.waiting.put(waiting[len(ready) :])
            self.handle.registerTimer(-(-waiting[len(ready)][0] // 1000))
        elif waiting:
            self.waiting.clear()
        if not ready:
            return
        kept = [x[0] for x in self.kept.get()]
        for us, value in ready:
            kept = [*kept, value][-self.size :]
            n, mean, std = len(kept), float(np.mean(kept)), float(np.std(kept)) or 1e-10
            z = (value - mean) / std if n >= max(self.least, self.warmup) else 0.0
            known = n >= self.warmup
            yield Row(metric_name=key[0], us=us, value=value, n=n, mean=mean if known else None, std=std if known else None, z=z, is_anomaly=abs(z) > self.sigma)
        self.kept.put([(x,) for x in kept])

    def close(self) -> None:
        pass


def spc(series: DataFrame, size: int = 60, sigma: float = 3.0, least: int = 30, warmup: int = values.SPC_WARMUP, late: str = "10 minutes") -> DataFrame:
    """operators.windows.spc on a stream, in order of event time whatever the order of arrival.

    A row waits until the watermark has passed it (that is, until rows `late` younger have come); rows that come later still do
    not count. State is what waits and the last size values of a metric. Rows of one time go by value; rows without a name, time
    or value do not count.
    """
    # As it names the time, the filter stays above the watermark, which so follows all rows.
    named = series.withWatermark("ts", late).filter("metric_name IS NOT NULL OR ts IS NULL")
    marked = named.select("metric_name", "ts", F.unix_micros("ts").alias("us"), "value")
    out = marked.groupBy("metric_name").transformWithState(_Chart(size, sigma, least, warmup), "metric_name string, us long, value double, n long, mean double, std double, z double, is_anomaly boolean", "Append", "EventTime")
    return out.select("metric_name", F.timestamp_micros("us").alias("ts"), "value", "n", "mean", "std", "z", "is_anomaly")


#: A decision or an outcome that waits.
_WAITS = np.dtype([("log_id", "<i8"), ("us", "<i8"), ("outcome", "?")])
#: How a decision ended.
_ENDED = np.dtype([("log_id", "<i8"), ("decided", "<i8"), ("ended", "<i8"), ("timeout", "?")])
#: Parts of a share's state, by hash of the log: a micro-batch reads and writes those alone that its logs are in.
SLOTS = 256
_NEVER = np.iinfo(np.int64).max


def _matched(rows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """What ends among the rows of some logs, and what waits on: the first decision of each log takes the first outcome in its window.

    Outcomes without decision wait, and those before it, for an earlier decision may come yet.
    """
    rows = rows[np.lexsort((rows["us"], rows["outcome"], rows["log_id"]))]
    group = np.cumsum(np.diff(rows["log_id"], prepend=rows["log_id"][:1]) != 0)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    decided = ~rows["outcome"][first]
    at, known = rows["us"][first][group], decided[group]
    fits = np.flatnonzero(rows["outcome"] & known & (rows["us"] >= at) & (rows["us"] <= at + window))
    over, nearest = np.unique(group[fits], return_index=True)
    ended = np.zeros(len(over), _ENDED)
    ended["log_id"], ended["decided"], ended["ended"] = rows["log_id"][first][over], rows["us"][first][over], rows["us"][fits[nearest]]
    waits = rows["outcome"] & (~known | (rows["us"] < at))
    waits[first[decided]] = True
    return ended, rows[waits & ~np.isin(group, over)]


class _Pending(StatefulProcessor):
    """State of a share of all logs: decisions without outcome and outcomes that came before their decision, packed by slots; the time
    at which the first row of each slot is over; and the one timer that is set.

    Rows come, wait and go in packets, so Python's calls are by slot and packet, not by log.
    """

    def __init__(self, window: int, grain: int) -> None:
        self.window, self.grain = window, grain  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot int", "rows binary")
        self.least = handle.getValueState("least", "us binary")
        self.due = handle.getValueState("due", "ms long")

    def _over(self, rows: np.ndarray) -> np.ndarray:
        """When the rows are over: a decision with its window, an outcome at its time."""
        return np.where(rows["outcome"], rows["us"], rows["us"] + self.window)

    def _times(self) -> np.ndarray:
        return np.frombuffer(bytes(self.least.get()[0]), "<i8").copy() if self.least.exists() else np.full(SLOTS, _NEVER)

    def _held(self, slot: int) -> np.ndarray:
        return np.frombuffer(bytes(self.waiting.getValue((slot,))[0]), _WAITS)

    def _hold(self, slot: int, rows: np.ndarray, least: np.ndarray) -> None:
        if len(rows):
            self.waiting.updateValue((slot,), (rows.tobytes(),))
        elif least[slot] != _NEVER:
            self.waiting.removeKey((slot,))
        least[slot] = self._over(rows).min(initial=_NEVER)

    def _set(self, least: np.ndarray) -> None:
        """Keep the slots' times, and one timer: at the grain after the first of them."""
        self.least.update((least.tobytes(),))
        before = self.due.get()[0] if self.due.exists() else None
        us = int(least.min())
        ms = None if us == _NEVER else -(-us // self.grain) * (self.grain // 1000)
        if ms == before:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if ms is None:
            self.due.clear()
        else:
            self.due.update((ms,))
            self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = np.concatenate([np.frombuffer(bytes(r.rows), _WAITS) for r in rows])
        new = new[new["us"] > timerValues.getCurrentWatermarkInMs() * 1000]  # others are too late
        slots = (new["log_id"].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.int64) % SLOTS
        order, least = np.argsort(slots, kind="stable"), self._times()
        cuts = np.searchsorted(slots[order], np.arange(SLOTS + 1))
        for slot in np.unique(slots).tolist():
            own = new[order[cuts[slot] : cuts[slot + 1]]]
            if least[slot] != _NEVER:
                own = np.concatenate([self._held(slot), own])
            ended, waits = _matched(own, self.window)
            self._hold(slot, waits, least)
            if len(ended):
                yield Row(rows=ended.tobytes())
        if len(new):
            self._set(least)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed, least = timerValues.getCurrentWatermarkInMs() * 1000, self._times()
        self.due.clear()  # it is this timer
        for slot in np.flatnonzero(least <= passed).tolist():
            rows = self._held(slot)
            over = self._over(rows) <= passed
            gone = rows[over & ~rows["outcome"]]
            self._hold(slot, rows[~over], least)
            if len(gone):
                ended = np.zeros(len(gone), _ENDED)
                ended["log_id"], ended["decided"], ended["ended"], ended["timeout"] = gone["log_id"], gone["us"], gone["us"] + self.window, True
                yield Row(rows=ended.tobytes())
        self._set(least)

    def close(self) -> None:
        pass


def _waits(rows: DataFrame, outcome: bool) -> DataFrame:
    """Rows (share, at, rows) of rows (share, log_id, us): the rows of each share that stand in one Arrow batch, packed, with their latest time."""

    def run(batches):
        for batch in batches:
            share = batch.column(0).to_numpy(zero_copy_only=False)
            own = np.zeros(len(share), _WAITS)
            own["log_id"], own["us"], own["outcome"] = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False), outcome
            order = np.argsort(share, kind="stable")
            cuts = np.flatnonzero(np.diff(share[order], prepend=-1))
            parts = [own[order[k : min(k + PACKET, end)]] for at, end in zip(cuts, [*cuts[1:], len(order)]) for k in range(at, end, PACKET)]
            whose = [share[order[k]] for at, end in zip(cuts, [*cuts[1:], len(order)]) for k in range(at, end, PACKET)]
            latest = pa.array([int(p["us"].max()) for p in parts], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(whose, pa.int64()), latest, pa.array([p.tobytes() for p in parts], pa.binary())], ["share", "us", "rows"])

    return rows.mapInArrow(run, "share long, us long, rows binary").select("share", F.timestamp_micros("us").alias("at"), "rows")


def _told(ended: DataFrame) -> DataFrame:
    """Rows (log_id, state, decided_at, ended_at) of packets of ended decisions."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = np.frombuffer(data.as_py(), _ENDED)
                columns = [pa.array(np.ascontiguousarray(rows[c])) for c in ("log_id", "timeout", "decided", "ended")]
                yield pa.RecordBatch.from_arrays(columns, ["log_id", "timeout", "decided", "ended"])

    out = ended.mapInArrow(run, "log_id long, timeout boolean, decided long, ended long")
    state = F.when(F.col("timeout"), "timeout").otherwise("outcome").alias("state")
    return out.select("log_id", state, F.timestamp_micros("decided").alias("decided_at"), F.timestamp_micros("ended").alias("ended_at"))


def pending(decisions: DataFrame, outcomes: DataFrame, hours: int = 24, late: str = "10 minutes", shares: int = 64, grain_seconds: int = 60) -> DataFrame:
    """(log_id, state, decided_at, ended_at): a row for each decision, once an outcome has come within the hours after it (state outcome),
    or once the watermark has passed that time (timeout). decisions has log_id and event_ts, outcomes log_id and outcome_ts.

    Logs are dealt to shares by their id; a share's state is its open decisions, which leave by a timer, and outcomes that wait
    for a decision until the watermark has passed them. Timers are set in grains, so a timeout may be told that much later.
    Rows without id or time do not count; the first of several decisions on one log does.
    """

    def one(df: DataFrame, at: str, outcome: bool) -> DataFrame:
        known = df.select(F.col("log_id").cast("long").alias("log_id"), F.unix_micros(F.col(at).cast("timestamp")).alias("us")).filter("log_id IS NOT NULL AND us IS NOT NULL")
        # A packet's time is its latest row's, so the watermark follows all rows; the late rows of a packet are passed over with its state.
        return _waits(known.select(F.pmod(F.xxhash64("log_id"), F.lit(shares)).alias("share"), "log_id", "us"), outcome).withWatermark("at", late)

    both = one(decisions, "event_ts", False).unionByName(one(outcomes, "outcome_ts", True))
    ended = both.groupBy("share").transformWithState(_Pending(hours * 3_600_000_000, grain_seconds * 1_000_000), "rows binary", "Append", "EventTime")
    return _told(ended)


#: Rows of one queue, or of one share, that a packet holds at most.
PACKET = 10_000


def _ipc(rows: pa.Table) -> bytes:
    """Rows as one compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _rows(packed: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in packed])


def _packets(queued: DataFrame, names: list[str]) -> DataFrame:
    """Rows (destination, category, lane, n, rows): the rows of each queue that stand in one Arrow batch, packed, without row by row Python."""

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            codes = np.unique(np.stack([np.asarray(pc.fill_null(pc.cast(c, pa.string()), "\0").dictionary_encode().combine_chunks().indices) for c in (table["destination"], table["category"], table["lane"])]), axis=1, return_inverse=True)[1].ravel()
            order = np.argsort(codes, kind="stable")
            table, cuts = table.take(pa.array(order)), np.flatnonzero(np.diff(codes[order], prepend=-1))
            out = []
            for at, end in zip(cuts, [*cuts[1:], len(order)]):
                for k in range(at, end, PACKET):
                    part = table.slice(k, min(PACKET, end - k))
                    out.append(({c: part[c][0].as_py() for c in ("destination", "category", "lane")} | {"n": part.num_rows, "rows": _ipc(part.select(names))}))
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("destination", pa.string()), ("category", pa.string()), ("lane", pa.int32()), ("n", pa.int64()), ("rows", pa.binary())]))

    return queued.mapInArrow(run, "destination string, category string, lane int, n long, rows binary")


def _unpacked(sent: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of the packets (first, size, n, rows): all of them in batches of size rows, numbered from first."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                first, size, data = (batch.column(c)[k].as_py() for c in ("first", "size", "rows"))
                table = _rows([data])
                numbers = pa.array(first + np.arange(table.num_rows, dtype=np.int64) // size)
                table = table.append_column("batch_number", numbers).append_column("batch_rows", pa.array(np.full(table.num_rows, size, np.int64)))
                yield from table.combine_chunks().to_batches()

    return sent.mapInArrow(run, schema)


class _Batches(StatefulProcessor):
    """State of a queue: the rows of the batch that is not full yet, packed, the next batch's number, and when it has waited long enough.

    Rows come and go in packets, so Python's work is by packet and the rows of a queue are never all in memory.
    """

    def __init__(self, sizes: dict[str, int], seconds: float | None) -> None:
        self.sizes, self.wait = sizes, None if seconds is None else int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "n long, rows binary")
        self.number = handle.getValueState("number", "n long")
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        size, flush = self.sizes.get(key[1], 100), False
        number = first = self.number.get()[0] if self.number.exists() else 0
        waiting, packed = self.waiting.get() if self.waiting.exists() else (0, None)
        held, kept = waiting, [packed] if waiting else []
        for r in rows:
            if r.rows is None:
                flush = True
                continue
            kept.append(bytes(r.rows))
            waiting += r.n
            if waiting >= size:
                whole = waiting // size
                table, waiting = _rows(kept), waiting - whole * size
                yield Row(first=number, size=size, n=whole * size, rows=_ipc(table.slice(0, whole * size)))
                number, held = number + whole, -1
                kept = [_ipc(table.slice(whole * size))] if waiting else []
        if flush and waiting:
            yield Row(first=number, size=waiting, n=waiting, rows=_ipc(_rows(kept)))
            number, waiting, held = number + 1, 0, -1
        if number != first:
            self.number.update((number,))
        if waiting and held != waiting:
            self.waiting.update((waiting, _ipc(_rows(kept))))
        elif not waiting and held:
            self.waiting.clear()
        if self.wait is None:
            return
        if waiting and (held <= 0 or not self.due.exists()):
            self._reset(timerValues.getCurrentProcessingTimeInMs() + self.wait)
        elif not waiting:
            self._reset(None)

    def _reset(self, ms: int | None) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        if ms is None:
            self.due.clear()
        else:
            self.due.update((ms,))
            self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        waiting = self.waiting.get() if self.waiting.exists() else None
        self.due.clear()
        self.waiting.clear()
        if waiting:
            number = self.number.get()[0] if self.number.exists() else 0
            self.number.update((number + 1,))
            yield Row(first=number, size=waiting[0], n=waiting[0], rows=bytes(waiting[1]))

    def close(self) -> None:
        pass


def batched(routed: DataFrame, lane: Column, lanes: int, flush: DataFrame | None = None, seconds: float | None = 5.0, routes: dict | None = None) -> DataFrame:
    """Routed logs (see ensemble.routes) in batches for their destination: with lane, batch_number and batch_rows.

    Every destination, category and lane is a queue that sends a batch once it has as many rows as the category's route says,
    or once its oldest row has waited so many seconds. Lanes (0 to lanes - 1) share out a busy destination over tasks. Logs that
    are routed at once never wait: each is a batch of one, without number. A stream flush, of any rows, empties all queues when a
    row of it comes (as on shutdown); without, what waits stays in the checkpoint and goes on after a restart.

    Waiting time is the clock's, so a query with seconds runs until it is stopped (trigger processingTime). With seconds None a batch
    waits until it is full or flushed, and a query can end when its input does (trigger availableNow).
    """
    routes = routes or values.ROUTES
    sizes = {c: n for c, (_, _, n) in routes.items()}
    at_once = F.col("method") == "immediate"
    direct = routed.filter(at_once).select("*", F.lit(None).cast("int").alias("lane"), F.lit(None).cast("long").alias("batch_number"), F.lit(1).cast("long").alias("batch_rows"))
    queued = routed.filter(~at_once).select("*", F.coalesce(lane.cast("int"), F.lit(0)).alias("lane"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in queued.schema])
    packets = _packets(queued, queued.columns)
    if flush is not None:
        queues = [F.struct(F.lit(d).alias("destination"), F.lit(c).alias("category"), F.lit(k).alias("lane")) for c, (m, ds, _) in routes.items() if m != "immediate" for d in ds for k in range(lanes)]
        key = flush.select(F.inline(F.array(*queues)))
        packets = packets.unionByName(key.select("destination", "category", "lane", F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("rows")))
    out = T.StructType([*schema, T.StructField("batch_number", T.LongType()), T.StructField("batch_rows", T.LongType())])
    sent = packets.groupBy("destination", "category", "lane").transformWithState(_Batches(sizes, seconds), "first long, size long, n long, rows binary", "Append", "None" if seconds is None else "ProcessingTime")
    return _unpacked(sent, out).unionByName(direct.select(*out.fieldNames()))
