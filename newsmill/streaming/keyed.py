"""Stream operators with keyed state: each batch touches the state of its own keys only.

State lives in the RocksDB store beside the checkpoint, so what a batch costs does not depend on
how much came before it. ``with_keyed_state`` selects that store for the streams started from a
session.
"""

import pickle
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BinaryType, StructField, StructType

from newsmill.operators import clean, pages

STORE = "spark.sql.streaming.stateStore.providerClass"
HELD = 10_000  # rows in one value of the state
PACK, PACKS = 4096, 16  # rows in a pack, and packs in one value of the state
PACKING = 8 << 20  # bytes of rows that are packed together
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_keyed_state(spark: SparkSession) -> None:
    """Let streams that are started from now on keep their state in RocksDB."""
    spark.conf.set(STORE, ROCKS)


class _First(StatefulProcessor):
    """The first row of every key; later ones are dropped for good."""

    def __init__(self, order_by: str):
        self.order_by = order_by

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        first = min(rows, key=lambda r: r[self.order_by])
        if not self.seen.exists():
            self.seen.update((True,))
            yield first

    def close(self) -> None:
        pass


def first_arrivals(stream: DataFrame, keys: list[str], order_by: str) -> DataFrame:
    """The first row of each key ever to arrive; within a batch, the first by ``order_by``.

    Exact for any distance between copies; one flag per key is kept. Rows should be narrow:
    all those of a key that come in one batch meet in one task.
    """
    return stream.groupBy(*keys).transformWithState(
        _First(order_by), stream.schema, "Append", "None")


def surviving_keys(stream: DataFrame, order_by: str, carry=()) -> DataFrame:
    """Row keys of arriving articles that the cleaner keeps: the first of each id, then the length
    tests, then the first of each pair of texts. Texts stay outside of the state; ``carry`` names
    columns that come along."""
    by_id = first_arrivals(clean.clean_keys(stream, order_by, carry), ["id"], order_by)
    fitting = by_id.filter("fits").select(*carry, order_by, "fp_lo", "fp_hi")
    return first_arrivals(fitting, ["fp_lo", "fp_hi"], order_by).select(*carry, order_by)


class _Hold(StatefulProcessor):
    """Keeps the rows of a span of time until the watermark has passed it.

    Those that come together are one value of the state, up to ``most`` rows: the way to the store
    and back costs far more for a value than for its bytes.
    """

    def __init__(self, schema: StructType, most: int = HELD):
        self.names, self.most = schema.names, most

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        if not self.held.exists():
            self.handle.registerTimer(int(key[0]))
        while part := [tuple(r[n] for n in self.names) for r in islice(rows, self.most)]:
            self.held.appendValue((pickle.dumps(part),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        make = Row(*self.names)
        for (part,) in self.held.get():
            for row in pickle.loads(part):
                yield make(*row)
        self.held.clear()

    def close(self) -> None:
        pass


PACKED = StructType([StructField("rows", BinaryType())])


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one group (the last two columns) that a task reads together, as one row: Arrow bytes."""
    def packed(held):
        rows = pa.Table.from_batches(held)
        groups = [rows.column(c).to_numpy() for c in (-2, -1)]
        order = np.lexsort(groups[::-1])
        rows = rows.select(range(rows.num_columns - 2)).take(order).combine_chunks()
        span, spread = (g[order] for g in groups)
        first = np.flatnonzero(np.append(True, (span[1:] != span[:-1]) | (spread[1:] != spread[:-1])))
        cuts = [(i, n) for a, b in zip(first, np.append(first[1:], len(span)))
                for i in range(a, b, PACK) for n in (min(PACK, b - i),)]
        made = []
        for i, n in cuts:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as writer:
                writer.write_table(rows.slice(i, n))
            made.append(sink.getvalue().to_pybytes())
        at = [i for i, _ in cuts]
        return pa.record_batch([pa.array(span[at], pa.int64()), pa.array(spread[at], pa.int32()),
                                pa.array(made, pa.binary())], ["_span", "_spread", "rows"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size > PACKING:
            yield packed(held)
            held, size = [], 0
    if held:
        yield packed(held)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        for pack in batch.column(0):
            held.append(pa.ipc.open_stream(pack.as_buffer()).read_all())
            n += held[-1].num_rows
            if n >= HELD:
                yield from pa.concat_tables(held).combine_chunks().to_batches()
                held, n = [], 0
    if held:
        yield from pa.concat_tables(held).combine_chunks().to_batches()


def in_time_order(stream: DataFrame, ts: str, delay: str, span_seconds: int = 60,
                  spread: int = 64) -> DataFrame:
    """The same rows, given out once no earlier one can come any more.

    Rows may arrive up to ``delay`` after later ones; those that come when their span of time has
    been given out are dropped, as are rows without a time. They are held by spans, and given out
    when the watermark passes the end of their span: all rows of a batch are then later than all
    those of the batches before it. A span is dealt over ``spread`` groups, so that neither a busy
    key nor a busy time makes a large group; a row is written and read once. Rows of a group that a
    task reads together go to the state and back as one, so that it costs by groups, not by rows.
    """
    span = span_seconds * 1_000_000
    # a timer is in whole milliseconds, and rows at the watermark itself are late
    end = (F.floor(F.unix_micros(F.col(ts)) / span).cast("long") + 1) * (span // 1000)
    dealt = stream.filter(F.col(ts).isNotNull()).withColumns({
        "_span": end, "_spread": F.pmod(F.xxhash64(*stream.columns), F.lit(spread)).cast("int")})
    packs = dealt.mapInArrow(_packs, "_span long, _spread int, rows binary")
    # the time of a pack is the end of its span, up to a span after its rows
    timed = packs.withColumn("_end", F.timestamp_millis("_span")).withWatermark(
        "_end", f"{delay} {span_seconds} seconds")
    held = timed.groupBy("_span", "_spread").transformWithState(
        _Hold(PACKED, PACKS), PACKED, "Append", "EventTime")
    return held.mapInArrow(_unpacked, stream.schema)


CHOICE = "link string, status string, method string, title string, text string, detail string"
TRIED = ("rank int, method string, title string, text string, failed long, worst int, "
         "detail string, done boolean")


class _Choice(StatefulProcessor):
    """The article of the best method for one URL, as soon as no better one can come."""

    def __init__(self, methods: int, wait_ms: int):
        self.methods, self.wait_ms = methods, wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.tried = handle.getValueState("tried", TRIED)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        rows = list(rows)
        if not self.tried.exists():
            self.handle.registerTimer(min(r["_ms"] for r in rows) + self.wait_ms)
            state = (None, None, None, None, 0, None, None, False)
        else:
            state = tuple(self.tried.get())
        rank, method, title, text, failed, worst, detail, done = state
        if done:
            return
        for r in rows:
            if r["status"] == "ok":
                found = r["_rank"], r["method"], r["title"], r["text"]
                if rank is None or found < (rank, method, title, text):
                    rank, method, title, text = found
            else:
                failed |= 1 << r["_rank"]
                if worst is None or (r["_rank"], r["detail"]) > (worst, detail):
                    worst, detail = r["_rank"], r["detail"]
        last = self.methods + 1 if rank is None else rank  # all methods before it have to have failed
        done = all(failed >> i & 1 for i in range(1, last))
        if done:
            yield self._row(key[0], rank, method, title, text, detail)
            rank, method, title, text, detail = None, None, None, None, None
        self.tried.update((rank, method, title, text, failed, worst, detail, done))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        rank, method, title, text, _, _, detail, done = tuple(self.tried.get())
        if not done:
            yield self._row(key[0], rank, method, title, text, detail)
        self.tried.clear()

    @staticmethod
    def _row(link, rank, method, title, text, detail):
        make = Row("link", "status", "method", "title", "text", "detail")
        if rank is None:
            return make(link, "error", None, None, None, detail)
        return make(link, "ok", method, title, text, None)

    def close(self) -> None:
        pass


def cascade_arrivals(attempts: DataFrame, ts: str, wait_seconds: int, delay: str) -> DataFrame:
    """One row per URL from attempts ``(url, method, html, error, ts)`` that arrive in any order.

    An article is given out at once when every better method has failed, or there is none;
    otherwise ``wait_seconds`` after the URL's first attempt, when the watermark, ``delay`` behind
    the latest attempt, has passed that time. The rows are those of ``pages.cascade``. Methods are
    taken to be tried once; a URL is forgotten at the end of its wait, and a later attempt opens
    it anew.
    """
    made = pages.judged_attempts(attempts).select(
        "url", "method", "status", "title", "text", "detail", "_rank", ts,
        F.unix_millis(F.col(ts)).alias("_ms"))
    return made.withWatermark(ts, delay).groupBy("url").transformWithState(
        _Choice(len(pages.METHODS), wait_seconds * 1000), CHOICE, "Append", "EventTime")
