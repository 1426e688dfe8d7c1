"""Stateful streams: pane stores of several producers, duplicates, late rows, differences between windows, watermarks of several sources, early triggers.

Keyed state is kept with ``transformWithState``, which needs the RocksDB state store; ``rocksdb`` sets it for a session.  Each processor holds only what windows that
are still open can use; what is dropped comes out as a row of its own kind, so nothing vanishes without a trace.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from panemill.functions.tables import shared_folder
from panemill.functions.time import WindowSpec, align_start
from panemill.operators.windows import agg_columns
from panemill.streaming.streams import _ms

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Batches of which a query's counts are kept.
BATCHES = 100_000
#: Rows of a file that a batch comes in, about.
FILE_ROWS = 250_000


def rocksdb(spark: SparkSession) -> SparkSession:
    """Lets the session keep state with many columns and timers, and counts of all batches."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", str(BATCHES))
    return spark


def arrivals(rows: DataFrame, batch: str, n: int, name: str, files: int = 1) -> str:
    """A folder into which the rows' batches 0 to n - 1 have come one after another, ``files`` files each: what a stream of so many files a trigger reads in that order."""
    spark, folder = rows.sparkSession, f"{shared_folder(rows.sparkSession, name)}/in"
    for k in range(n):
        part = rows.where(F.col(batch) == k).drop(batch)
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(folder)
        if files > 1:  # Spark writes no file for an empty part
            for _ in range(len(spark.read.schema(part.schema).parquet(folder).inputFiles()), (k + 1) * files):
                spark.createDataFrame([], part.schema).coalesce(1).write.mode("append").parquet(folder)
    return folder


def batch_stream(rows: DataFrame, batch: str, n: int, name: str, most: int = FILE_ROWS) -> DataFrame:
    """The rows as a stream of their batches 0 to n - 1, one a trigger.

    Rows are dealt to folders by batch once, and a large batch comes in as many files of about ``most`` rows: no task writes or reads a whole batch.
    """
    spark, path = rows.sparkSession, shared_folder(rows.sparkSession, f"{name}_dealt")
    rows.write.partitionBy(batch).parquet(path)
    dealt = spark.read.schema(rows.schema).parquet(path)
    largest = dealt.groupBy(batch).count().agg(F.max("count")).first()[0] or 0
    files = -(-largest // most) or 1
    return file_stream(spark, arrivals(dealt, batch, n, name, files), rows.drop(batch).schema, files)


def file_stream(spark: SparkSession, folder: str, schema: str | T.StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_counted(rows: DataFrame, name: str) -> tuple[DataFrame, dict[str, int]]:
    """Runs a stream over all that is there into a table; the table, and the sums of the stream's observed counts."""
    spark = rocksdb(rows.sparkSession)
    out = shared_folder(spark, name)
    query = rows.writeStream.format("parquet").outputMode("append").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/data"), observed(query)


def observed(query: StreamingQuery) -> dict[str, int]:
    """Sums of a query's observed counts over its batches."""
    found: dict[str, int] = {}
    for progress in query.recentProgress:
        for row in (progress["observedMetrics"] or {}).values():
            for name, n in (row.asDict() if hasattr(row, "asDict") else dict(row)).items():
                found[name] = found.get(name, 0) + (n or 0)
    return found


def state_rows(query: StreamingQuery) -> int:
    """Rows of state that a query holds after its last batch."""
    return sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"]) if query.lastProgress else 0


# --- a pane store of several producers


class PaneStore(StatefulProcessor):
    """Panes of all producers of a key, until the windows that use them have come out.

    A producer's message with a watermark behind its last one is rejected; a second message for a pane of a producer is a duplicate; a pane that no window to come
    uses is late.  A window comes out, in the order of time, once the watermarks of all producers have reached its end; panes before the next window are forgotten.
    """

    def __init__(self, spec: WindowSpec, pane_ms: int, producers: Sequence[str], keys: Sequence[str]):
        self.spec, self.pane, self.producers, self.keys = spec, pane_ms, tuple(producers), tuple(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        long = lambda *names: T.StructType([T.StructField(n, T.LongType()) for n in names])
        self.marks = handle.getMapState("marks", T.StructType([T.StructField("producer", T.StringType())]), long("watermark"))
        state = T.StructType([T.StructField("count", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in ("sum", "min", "max"))])
        self.panes = handle.getMapState("panes", T.StructType([T.StructField("start", T.LongType()), T.StructField("producer", T.StringType())]), state)
        self.next = handle.getValueState("next", long("win_start"))

    def _first(self, pane: int) -> int:
        """The first window that uses a pane."""
        earliest = pane - self.spec.range_ms + self.pane
        return earliest + (self.spec.origin_ms - earliest) % self.spec.step_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        named = dict(zip(self.keys, key, strict=True))
        blank = dict.fromkeys(("panes", "count", "sum", "min", "max", "complete"))
        coming = self.next.get()[0] if self.next.exists() else None
        marks = {k[0]: v[0] for k, v in self.marks.iterator()}
        held = {tuple(k): tuple(v) for k, v in self.panes.iterator()}
        before = dict(held)
        for r in sorted(rows, key=lambda r: (r.arrival, r.producer, r.start_ms)):
            said = None
            if r.producer not in self.producers:
                said = "unknown"
            elif r.producer in marks and r.watermark < marks[r.producer]:
                said = "rejected"
            else:
                marks[r.producer] = r.watermark
                if (r.start_ms, r.producer) in held:
                    said = "duplicate"
                elif r.end_ms - r.start_ms != self.pane or (r.start_ms - self.spec.origin_ms) % self.pane:
                    said = "unknown"
                elif coming is not None and r.start_ms < coming:
                    said = "late"
                else:
                    held[r.start_ms, r.producer] = (r["count"], r["sum"], r["min"], r["max"])  # a row has a method named count
            if said:
                yield Row(**named, kind=said, producer=r.producer, win_start=r.start_ms, win_end=r.end_ms, **blank)
            while len(marks) == len(self.producers) and held:
                start = self._first(min(k[0] for k in held))
                start = start if coming is None else max(start, coming)
                if start + self.spec.range_ms > min(marks.values()):
                    break
                yield self._window(named, start, held)
                coming = start + self.spec.step_ms
                held = {k: v for k, v in held.items() if k[0] >= coming}
        for k in before.keys() - held.keys():
            self.panes.removeKey(k)
        for k in held.keys() - before.keys():
            self.panes.updateValue(k, held[k])
        for producer, mark in marks.items():
            self.marks.updateValue((producer,), (mark,))
        if coming is not None:
            self.next.update((coming,))

    def _window(self, named: dict, start: int, held: dict) -> Row:
        end = start + self.spec.range_ms
        own = [v for (at, _), v in held.items() if start <= at < end]
        of = lambda k, merge: None if any(v[k] is None and v[0] != 0 for v in own) else merge([v[k] for v in own if v[k] is not None], default=None)
        count = None if any(v[0] is None for v in own) else sum(v[0] for v in own)
        total = None if any(v[1] is None and v[0] != 0 for v in own) else float(sum(v[1] for v in own if v[1] is not None))
        complete = len(own) == len(self.producers) * (self.spec.range_ms // self.pane)
        return Row(**named, kind="window", producer=None, win_start=start, win_end=end, panes=len(own), count=count, sum=total, min=of(2, min), max=of(3, max), complete=complete)

    def close(self) -> None:
        pass


def pane_store(messages: DataFrame, spec: WindowSpec, pane_ms: int, producers: Sequence[str], keys: Sequence[str] = ("plan",)) -> DataFrame:
    """Windows (kind ``window``) of a stream of partial states (keys, producer, start_ms, end_ms, count, sum, min, max, watermark, arrival), and what was dropped: kind
    rejected, duplicate, late or unknown, with the producer and the pane's bounds.  A batch's messages are taken in the order of arrival."""
    kinds = dict(messages.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "kind string, producer string, win_start long, win_end long, panes long, count long, sum double, min double, max double, complete boolean"])
    rows = messages.select(*keys, "producer", "start_ms", "end_ms", "count", "sum", "min", "max", "watermark", "arrival")
    return rows.groupBy(*keys).transformWithState(PaneStore(spec, pane_ms, producers, keys), schema, "append", "none")


# --- watermarks of several sources


def union_window_agg(sources: Sequence[tuple[DataFrame, int]], spec: WindowSpec, aggs: Sequence, keys: Sequence[str] = ("stream",)) -> DataFrame:
    """Windows over the union of streams (ts, keys, value), each with a delay of its own.

    Every source has its watermark; windows close by the least of them, so a source that lags holds them back instead of losing rows.
    """
    spark = sources[0][0].sparkSession
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "min")
    parts = [rows.select(*keys, "ts", "value").withWatermark("ts", _ms(delay)) for rows, delay in sources]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    window = F.window("ts", _ms(spec.range_ms), _ms(spec.step_ms), _ms(spec.origin_ms % spec.step_ms))
    made = both.groupBy(*keys, window).agg(*agg_columns(aggs))
    return made.select(*keys, F.unix_millis("window.start").alias("win_start"), F.unix_millis("window.end").alias("win_end"), *[c for c in made.columns if c not in (*keys, "window")])


# --- duplicates


def distinct_contributions(stream: DataFrame, identity: Sequence[str], delay_ms: int, ts: str = "ts") -> DataFrame:
    """The first row of each identity within the watermark's delay; counts ``arrived`` and ``kept`` are observed, their difference is what was dropped.

    Copies of a message are alike, so which of those in one batch stays makes no difference.
    """
    rows = stream.observe("arrived", F.count(F.lit(1)).alias("arrived")).withWatermark(ts, _ms(delay_ms))
    return rows.dropDuplicatesWithinWatermark(list(identity)).observe("kept", F.count(F.lit(1)).alias("kept"))


# --- late rows


def run_by_lateness(stream: DataFrame, spec: WindowSpec, delay_ms: int, name: str, ms: str = "ms") -> DataFrame:
    """Runs a stream into a table of all its rows with their class and the watermark in force, partitioned by both class and batch.

    The watermark of a batch is the latest time in the batches before.  on_time: not behind it; late: behind it, but a window that holds the row is open for the delay;
    too_late: no such window.  A batch that is repeated replaces itself, and finds the same watermark.
    """
    spark = stream.sparkSession
    out = shared_folder(spark, name)
    top = f"{out}/tops"

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            batch.agg(F.max(ms).alias("top")).write.mode("overwrite").parquet(f"{top}/batch={number}")
            seen = spark.read.schema("top long, batch long").parquet(top).where(F.col("batch") < number).agg(F.max("top")).first()[0]
            mark = F.lit(seen).cast("long")
            last_end = align_start(F.col(ms), spec.step_ms, spec.origin_ms) + spec.range_ms
            kind = F.when(mark.isNull() | (F.col(ms) >= mark), "on_time").when(last_end + delay_ms > mark, "late").otherwise("too_late")
            batch.withColumn("watermark", mark).withColumn("class", kind).write.mode("overwrite").partitionBy("class").parquet(f"{out}/data/emission={number}")
        finally:
            batch.unpersist()

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(f"{stream.schema.toDDL()}, watermark long, class string, emission long").parquet(f"{out}/data")


# --- differences between windows


def window_differences(stream: DataFrame, spec: WindowSpec, keys: Sequence[str], delay_ms: int) -> DataFrame:
    """Members (keys) of a stream (ts, keys) that a window has and the one before had not (insert), or the other way round (delete), as windows close.

    Needs a range that is a multiple of the step.  A window and the one before differ in the first step of the earlier and the last step of the later: over both together, a
    member comes in if its first row lies in the last step, and is gone if its last row lies in the first.  So the state is a row for each member and open window, kept by
    Spark's own windowed aggregate, and is spread over all members.
    """
    if spec.range_ms % spec.step_ms:
        raise ValueError("the range is no multiple of the step")
    ms = F.unix_millis("ts")
    both = F.window("ts", _ms(spec.range_ms + spec.step_ms), _ms(spec.step_ms), _ms(spec.origin_ms % spec.step_ms))
    spans = stream.withWatermark("ts", _ms(delay_ms)).groupBy(*keys, both).agg(F.min(ms).alias("_first"), F.max(ms).alias("_last"))
    end = F.unix_millis("window.end")
    start = end - spec.range_ms
    change = F.when(F.col("_first") >= end - spec.step_ms, "insert").when(F.col("_last") < start, "delete")
    return spans.select(*keys, start.alias("win_start"), end.alias("win_end"), change.alias("change")).where("change is not null")


# --- early results


class EarlyTrigger(StatefulProcessor):
    """Results of [now - range, now] at each step of the clock, from values as they arrive.

    At the step it waits until every topic has a value in the window, ``wait_ms`` at most.  Without any value in the window nothing comes out; once a key is silent longer than
    min(usual interval * multiple, most_ms), it has no timer any more and its state is empty, until a value arrives again.
    """

    def __init__(self, spec: WindowSpec, topics: Sequence[str], keys: Sequence[str], wait_ms: int = 3000, multiple: float = 3.0, most_ms: int = 60_000, look_ms: int = 250):
        self.spec, self.topics, self.keys = spec, tuple(topics), tuple(keys)
        self.wait, self.multiple, self.most, self.look = wait_ms, multiple, most_ms, look_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getMapState("values", T.StructType([T.StructField("at", T.LongType()), T.StructField("nth", T.LongType())]), T.StructType([T.StructField("topic", T.StringType()), T.StructField("value", T.DoubleType())]))
        self.clock = handle.getValueState("clock", T.StructType([T.StructField(n, T.LongType()) for n in ("due", "first", "last", "batches", "nth")]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        due, first, _, batches, nth = self.clock.get() if self.clock.exists() else (None, now, now, 0, 0)
        for r in rows:
            if r.topic in self.topics and r.value is not None:
                nth += 1
                self.values.updateValue((now, nth), (r.topic, float(r.value)))
        if due is None:
            due = now + self.spec.step_ms
            self.handle.registerTimer(due)
        self.clock.update((due, first, now, batches + 1, nth))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        due, first, last, batches, nth = self.clock.get()
        held = [(k[0], k[1], v[0], v[1]) for k, v in self.values.iterator()]
        live = [x for x in held if x[0] > now - self.spec.range_ms]
        for at, n, _, _ in held:
            if at <= now - self.spec.range_ms:
                self.values.removeKey((at, n))
        seen = {topic for _, _, topic, _ in live}
        usual = (last - first) / (batches - 1) * self.multiple if batches > 1 else self.most
        if now - last > min(max(usual, self.spec.step_ms + self.wait), self.most):
            self.values.clear()
            self.clock.clear()
            return
        if len(seen) < len(self.topics) and now < due + self.wait:
            self.handle.registerTimer(min(now + self.look, due + self.wait))
            return
        if live:
            numbers = [v for _, _, _, v in live]
            yield Row(**dict(zip(self.keys, key, strict=True)), win_start=now - self.spec.range_ms, win_end=now, topics=len(seen), count=len(numbers), sum=sum(numbers), avg=sum(numbers) / len(numbers), min=min(numbers), max=max(numbers), waited_ms=now - due)
        due = now + self.spec.step_ms
        self.handle.registerTimer(due)
        self.clock.update((due, first, last, batches, nth))

    def close(self) -> None:
        pass


def early_trigger(stream: DataFrame, spec: WindowSpec, topics: Sequence[str], keys: Sequence[str] = ("query",), **settings) -> DataFrame:
    """Early results of a stream (keys, topic, value): win_start, win_end, topics with a value, aggregates, and how long the last topic was waited for."""
    kinds = dict(stream.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "win_start long, win_end long, topics long, count long, sum double, avg double, min double, max double, waited_ms long"])
    return stream.select(*keys, "topic", "value").groupBy(*keys).transformWithState(EarlyTrigger(spec, topics, keys, **settings), schema, "append", "processingTime")


# --- estimates on live results


def stream_overlap_avg(results: DataFrame, targets: DataFrame, longest_ms: int, target_ms: int, delay_ms: int) -> DataFrame:
    """Overlap-weighted means of a stream of results (topic, start_ts, end_ts, value) for a stream of targets (b_start_ts, b_end_ts) of one length.

    A stream-stream join bounded in time on both sides: a result is kept until no target to come can reach it, a target until no result can, ``longest_ms`` being the longest
    result.  A topic's estimate comes out once both watermarks have passed every result that may belong to it.
    """
    ms = F.unix_millis
    interval = lambda n: F.expr(f"make_dt_interval(0, 0, 0, {n / 1000})")
    # Both are dealt to buckets as long as a target, and a pair is kept in the bucket where the later of the two begins.
    cut = lambda lo, hi: F.explode(F.sequence(F.floor(ms(lo) / target_ms), F.floor((ms(hi) - 1) / target_ms)))
    a = results.withWatermark("end_ts", _ms(delay_ms)).withColumn("a_bucket", cut("start_ts", "end_ts"))
    b = targets.withWatermark("b_end_ts", _ms(delay_ms)).withColumn("b_bucket", cut("b_start_ts", "b_end_ts"))
    near = (F.col("end_ts") > F.col("b_end_ts") - interval(target_ms)) & (F.col("end_ts") < F.col("b_end_ts") + interval(longest_ms))
    once = F.col("a_bucket") == F.floor(F.greatest(ms("start_ts"), ms("b_start_ts")) / target_ms)
    both = a.join(b, (F.col("a_bucket") == F.col("b_bucket")) & near & (F.col("start_ts") < F.col("b_end_ts")) & (F.col("end_ts") > F.col("b_start_ts")) & once)
    overlap = (F.least(ms("end_ts"), ms("b_end_ts")) - F.greatest(ms("start_ts"), ms("b_start_ts"))).cast("double")
    found = both.groupBy("topic", "b_start_ts", "b_end_ts").agg(F.try_divide(F.sum(F.col("value") * overlap), F.sum(overlap)).alias("avg"), F.count(F.lit(1)).alias("results"))
    return found.select("topic", ms("b_start_ts").alias("b_start"), ms("b_end_ts").alias("b_end"), "avg", "results")


def stream_enrich(stream: DataFrame, static: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Static data beside each row of a stream (inner or left): the static side is read anew for each batch, and broadcast if it is counted to be small."""
    from panemill.operators.relational import enrich

    if how not in ("inner", "left", "left_anti"):
        raise ValueError(f"a stream can't be joined {how} with static data")
    return enrich(stream, static, on, how)


