"""Online detection over a stream of JSON flow packets.

A detector with a key keeps the last rows of every key in Spark's state store, keys being
dealt to buckets where they do not expire or where this is asked for: Spark
sends a micro-batch's rows of a key to one task, which borrows the key's rows, gives every
row its buffer and stores the newest again. State, offsets and output belong to one
checkpoint, so a batch that is repeated after a crash starts from the same state and
overwrites its own output. With an event time, rows behind the watermark are dropped, a gap longer than ``ttl`` empties a buffer, and a timer frees the state of a key
that stays silent; what was freed is told.

A detector without a key has one buffer for the whole stream. Its micro-batches are cut
into even chunks that borrow the rows before them, as the batch job does, so the busy
buffer is not one task; it carries ``n - 1`` rows from batch to batch.
"""

import contextlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from flowloom.functions import numeric, text
from flowloom.operators import clean, metrics, scaling, sequences
from flowloom.operators.ordering import sorted_ordinal
from flowloom.sources import packets, scratch


#: Buffers that are worked on at a time: their distances stay in a processor's cache.
GRAPH_SLICE = 64
#: Groups of keys that share a state; fixed for the life of a checkpoint.
BUCKETS = 1024
#: Rows of a bucket that come out with their buffers at a time.
OUT_ROWS = 8192
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay(df, folder, order_by, slices=4, rows_per_file=1_000_000, ties=("value",)):
    """Write packet lines to ``folder``, one file after the other along ``order_by``.

    ``df`` has the line as ``value``, the order column and the ``ties`` columns,
    which decide among equal order keys. There are at least ``slices`` files of
    equal length (fewer when there are fewer rows), none longer than ``rows_per_file``;
    later rows are in later files, as in a live feed, and rows without an order key come
    last. All files are written by one job; the driver then only renames them in
    order and dates them one millisecond apart, as a file stream reads by date. A
    store that cannot date files needs files that are renamed by copying, which dates them.
    An empty feed is an empty folder.
    """
    spark = df.sparkSession
    columns = list(dict.fromkeys(["value", order_by, *ties]))
    order = [F.col(order_by).asc_nulls_last(), *ties]
    placed = sorted_ordinal(df.select(*columns), order, (), "_at").select("value", "_at")
    placed = scratch.materialise(placed, "placed")
    n = placed.count()
    files = min(max(slices, math.ceil(n / rows_per_file)), n)
    df.select("value").limit(0).write.text(folder)
    if not n:
        return
    path = scratch.new_path(spark, "feed")
    cut = placed.withColumn("_slice", F.floor(F.col("_at") * files / n).cast("int"))
    cut = cut.repartition(min(files, scratch.partitions_for(placed)), "_slice").sortWithinPartitions("_slice", "_at")
    cut.drop("_at").write.partitionBy("_slice").text(path)
    system, target = scratch.filesystem(spark, folder)
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    start = system.getFileStatus(target).getModificationTime()
    for i in range(files):
        found = [f.getPath() for f in system.listStatus(kind(f"{path}/_slice={i}"))]
        for k, part in enumerate(sorted((f for f in found if f.getName().startswith("part-")), key=lambda f: f.getName())):
            placed_at = kind(f"{folder}/part-{i:06d}-{k:03d}.txt")
            system.rename(part, placed_at)
            with contextlib.suppress(Exception):
                system.setTimes(placed_at, start + i, -1)
    scratch.remove(spark, path)


def read_flows(spark, folder, extra="", files_per_trigger=None):
    """(readable flows, unreadable lines) of a growing folder of JSON lines."""
    reader = spark.readStream.schema("value STRING")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return packets.decode(reader.format("text").load(folder), extra)


def verdicts(df, prob="prob", threshold=0.5):
    """Decision, confidence and display texts of scored flows (``>=``)."""
    out = df.withColumn("y_pred", F.when(F.col(prob) >= threshold, 1).otherwise(0))
    return out.withColumns(
        {
            "confidence": numeric.confidence(F.col(prob)),
            "verdict": text.display_label(F.col("y_pred")),
            "truth": text.display_label(F.col("true_label")),
            "correct": F.col("y_pred") == F.col("true_label"),
        }
    )


def zero_padded(width, n=10):
    """Buffer rule of the sequence detector."""
    return n, lambda df: sequences.pad_zero(df, width, n)


def mean_padded(width, n=50, least=10):
    """Buffer rule of the graph detector."""
    return n, lambda df: sequences.pad_mean(df, width, least)


class Buffers(StatefulProcessor):
    """The last ``n`` rows of a key, kept as a list in Spark's state store.

    Every row of the right width comes out with its buffer, the row itself last; rows of
    another width come out without one and touch nothing. With ``ttl`` a buffer starts
    anew where the event time is more than ``ttl`` after the row before; such a buffer, or
    one whose key is silent for so long, comes out once as its last time and length. A row
    without a time takes that of the row before.
    """

    def __init__(self, names, key, order, width, n, ttl_ms=None):
        self.names, self.key, self.order, self.width, self.n, self.ttl_ms = names, key, order, width, n, ttl_ms

    def init(self, handle):
        self.handle = handle
        self.rows = handle.getListState("rows", "at long, features array<double>")

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows), ignore_index=True)
        new.columns = self.names if self.ttl_ms is None else [*self.names, "_ms"]
        if self.ttl_ms is not None:
            # Spark itself drops by the watermark of the batch before, which is behind this one.
            new = new[~(new["_ms"] <= timerValues.getCurrentWatermarkInMs())]
        vectors = [v if v is None else np.asarray(v, float).tolist() for v in new["features"]]
        right = np.array([v is not None and len(v) == self.width for v in vectors])
        if not right.all():
            bad = new[~right]
            yield self._out(bad, [None] * len(bad))
            new, vectors = new[right], [v for v, ok in zip(vectors, right) if ok]
        if not len(new):
            return
        place = new.reset_index(drop=True).sort_values(self.order, kind="stable").index
        new, vectors = new.iloc[place], [vectors[i] for i in place]
        at = [0] * len(new) if self.ttl_ms is None else new["_ms"].tolist()
        old = [(int(r[0]), list(r[1])) for r in self.rows.get()]
        past, start, buffers, ended = [v for _, v in old], 0, [], []
        times = [t for t, _ in old]
        for t, v in zip(at, vectors):
            t = int(t) if t == t else times[-1] if times else 0
            if self.ttl_ms is not None and len(times) > start and t - times[-1] > self.ttl_ms:
                ended.append((times[-1], min(len(times) - start, self.n)))
                start = len(times)
            past.append(v)
            times.append(t)
            buffers.append(past[max(start, len(past) - self.n) :])
        first = max(start, len(past) - self.n) if self.ttl_ms is not None else max(0, len(past) - self.n + 1)
        self.rows.put(list(zip(times[first:], past[first:])))
        if self.ttl_ms is not None:
            self.handle.registerTimer(times[-1] + self.ttl_ms)
        yield self._out(new, buffers)
        if ended:
            yield self._ended(key, ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = [int(r[0]) for r in self.rows.get()]
        if held and held[-1] + self.ttl_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.rows.clear()
            yield self._ended(key, [(held[-1], len(held))])

    def _out(self, rows, buffers):
        out = rows[self.names].copy()
        out["buffer"] = buffers
        if self.ttl_ms is not None:
            out["expired_at"], out["expired_rows"] = None, None
        return out

    def _ended(self, key, ended):
        out = pd.DataFrame({c: [None] * len(ended) for c in [*self.names, "buffer"]})
        for c, value in zip(self.key, key):
            out[c] = value
        out["expired_at"], out["expired_rows"] = [t for t, _ in ended], [k for _, k in ended]
        return out

    def close(self):
        pass


def _flat(rows, width):
    """Bytes of vectors of doubles as one matrix."""
    return np.frombuffer(b"".join(rows), np.float64).reshape(-1, width)


def _ranges(first, sizes):
    """``sizes`` numbers from each of ``first`` on, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _vectors_of(values, width):
    """Arrow's lists of ``width`` for a matrix; what is no number is NULL."""
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, width, dtype=np.int32), pa.array(values.ravel(), from_pandas=True))


def unpacked(df, width, name="buffer"):
    """``df`` with a buffer of vectors in place of its bytes, which are not NULL."""
    fields = [T.StructField(f.name, T.ArrayType(T.ArrayType(T.DoubleType())) if f.name == name else f.dataType) for f in df.schema.fields]

    def run(batches):
        for batch in batches:
            at, rows = batch.schema.get_field_index(name), batch.column(name).to_pylist()
            ends = np.cumsum([0, *[len(r) // (8 * width) for r in rows]]).astype(np.int32)
            buffers = pa.ListArray.from_arrays(ends, _vectors_of(_flat(rows, width), width))
            yield pa.RecordBatch.from_arrays([buffers if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return df.mapInArrow(run, T.StructType(fields))


class Buckets(Buffers):
    """``Buffers`` for many keys at once.

    Keys are dealt to ``BUCKETS`` groups, so that the state store is asked once for a bucket
    of a batch and not once for every key. The list has a row per key: its text, the time of
    its last row and its last rows as the bytes of their doubles, ``n - 1`` of them and ``n``
    with ``ttl``; ``key`` is the column with that text. The rows of all keys of a batch are worked on
    together. With ``packed`` a buffer comes out as bytes, too, which ``unpacked`` reads.
    With ``ttl`` one timer of a bucket stands for the key that expires first.
    """

    def __init__(self, names, key, order, width, n, ttl_ms=None, packed=False):
        super().__init__(names, key, order, width, n, ttl_ms)
        self.packed = packed

    def init(self, handle):
        self.handle = handle
        self.rows = handle.getListState("rows", "key string, at long, past binary")

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows), ignore_index=True)
        new.columns = [*self.names, self.key, "_bucket"] if self.ttl_ms is None else [*self.names, "_ms", self.key, "_bucket"]
        if self.ttl_ms is not None:
            # Spark itself drops by the watermark of the batch before, which is behind this one.
            new = new[~(new["_ms"] <= timerValues.getCurrentWatermarkInMs())]
        right = np.array([v is not None and len(v) == self.width for v in new["features"]], bool)
        if not right.all():
            bad = new[~right]
            yield self._out(bad, [None] * len(bad))
            new = new[right]
        if not len(new):
            return
        new = new.reset_index(drop=True).sort_values(self.order, kind="stable", ignore_index=True)
        codes, keys = pd.factorize(new[self.key])
        # Rows go by key, each after its key's held ones.
        place = np.argsort(codes, kind="stable")
        new, codes = new.iloc[place], codes[place]
        held = {r[0]: (r[1], r[2]) for r in self.rows.get()}
        past = [held.get(k, (0, b""))[1] for k in keys]
        olds = np.array([len(p) // (8 * self.width) for p in past])
        news = np.bincount(codes, minlength=len(keys))
        sizes = olds + news
        begins = np.cumsum(sizes) - sizes
        fresh = _ranges(begins + olds, news)
        values, times = np.empty((sizes.sum(), self.width)), np.zeros(sizes.sum())
        values[_ranges(begins, olds)] = _flat(past, self.width)
        values[fresh] = np.stack([np.asarray(v, float) for v in new["features"]])
        starts, ended = np.repeat(begins, sizes), []
        if self.ttl_ms is not None:
            times[_ranges(begins, olds)] = np.repeat([held.get(k, (0, b""))[0] for k in keys], olds)
            times[fresh] = new["_ms"].to_numpy(float)
            starts, ended = self._lives(times, begins, starts)
            ended = [(keys[np.searchsorted(begins, at, side="right") - 1], t, rows) for at, t, rows in ended]
        last = begins + sizes - 1
        first = np.maximum(starts[last], last + (1 if self.ttl_ms is not None else 2) - self.n)
        for k, at, a, z in zip(keys, times[last].tolist(), first.tolist(), (last + 1).tolist()):
            held[k] = int(at), values[a:z].tobytes()
        self._put(held)
        for at in range(0, len(new), OUT_ROWS):
            row = fresh[at : at + OUT_ROWS]
            yield self._out(new.iloc[at : at + OUT_ROWS], self._buffers(values, np.maximum(starts[row], row - self.n + 1), row))
        if ended:
            yield self._ended(ended)

    def _lives(self, times, begins, starts):
        """(where each row's life begins, (row, time, rows held) of every life that ended); fills ``times``.

        A row without a time has that of the row before, the first one 0.
        """
        first = np.zeros(len(times), bool)
        first[begins] = True
        times[first & np.isnan(times)] = 0
        times[:] = times[np.maximum.accumulate(np.where(np.isnan(times), 0, np.arange(len(times))))]
        over = np.flatnonzero(~first & (np.diff(times, prepend=0) > self.ttl_ms))
        starts = starts.copy()
        starts[over] = over
        starts = np.maximum.accumulate(starts)
        return starts, [(int(i), int(times[i]), int(min(i + 1 - starts[i], self.n))) for i in over - 1]

    def _buffers(self, values, first, last):
        sizes = last + 1 - first
        if self.packed:
            return [values[a:z].tobytes() for a, z in zip(first.tolist(), (last + 1).tolist())]
        return [rows.tolist() for rows in np.split(values[_ranges(first, sizes)], np.cumsum(sizes)[:-1])]

    def _put(self, held):
        self.rows.put([(k, at, past) for k, (at, past) in held.items()])
        if self.ttl_ms is not None:
            due = min(at for at, _ in held.values()) + self.ttl_ms
            # An earlier timer looks at all keys, too, and leaves one for those that stay.
            if not any(t <= due for t in self.handle.listTimers()):
                self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = {r[0]: (r[1], r[2]) for r in self.rows.get()}
        mark = timerValues.getCurrentWatermarkInMs()
        gone = [(k, at, len(past) // (8 * self.width)) for k, (at, past) in held.items() if at + self.ttl_ms <= mark]
        for k, _, _ in gone:
            del held[k]
        if gone:
            self.rows.put([(k, at, past) for k, (at, past) in held.items()]) if held else self.rows.clear()
        if held:
            self.handle.registerTimer(min(at for at, _ in held.values()) + self.ttl_ms)
        if gone:
            yield self._ended(gone)

    def _out(self, rows, buffers):
        out = super()._out(rows, buffers)
        if self.ttl_ms is not None:
            out["expired_key"] = None
        return out

    def _ended(self, ended):
        out = pd.DataFrame({c: [None] * len(ended) for c in [*self.names, "buffer"]})
        out["expired_key"], out["expired_at"], out["expired_rows"] = [list(c) for c in zip(*ended)]
        return out


class Detector:
    """Scores a packet stream with a sliding buffer per key.

    ``rule`` is (buffer length, padding); ``score`` maps a table with a
    ``buffer`` of vectors to the same table with ``prob``. Packets of the
    wrong width are written aside and touch neither buffers nor counts. An
    empty ``key`` is one buffer for the whole stream.

    With ``event`` (a timestamp column), ``delay`` and ``ttl_ms`` a keyed detector forgets:
    a row is late, and dropped, when its time is not after the largest time of the batches
    before less ``delay``; a gap of more than ``ttl_ms`` starts a buffer anew, and a buffer
    whose key was silent for ``ttl_ms`` at the watermark is freed. ``expired`` lists both.
    The state then is at most ``n`` rows for each key seen within ``ttl_ms``. ``n - 1`` rows
    a key are held otherwise. Keys that expire have a state and timers of their own, or share
    ``buckets`` of keys, which many keys need; others always share ``BUCKETS``. ``count_by`` maps names to columns over the verdicts by which
    running counters are kept in the same query.
    """

    def __init__(
        self, params, width, rule, score, out, key=(), order=("seq",), threshold=0.5, event=None, delay="0 seconds",
        ttl_ms=None, count_by=None, buckets=None,
    ):
        if ttl_ms is not None and not (key and event):
            raise ValueError("rows expire by event time and key")
        self.params, self.width, self.rule, self.score = params, width, rule, score
        self.out, self.key, self.order, self.threshold = out, list(key), list(order), threshold
        self.event, self.delay, self.ttl_ms, self.count_by = event, delay, ttl_ms, count_by
        self.buckets = BUCKETS if ttl_ms is None else buckets

    def _scaled(self, flows):
        """``flows`` with features scaled where they have the right width."""
        right = F.coalesce(F.size("features") == self.width, F.lit(False))
        filled = flows.withColumn("_x", F.when(right, F.col("features")).otherwise(F.array_repeat(F.lit(0.0), self.width)))
        scaled = scaling.apply_to_vector(filled, self.params, "_x")
        return scaled.withColumn("features", F.when(right, F.col("_x")).otherwise(F.col("features"))).drop("_x")

    def buffered(self, flows):
        """The stream of ``flows`` with each row's buffer, by the state store.

        Buffers of keys that share buckets are bytes, as they are kept until a batch is scored;
        ``unpacked`` reads them.
        """
        n = self.rule[0]
        rows = self._scaled(flows)
        names = rows.columns
        fields = [T.StructField(f.name, f.dataType) for f in rows.schema.fields]
        fields.append(T.StructField("buffer", T.BinaryType() if self.buckets else T.ArrayType(T.ArrayType(T.DoubleType()))))
        mode = "none"
        if self.ttl_ms is not None:
            rows, mode = rows.withWatermark(self.event, self.delay).withColumn("_ms", F.unix_millis(self.event)), "eventTime"
            fields += [T.StructField("expired_at", T.LongType()), T.StructField("expired_rows", T.LongType())]
        order = list(dict.fromkeys([*self.order, "flow_id"]))
        if not self.buckets:
            state = Buffers(names, self.key, order, self.width, n, self.ttl_ms)
            return rows.groupBy(*self.key).transformWithStateInPandas(state, T.StructType(fields), "append", mode)
        if self.ttl_ms is not None:
            fields.append(T.StructField("expired_key", T.StringType()))
        name = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in self.key]))
        state = Buckets(names, "_key", order, self.width, n, self.ttl_ms, packed=True)
        dealt = rows.withColumn("_key", name).withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(self.buckets)))
        return dealt.groupBy("_bucket").transformWithStateInPandas(state, T.StructType(fields), "append", mode)

    def _store(self, batch, batch_id):
        """Write one micro-batch of buffered rows, by its id."""
        batch.persist()
        try:
            rows = batch
            if self.ttl_ms is not None:
                gone = batch.filter("expired_at is not null")
                if self.buckets:
                    named = F.from_json("expired_key", T.StructType([T.StructField(c, T.StringType()) for c in self.key]))
                    gone = gone.withColumns({c: named[c].cast(batch.schema[c].dataType) for c in self.key})
                gone.select(*self.key, F.timestamp_millis("expired_at").alias("expired_at"), "expired_rows").write.mode(
                    "overwrite"
                ).parquet(f"{self.out}/expired/batch_id={batch_id}")
                rows = batch.filter("expired_at is null").drop("expired_at", "expired_rows", "expired_key")
            bad = rows.filter("buffer is null").drop("buffer")
            bad.write.mode("overwrite").parquet(f"{self.out}/rejected/batch_id={batch_id}")
            good = rows.filter("buffer is not null")
            self._verdicts(unpacked(good, self.width) if self.buckets else good, batch_id)
        finally:
            batch.unpersist()

    def _verdicts(self, buffered, batch_id):
        decided = verdicts(self.score(self.rule[1](buffered)), "prob", self.threshold)
        path = f"{self.out}/verdicts/batch_id={batch_id}"
        decided.write.mode("overwrite").parquet(path)
        if self.count_by:
            self._count(buffered.sparkSession.read.schema(decided.schema).parquet(path), batch_id)

    def _count(self, decided, batch_id):
        """Counters up to this batch: those of the batch before and its own."""
        spark = decided.sparkSession
        counts = running_counts(decided.select("true_label", "y_pred", *[c.alias(n) for n, c in self.count_by.items()]), list(self.count_by))
        if batch_id > 0:
            before = spark.read.schema(counts.schema).parquet(f"{self.out}/counts/batch_id={batch_id - 1}")
            sums = [F.sum(c).alias(c) for c in counts.columns if c not in self.count_by]
            counts = before.unionByName(counts).groupBy(*self.count_by).agg(*sums)
        counts.write.mode("overwrite").parquet(f"{self.out}/counts/batch_id={batch_id}")
        if batch_id > 1:
            scratch.remove(spark, f"{self.out}/counts/batch_id={batch_id - 2}")

    def process(self, batch, batch_id):
        """One micro-batch of the buffer of the whole stream; its scratch is removed.

        The batch reads the rows that the batch before left and leaves its own, so it may be
        repeated after a crash at any point.
        """
        spark = batch.sparkSession
        n = self.rule[0]
        with scratch.temporary(spark):
            good, bad = clean.check_width(batch, self.width)
            bad.write.mode("overwrite").parquet(f"{self.out}/rejected/batch_id={batch_id}")
            rows = scaling.apply_to_vector(good, self.params)
            rows = rows.withColumns({"_batch": F.lit(batch_id).cast("long"), "_seq": F.struct(*self.order, "flow_id")})
            rows = both = scratch.materialise(rows, "fresh")
            if batch_id > 0:
                both = spark.read.schema(rows.schema).parquet(f"{self.out}/state/batch_id={batch_id - 1}").unionByName(rows)
            slid = sequences.sliding(both, [], ["_batch", "_seq"], "features", n)
            self._verdicts(slid.filter(F.col("_batch") == batch_id).drop("_batch", "_seq"), batch_id)
            last = both.orderBy(F.col("_batch").desc(), F.col("_seq").desc()).limit(n - 1)
            last.write.mode("overwrite").parquet(f"{self.out}/state/batch_id={batch_id}")
            if batch_id > 1:
                scratch.remove(spark, f"{self.out}/state/batch_id={batch_id - 2}")

    def run(self, flows, available_now=True, interval="10 seconds"):
        """Start the query; with ``available_now`` wait until the input is read."""
        spark = flows.sparkSession
        stream, store = (self.buffered(flows), self._store) if self.key else (flows, self.process)
        writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{self.out}/checkpoint")
        before = spark.conf.get(STATE_STORE)
        spark.conf.set(STATE_STORE, ROCKS_DB)
        try:
            if available_now:
                writer.trigger(availableNow=True).start().awaitTermination()
                return None
            return writer.trigger(processingTime=interval).start()
        finally:
            spark.conf.set(STATE_STORE, before)

    def results(self, spark):
        return spark.read.parquet(f"{self.out}/verdicts").drop("batch_id")

    def expired(self, spark):
        """The buffers that were given up: key, time of the last row, rows held."""
        return spark.read.parquet(f"{self.out}/expired").drop("batch_id")

    def counts(self, spark):
        """The running counters after the newest batch."""
        found = spark.read.parquet(f"{self.out}/counts")
        last = found.agg(F.max("batch_id")).first()[0]
        return found.filter(F.col("batch_id") == last).drop("batch_id")


def running_counts(decided, by=()):
    """Confusion counters and verdict totals; also valid on a stream."""
    by = [by] if isinstance(by, str) else list(by)

    def cell(truth, guess):
        return F.count_if((F.col("true_label") == truth) & (F.col("y_pred") == guess))

    return decided.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("y_pred") == 1).alias("detected_attack"),
        F.count_if(F.col("y_pred") == 0).alias("detected_benign"),
        cell(0, 0).alias("tn"),
        cell(0, 1).alias("fp"),
        cell(1, 0).alias("fn"),
        cell(1, 1).alias("tp"),
    )


def count_stream(spark, folder, schema, sink, by=(), prepare=None):
    """Running counters of a folder of verdicts, kept up to date in ``sink``.

    ``prepare`` may add columns to the verdicts. Only the last two sets of
    counters are kept.
    """
    stream = spark.readStream.schema(schema).parquet(folder)
    stream = prepare(stream) if prepare else stream

    def store(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{sink}/counts/batch_id={batch_id}")
        if batch_id > 1:
            scratch.remove(spark, f"{sink}/counts/batch_id={batch_id - 2}")

    (
        running_counts(stream, by)
        .writeStream.outputMode("complete")
        .foreachBatch(store)
        .option("checkpointLocation", f"{sink}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    counts = spark.read.parquet(f"{sink}/counts")
    last = counts.agg(F.max("batch_id")).first()[0]
    return counts.filter(F.col("batch_id") == last).drop("batch_id")


def summary(counts):
    """Final rates in percent from the running counters."""
    rates = metrics.scores(counts)
    names = ("accuracy", "precision", "recall", "f1")
    return rates.withColumns({c: F.col(c) * 100.0 for c in names}).select(*counts.columns, *names)


def _smooth_last(buffers, last, k, hops):
    """Propagated vector of row ``last`` for buffers of one length."""
    x = buffers
    n = x.shape[1]
    if n < 3:
        return x[:, last, :]
    length = np.sqrt((x * x).sum(2, keepdims=True))
    unit = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
    gap = 1.0 - unit @ unit.transpose(0, 2, 1)
    gap[:, np.arange(n), np.arange(n)] = np.inf
    k = min(k, n - 1)
    near = gap <= np.partition(gap, k - 1, axis=2)[:, :, k - 1, None]
    # Where more tie with the k-th, the first rows are taken.
    b, i = np.nonzero(np.count_nonzero(near, axis=2) != k)
    near[b, i] = False
    near[b[:, None], i[:, None], np.argsort(gap[b, i], axis=1, kind="stable")[:, :k]] = True
    link = near.astype(np.float64)
    scale = 1.0 / np.sqrt(link.sum(1) + 1.0)[:, :, None]
    link = link.transpose(0, 2, 1)
    for hop in range(hops):
        x = scale * x
        if hop == hops - 1:
            return scale[:, last] * ((link[:, last, None, :] @ x)[:, 0] + x[:, last])
        x = scale * (link @ x + x)
    return x[:, last, :]


def buffer_graph(df, k=10, hops=3, buffer="buffer", size="real", name="smoothed"):
    """The current row's features after propagation inside its own buffer.

    Every buffer becomes a nearest-neighbour graph of at most a few dozen
    rows; ``size`` is the number of real rows, the last of which is current.
    Buffers are worked on ``GRAPH_SLICE`` at a time.
    """
    schema = T.StructType(
        [*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]
    )
    count = lambda lists: pc.list_value_length(lists).to_numpy(zero_copy_only=False)

    def run(batches):
        for batch in batches:
            lists = batch.column(buffer)
            inner = lists.flatten()
            lengths, real = count(lists), batch.column(size).to_numpy()
            ends = np.r_[0, np.cumsum(count(inner))]
            values = inner.flatten().to_numpy(zero_copy_only=False)
            rows = np.cumsum(lengths) - lengths
            starts, widths = ends[rows], (ends[rows + lengths] - ends[rows]) // np.maximum(lengths, 1)
            result = np.empty(widths.sum())
            place = np.cumsum(widths) - widths
            kinds = np.column_stack([lengths, widths, real])
            for n, width, last in np.unique(kinds, axis=0):
                same = np.flatnonzero((kinds == (n, width, last)).all(1))
                for start in range(0, len(same), GRAPH_SLICE):
                    at = same[start : start + GRAPH_SLICE, None]
                    x = values[starts[at] + np.arange(n * width)].reshape(-1, n, width)
                    result[place[at] + np.arange(width)] = _smooth_last(x, last - 1, k, hops)
            smooth = pa.ListArray.from_arrays(np.r_[place, widths.sum()].astype(np.int32), pa.array(result, from_pandas=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, smooth], [*batch.schema.names, name])

    return df.mapInArrow(run, schema)
