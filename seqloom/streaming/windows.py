"""Event-time windows and online transition counts. Each works on a stream and, with the same plan, on a table."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import shared_dir


def late(df: DataFrame, at: str, delay: str) -> DataFrame:
    return df.withWatermark(at, delay) if df.isStreaming else df


def tumbling(df: DataFrame, at: str, size: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    return late(df, at, delay).groupBy(F.window(at, size), *keys).agg(F.count("*").alias("n"))


def sliding(df: DataFrame, at: str, size: str, step: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    return late(df, at, delay).groupBy(F.window(at, size, step), *keys).agg(F.count("*").alias("n"))


def session_counts(df: DataFrame, at: str, gap: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Rows of each run of a key; rows exactly a gap apart are in two runs."""
    return late(df, at, delay).groupBy(F.session_window(at, gap).alias("window"), *keys).agg(F.count("*").alias("n"))


def online_transitions(df: DataFrame, key: str, at: str, symbol: str) -> DataFrame:
    """key, from, to of a stream as its rows come in; the state of a key is its last symbol, so it doesn't grow.

    Rows of one micro-batch are put in order; across batches the order of arrival counts.
    """
    kind = df.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        rows = pd.concat(list(frames)).sort_values(at)
        seq = ([state.get[0]] if state.exists else []) + rows[symbol].tolist()
        state.update((seq[-1],))
        yield pd.DataFrame({key: k[0], "from": seq[:-1], "to": seq[1:]})

    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, from string, to string", "last string", "append", "NoTimeout")


#: Columns of the rows that wait: key, microseconds, tie, symbol.
ROW = pa.schema([("key", pa.string()), ("us", pa.int64()), ("tie", pa.int64()), ("symbol", pa.string())])


def _to_bytes(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(pa.Table.from_pandas(rows, schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _from_bytes(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


class OrderedTransitions(StatefulProcessor):
    """Transitions of a bucket's keys in order of event time: rows wait until the watermark passes them, and last symbols are kept.

    The state is the rows within the delay, packed by micro-batch, and one symbol a key, so a call to the state store
    serves all keys of a bucket. A timer behind the newest row ends its waiting, also when no more rows of the bucket come.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "rows binary")
        self.waiting = handle.getListState("waiting", "least long, rows binary")

    def _passed(self, before: int) -> Iterator[pd.DataFrame]:
        held = list(self.waiting.get()) if self.waiting.exists() else []
        if not held or min(x[0] for x in held) > before:
            return
        rows = pd.concat([_from_bytes(x[1]) for x in held])
        ready, rest = rows[rows["us"] <= before], rows[rows["us"] > before]
        self.waiting.clear()
        if len(rest):
            self.waiting.put([(int(rest["us"].min()), _to_bytes(rest, ROW))])
        ready = ready.sort_values(["us", "tie"])
        if self.last.exists():
            ready = pd.concat([_from_bytes(self.last.get()[0]), ready])
        code = pd.factorize(ready["key"], use_na_sentinel=False)[0]
        order = np.argsort(code, kind="stable")  # by key, each key's last symbol and its rows in order
        ready, code = ready.iloc[order], code[order]
        more = code[1:] == code[:-1]
        self.last.update((_to_bytes(ready[np.r_[~more, True]], ROW),))
        if more.any():
            names = ready["symbol"].to_numpy()
            yield pd.DataFrame({"key": ready["key"].to_numpy()[1:][more], "from": names[:-1][more], "to": names[1:][more]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803  Spark's names
        came = pd.concat(list(rows))[ROW.names]
        self.waiting.appendValue((int(came["us"].min()), _to_bytes(came, ROW)))
        self.handle.registerTimer(int(came["us"].max()) // 1000 + 1)
        yield from self._passed(timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        yield from self._passed(timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


#: The process in which a streaming query reads its processor doesn't have what ship() sends, so this module goes with it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def ordered_transitions(stream: DataFrame, key: str, at: str, tie: str, symbol: str, delay: str, buckets: int) -> DataFrame:
    """key (as text), from, to of a stream by event time, rows up to `delay` late; equal times are in order of `tie`, nulls last.

    Keys are dealt to so many buckets; the rows of one that are within the delay are in memory at once.
    """
    own = F.col(key).cast("string")
    order = F.coalesce(F.col(tie).cast("long"), F.lit((1 << 63) - 1))
    rows = stream.withWatermark(at, delay).select(at, F.pmod(F.xxhash64(own), F.lit(buckets)).alias("bucket"), own.alias("key"), F.unix_micros(at).alias("us"), order.alias("tie"), F.col(symbol).alias("symbol"))
    return rows.groupBy("bucket").transformWithStateInPandas(OrderedTransitions(), "key string, from string, to string", "Append", "EventTime")


#: Rows of a bucket of keys, on average, over the whole stream.
BUCKET_ROWS = 50_000


def online_grammar(spark: SparkSession, rows: DataFrame, key: str, at: str, tie: str, symbol: str, parts: int) -> DataFrame:
    """key, from, to, count of all rows, read as a stream in `parts` pieces, every second of which comes after the one it precedes in time.

    The state store keeps what waits in the shared folder. A last row of no key, later than the delay, lets the watermark pass all others.
    """
    base = f"{shared_dir(spark)}/grammar-{uuid.uuid4().hex}"
    rows = rows.withColumn(at, F.col(at).cast("timestamp"))
    span = rows.agg(F.min(F.unix_millis(at)).alias("a"), F.max(F.unix_millis(at)).alias("b"), F.count("*").alias("n")).first()
    kind = rows.schema[key].dataType
    if span["a"] is None:
        return rows.select(key, F.col(symbol).alias("from"), F.col(symbol).alias("to")).limit(0).groupBy(key, "from", "to").count()
    width = (span["b"] - span["a"]) // parts + 1
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor((F.unix_millis(at) - span["a"]) / width)
    for k in range(parts):
        swapped = k + 1 if k % 2 == 0 and k + 1 < parts else k - 1 if k % 2 else k
        rows.filter(part == swapped).repartition(files).write.mode("append").parquet(f"{base}/in")
    end = rows.limit(1).withColumn(key, F.lit(None).cast(kind)).withColumn(at, F.timestamp_millis(F.lit(span["b"] + 4 * width + 1)))
    end.write.mode("append").parquet(f"{base}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
        told = ordered_transitions(stream, key, at, tie, symbol, f"{2 * width} milliseconds", max(2 * files, span["n"] // BUCKET_ROWS))
        told.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    out = spark.read.schema("key string, from string, to string").parquet(f"{base}/out")
    return out.groupBy(F.col("key").cast(kind).alias(key), "from", "to").count()
