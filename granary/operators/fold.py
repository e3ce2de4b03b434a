"""Ordered folds: what becomes of an event depends on what became of those before it.

Events are sorted by key and order over all tasks and cut into chunks of bounded
length, a row each. Chunks are folded in parallel, each from a guess of the state that
it starts in; those whose predecessor ended in another state are folded again, until all agree. A key of one
chunk is right at once; a longer one takes as many rounds as its chunks at most, and two where states forget
the past. No task holds more than a chunk of a key, however many events it has.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.session import materialize

#: Events of a chunk.
CHUNK = 10_000

#: From a state and an event to the next state and the values of the added columns; states are JSON values.
Step = Callable[[object, dict], tuple[object, tuple]]


def chunks(events: DataFrame, keys: list[str], order: list[str], chunk: int) -> DataFrame:
    """key (the key columns as JSON), pid, k, rows: the events of each key in order, `chunk` of them in a row at most."""
    from pyspark import TaskContext

    row = ", ".join(f"`{c}`: {t}" for c, t in events.dtypes)
    keyed = events.select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("key"), F.struct(*events.columns).alias("row"))
    by = ["key", *[F.col("row")[c] for c in order]]

    def work(batches):
        pid, held, last, k = TaskContext.get().partitionId(), None, None, 0

        def packed(table: pa.Table, whole: bool):
            """Rows of all chunks that are complete, and the events that aren't."""
            nonlocal last, k
            names = table.column("key").combine_chunks()
            n = len(names)
            code = names.dictionary_encode().indices.to_numpy()
            first = np.flatnonzero(np.concatenate([[True], np.diff(code) != 0]))
            size = np.diff(np.append(first, n))
            begins = np.concatenate([a + np.arange(0, s, chunk) for a, s in zip(first, size)])
            ends = np.append(begins[1:], n)
            if not whole and ends[-1] - begins[-1] < chunk:
                begins, ends = begins[:-1], ends[:-1]
            done = int(ends[-1]) if len(ends) else 0
            numbers = []
            for name in names.take(pa.array(begins)).to_pylist():
                k = k + 1 if name == last else 0
                last = name
                numbers.append(k)
            rows = pa.ListArray.from_arrays(pa.array(np.append(begins, done), pa.int32()), table.column("row").combine_chunks()[:done])
            made = pa.RecordBatch.from_arrays([names.take(pa.array(begins)), pa.array([pid] * len(begins), pa.int64()), pa.array(numbers, pa.int64()), rows], ["key", "pid", "k", "rows"])
            return made, table.slice(done)

        for batch in (x for x in batches if x.num_rows):
            table = pa.Table.from_batches([batch])
            made, held = packed(pa.concat_tables([held, table]) if held is not None and held.num_rows else table, False)
            if made.num_rows:
                yield made
        if held is not None and held.num_rows:
            yield packed(held, True)[0]

    return keyed.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(work, f"key string, pid long, k long, rows array<struct<{row}>>")


def folded(events: DataFrame, keys: list[str], order: list[str], start: object, step: Step, added: str, chunk: int = CHUNK, final: Callable[[Column], Column] | None = None) -> DataFrame:
    """The events with the columns `added` (a schema string) that `step` gives each of them in the order of its key.

    `final` tells by a state's JSON that nothing leads out of it; the chunks behind such a state need no round of their own.
    The order must be total within a key. Null keys are a key of their own. An empty table gives none.
    """
    spark, first = events.sparkSession, json.dumps(start)
    cut = materialize(chunks(events, keys, order, chunk))
    place = Window.partitionBy("key").orderBy("pid", "k")
    ids = cut.select("key", "pid", "k", F.row_number().over(place).alias("n"), F.count("*").over(Window.partitionBy("key")).alias("of")).filter("of > 1")
    long = materialize(ids.drop("of"))

    def ended(rows: DataFrame) -> DataFrame:
        """key, n, before, after of chunks (key, n, before, rows)."""

        def work(batches):
            for batch in batches:
                after = []
                for before, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    state = json.loads(before)
                    for event in found:
                        state, _ = step(state, event)
                    after.append(json.dumps(state))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(after, pa.string())], ["key", "n", "before", "after"])

        return rows.select("key", "n", "before", "rows").mapInArrow(work, "key string, n int, before string, after string")

    states = None
    if not long.isEmpty():
        parts = materialize(cut.join(long, ["key", "pid", "k"]))
        states = materialize(ended(parts.withColumn("before", F.lit(first))))
        while True:
            ahead = states.select("key", (F.col("n") + 1).alias("n"), F.col("after").alias("right"))
            wrong = materialize(states.join(ahead, ["key", "n"]).filter("before <> right").select("key", "n", F.col("right").alias("before")))
            if wrong.isEmpty():
                break
            if final is not None:
                # what stands before a key's first wrong chunk is right
                first_wrong = wrong.groupBy("key").agg(F.min(F.struct("n", "before")).alias("f")).select("key", F.col("f.n").alias("from_n"), F.col("f.before").alias("end"))
                ended_keys = materialize(first_wrong.filter(final(F.col("end"))))
                behind = F.coalesce(F.col("n") >= F.col("from_n"), F.lit(False))
                states = states.join(ended_keys, "key", "left")
                states = materialize(states.select("key", "n", *[F.when(behind, F.col("end")).otherwise(F.col(c)).alias(c) for c in ("before", "after")]))
                wrong = wrong.join(ended_keys, "key", "left_anti")
            again = ended(parts.join(wrong, ["key", "n"]))
            states = materialize(states.join(wrong, ["key", "n"], "left_anti").unionByName(again))
        states = long.join(states.select("key", "n", "before"), ["key", "n"]).drop("n")
    begun = cut.join(states, ["key", "pid", "k"], "left") if states is not None else cut.withColumn("before", F.lit(None).cast("string"))
    names = added_names(spark, added)

    def work(batches):
        for batch in batches:
            for before, found in zip(batch.column(0).to_pylist(), batch.column(1)):
                state, out = json.loads(before), []
                for event in found.as_py():
                    state, values = step(state, event)
                    out.append(values)
                columns = [pa.array(x, t) for x, t in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([found.values, *columns], ["row", *names])

    kinds = arrow_kinds(spark, added)
    row = ", ".join(f"`{c}`: {t}" for c, t in events.dtypes)
    done = begun.select(F.coalesce("before", F.lit(first)).alias("before"), "rows").mapInArrow(work, f"row struct<{row}>, {added}")
    return done.select(*[F.col("row")[c].alias(c) for c in events.columns], *names)


def added_names(spark, added: str) -> list[str]:
    return spark.createDataFrame([], added).columns


def arrow_kinds(spark, added: str) -> list:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in spark.createDataFrame([], added).schema.fields]
