"""Keyed state over streams, in event time: answers that a later question makes stale, rows of open keys, and the mode of an external program.

Rows of a key may come in any order within the watermark's delay. They are kept until the watermark has passed them, and a timer then takes them in
order of time; so what a key's state is never depends on how rows were cut into batches, and a restart from a checkpoint goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rocks keeps the states of a query; timers and several states a key need it.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Takes the rows of a key in order of (`at`, `nth`), once the watermark has passed them. `at` is in microseconds, `nth` orders what happens at one time."""

    #: The columns of a row after `at` and `nth`, as the buffer keeps them.
    fields = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at long, nth long, {self.fields}")
        self.names = [f.strip().split(" ")[0] for f in self.fields.split(",")]
        self.states(handle)

    def states(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def step(self, key: tuple, row: Row) -> Iterator[Row]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r["at"], r["nth"], *(r[n] for n in self.names)) for r in rows]
        self.waiting.appendList(new)
        for due in {-(-at // 1000) for at, *_ in new}:
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs() * 1000
        every = [tuple(r) for r in self.waiting.get()]
        ready = sorted(r for r in every if r[0] <= due)
        later = [r for r in every if r[0] > due]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        for r in ready:
            yield from self.step(key, Row("at", "nth", *self.names)(*r))

    def close(self) -> None:
        pass


class Answers(InOrder):
    """Questions (ask: a version is wanted), their answers (done) and evictions (close) of a key.

    A question whose version is kept is answered from there. Else its answer is returned when it is done, and kept only if no question or eviction came in between.
    """

    fields = "id long, kind string, version long"

    def states(self, handle):
        self.seq = handle.getValueState("seq", "seq long")
        self.kept = handle.getValueState("kept", "version long, id long")
        self.asked = handle.getMapState("asked", "id long", "seq long, version long")

    def step(self, key, row):
        seq = self.seq.get()[0] if self.seq.exists() else 0
        if row.kind == "close":
            self.kept.clear()
            self.seq.update((seq + 1,))
        elif row.kind == "ask":
            kept = self.kept.get() if self.kept.exists() else None
            if kept and kept[0] == row.version:
                yield Row(key=key[0], id=row.id, stored=False, kept_id=kept[1])
            else:
                self.seq.update((seq + 1,))
                self.asked.updateValue((row.id,), (seq + 1, row.version))
        elif self.asked.containsKey((row.id,)):
            own, version = self.asked.getValue((row.id,))
            self.asked.removeKey((row.id,))
            if own == seq:
                self.kept.update((version, row.id))
            yield Row(key=key[0], id=row.id, stored=own == seq, kept_id=None)


class OpenRows(InOrder):
    """Rows of a key until it is closed: a row comes with `open` true, and once more with false when its key is closed."""

    fields = "id long, kind string"

    def states(self, handle):
        self.open = handle.getListState("open", "id long")

    def step(self, key, row):
        if row.kind == "close":
            for r in list(self.open.get()):
                yield Row(key=key[0], id=r[0], open=False)
            self.open.clear()
        else:
            self.open.appendValue((row.id,))
            yield Row(key=key[0], id=row.id, open=True)


class Modes(InOrder):
    """The mode of an external program: a setting decides it, a run that finds the program gone makes it unavailable until the next setting. Runs say what they met."""

    fields = "id long, kind string, mode string, binary string, err string"

    def states(self, handle):
        self.mode = handle.getValueState("mode", "mode string, binary string, err string")

    def step(self, key, row):
        mode, binary, err = self.mode.get() if self.mode.exists() else ("disabled", None, "DISABLED")
        if row.kind == "set":
            mode, binary, err = row.mode, row.binary, row.err
            self.mode.update((mode, binary, err))
        met = None
        if row.kind == "run":
            met = row.err if mode == "available" else err
            if mode == "available" and row.err in GONE:
                self.mode.update(("unavailable", binary, row.err))
        yield Row(key=key[0], id=row.id, mode=mode, binary=binary, met=met)


#: Errors that say that a program is not there or may not be run.
GONE = ("ENOENT", "EACCES")
OUTPUT = {Answers: "key {key}, id long, stored boolean, kept_id long", OpenRows: "key {key}, id long, open boolean", Modes: "key {key}, id long, mode string, binary string, met string"}


def kept_in_order(rows: DataFrame, processor: type[InOrder], key: str, ts: str, nth: str, delay: str = "10 seconds") -> DataFrame:
    """The processor's rows over a stream `rows`, which has its fields, a time `ts` and an order `nth` within one time."""
    kind = rows.schema[key].dataType.simpleString()
    marked = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).withColumn("at", F.unix_micros(ts)).withColumn("nth", F.col(nth).cast("long"))
    columns = [F.col(key).alias("key"), ts, "at", "nth", *[f.strip().split(" ")[0] for f in processor.fields.split(",")]]
    return marked.select(*columns).groupBy("key").transformWithState(processor(), OUTPUT[processor].format(key=kind), "append", "EventTime")
