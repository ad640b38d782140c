"""Hash-linked records as a stream: the head of each run is keyed state, and records are linked as they arrive."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.trace import GENESIS

#: The state store that keyed state in Python needs; it keeps state on the executors' disks and its changes in the checkpoint.
STATE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_OUT = "run_id bigint, pos bigint, head string"


class Chain(StatefulProcessor):
    """One head for each run, and the records that came before their turn. A record is linked once all records before it are."""

    def __init__(self, genesis: str):
        self.start = hashlib.sha256(genesis.encode()).hexdigest()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "head string, next bigint")
        self.early = handle.getMapState("early", "pos bigint", "body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        head, at = self.head.get() if self.head.exists() else (self.start, 0)
        new = {int(pos): body for part in rows for pos, body in zip(part["pos"], part["body"], strict=True)}
        linked = []
        while at in new or self.early.containsKey((at,)):
            if at in new:
                body = new.pop(at)
            else:
                body = self.early.getValue((at,))[0]
                self.early.removeKey((at,))
            head = hashlib.sha256((head + body).encode()).hexdigest()
            linked.append((key[0], at, head))
            at += 1
        for pos, body in new.items():
            if pos > at:  # one that is linked already came again
                self.early.updateValue((pos,), (body,))
        self.head.update((head, at))
        yield pd.DataFrame(linked, columns=["run_id", "pos", "head"])

    def close(self) -> None:
        pass


def heads(records: DataFrame, genesis: str = GENESIS) -> DataFrame:
    """records: a stream of (run_id, pos, body), positions from 0. (run_id, pos, head) of every record once it is linked.

    A record that comes again is skipped; one that comes early waits in the run's state.
    """
    records.sparkSession.conf.set(*STATE)
    return records.select("run_id", "pos", "body").groupBy("run_id").transformWithStateInPandas(Chain(genesis), outputStructType=_OUT, outputMode="append", timeMode="none")
