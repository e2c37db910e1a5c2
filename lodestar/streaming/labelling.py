"""Labels as they come in, judged against each item's state; a restart goes on where the last commit was.

A label row has a key, a sequence number that rises within the key, and a label.
State keeps, for each key, the last number seen, the label that counts, how many
were accepted and whether all so far were valid. Every row comes out with its
verdict: accepted (with the label it replaces), invalid (with the reason; what
counted before still does), or replayed (a number that was seen already, so a
source may send rows twice). in_prefix says whether no row of the key up to this
one was invalid, which is what a recovery may keep.

A trigger bounds what a key has in one batch; its rows are put in order of their
numbers there. State is a few values a key and lives in RocksDB under the
checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .ingest import drain

STATE = "seq long, label string, accepted long, broken boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Labels(StatefulProcessor):
    def __init__(self, valid: list[str], key: str):
        self.valid, self.key = frozenset(valid), key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("labels", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen, label, accepted, broken = self.state.get() if self.state.exists() else (None, None, 0, False)
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = []
        for seq, given in zip(batch["seq"].tolist(), batch["label"].tolist(), strict=True):
            given = None if pd.isna(given) else given
            before = label
            if seen is not None and seq <= seen:
                status, reason = "replayed", "seen before"
            elif given not in self.valid:
                status, reason, broken = "invalid", "no label" if given is None else f"unknown label {given}", True
            else:
                status, reason, label, accepted = "accepted", None, given, accepted + 1
            seen = seq if seen is None else max(seen, seq)
            out.append((key[0], seq, status, reason, before, accepted, not broken))
        self.state.update((seen, label, accepted, broken))
        yield pd.DataFrame(out, columns=[self.key, "seq", "status", "reason", "previous", "accepted", "in_prefix"])

    def close(self) -> None:
        pass


def judged(stream: DataFrame, key: str, seq: str, label: str, valid: list[str], out: str) -> DataFrame:
    """The verdicts of all rows that the stream has now; state and output are under `out`, and a later call goes on from there."""
    spark = stream.sparkSession
    rows = stream.selectExpr(f"`{key}`", f"cast(`{seq}` as long) as seq", f"cast(`{label}` as string) as label").where(f"`{key}` is not null and seq is not null")
    schema = f"`{key}` {stream.schema[key].dataType.simpleString()}, seq long, status string, reason string, previous string, accepted long, in_prefix boolean"
    verdicts = rows.groupBy(key).transformWithStateInPandas(Labels(valid, key), schema, "Append", "None")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return drain(verdicts, out)
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
