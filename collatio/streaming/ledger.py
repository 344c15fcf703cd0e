"""The budget ledger as a stream: reservations are held in state, and a timer ends those that are never settled."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ledger import INTERRUPTED

OUT = "run string, place int, case_id string, state string, charged long, reservation_retained boolean, account long, error string"
_NAMES = ["run", "place", "case_id", "state", "charged", "reservation_retained", "account", "error"]


class _Requests(StatefulProcessor):
    """Of a run: what is accounted, the last place reserved, and the open reservations with their deadlines."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.account = handle.getValueState("account", "total long")
        self.last = handle.getValueState("last", "place int")
        self.open = handle.getMapState("open", "place int", "case_id string, reserved long, deadline long")

    def _ended(self, run: str, place: int) -> tuple:
        case, reserved, _ = self.open.getValue((place,))
        self.open.removeKey((place,))
        return run, place, case, "interrupted", reserved, True, None, INTERRUPTED

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        run, out = key[0], []
        total = self.account.get()[0] if self.account.exists() else 0
        last = self.last.get()[0] if self.last.exists() else None
        for r in pd.concat(list(rows)).sort_values(["ms", "seq"]).itertuples():
            if r.kind == "reserve" and (last is None or r.place > last):
                last, deadline = int(r.place), int(r.ms) + self.wait
                total += int(r.reserved)
                self.open.updateValue((last,), (r.case_id, int(r.reserved), deadline))
                self.handle.registerTimer(deadline)
            elif r.kind == "settle" and self.open.containsKey((int(r.place),)):
                case, reserved, deadline = self.open.getValue((int(r.place),))
                if r.ms < deadline:
                    unknown = pd.isna(r.observed)
                    charged = reserved if unknown else int(r.observed)
                    total += charged - reserved
                    self.open.removeKey((int(r.place),))
                    out.append((run, int(r.place), case, "uncertain" if unknown else "settled", charged, unknown, total, None))
            elif r.kind == "resume":
                out += [self._ended(run, place) for place in sorted(p for (p,) in self.open.keys())]
        self.account.update((total,))
        if last is not None:
            self.last.update((last,))
        yield _frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = expiredTimerInfo.getExpiryTimeInMs()
        yield _frame([self._ended(key[0], place) for place in sorted(p for (p,), v in self.open.iterator() if v[2] <= due)])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES).astype({"place": "int32", "charged": "int64", "reservation_retained": "bool", "account": "Int64"})


def stream_requests(log: DataFrame, wait: int, late: str = "10 seconds") -> DataFrame:
    """The requests of `ledger.requests` as they end. Events may be `late` by so much; a reservation that is not settled
    `wait` milliseconds on is interrupted once the stream's time has passed that.

    The session needs the RocksDB state store. A run's state is its open reservations and two numbers.
    """
    own = log.withWatermark("at", late).select(F.col("run").cast("string").alias("run"), "at", F.unix_millis("at").alias("ms"), "seq", "kind", "place", "case_id", F.col("reserved").cast("long").alias("reserved"), F.col("observed").cast("long").alias("observed"))
    return own.groupBy("run").transformWithStateInPandas(statefulProcessor=_Requests(wait), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
