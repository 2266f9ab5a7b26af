"""Runs that are still being acquired: each is given once, when its last injection is there or when nothing more comes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROWS = "run string, status string, injections long, unstamped long, missing long, started timestamp"
STAMP = "d-MMM-yy, HH:mm:ss"


class _Runs(StatefulProcessor):
    """State of a run: an entry for each injection, and one row of what is planned and whether it was given."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "injection string", "started timestamp, acquiring boolean")
        self.about = handle.getValueState("about", "planned long, given boolean, last long")

    def _row(self, run, status, planned):
        n, unstamped, busy, first = 0, 0, 0, None
        for _, (started, acquiring) in self.seen.iterator():
            n, unstamped, busy = n + 1, unstamped + (started is None), busy + acquiring
            first = started if first is None or started is not None and started < first else first
        missing = max((planned or 0) - n, 0) + busy
        return status, missing, (run, status, n, unstamped, missing, first)

    def handleInputRows(self, key, rows, timerValues):
        planned, given, last = self.about.get() if self.about.exists() else (None, False, 0)
        for pdf in rows:
            for r in pdf.itertuples():
                last = max(last, r.at_ms)
                if given:
                    continue
                planned = max(planned or 0, int(r.planned)) if r.planned == r.planned and r.planned is not None else planned
                started = None if pd.isna(r.started) else r.started.to_pydatetime()
                name = (r.injection,)
                old = self.seen.getValue(name) if self.seen.containsKey(name) else (None, True)
                # what was finished stays so, and a stamp stays: rows may come in any order
                self.seen.updateValue(name, (old[0] if started is None else started, bool(old[1] and r.acquiring)))
        out = []
        if not given and planned:
            _, missing, row = self._row(key[0], "complete", planned)
            if not missing:
                out, given = [row], True
                self.seen.clear()
        self.about.update((planned, given, last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(last + self.idle_ms)
        yield pd.DataFrame(out, columns=[f.split()[0] for f in ROWS.split(", ")]).astype({"injections": "int64", "unstamped": "int64", "missing": "int64", "started": "datetime64[us]"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        planned, given, _ = self.about.get()
        out = [] if given else [self._row(key[0], "abandoned", planned)[2]]
        self.seen.clear()
        self.about.clear()
        yield pd.DataFrame(out, columns=[f.split()[0] for f in ROWS.split(", ")]).astype({"injections": "int64", "unstamped": "int64", "missing": "int64", "started": "datetime64[us]"})

    def close(self) -> None:
        pass


def acquired_runs(stream: DataFrame, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """run, status, injections, unstamped, missing, started of each run of a stream, once (append mode).

    stream: run, injection, at (timestamp, event time), when (the instrument's stamp, as `16-Oct-26, 17:48:08`), acquiring (still being
    filled; null: no), planned (injections of the run; null: not known). A run is `complete` with the row by which `planned` injections are
    there and none is being filled. A run to which nothing comes for `idle` is `abandoned`; so is one without a plan, and missing counts what
    lacks or was being filled. unstamped counts injections without a stamp in that form; started is the least stamp. Rows may
    repeat and come in any order. State is a row an injection until then; a given run is remembered until nothing came for `idle`, so
    late repeats give nothing more. Rows behind the watermark `late`, and rows without run, injection or at, are left out.
    Needs the RocksDB state store.
    """
    made = stream.where("run is not null and injection is not null and at is not null").withWatermark("at", late)
    shape = F.regexp_extract("when", r"^([0-9]{1,2}-[A-Za-z]{3}-[0-9]{2}, [0-9]{2}:[0-9]{2}:[0-9]{2})$", 1)
    made = made.select("run", "injection", "at", F.unix_millis("at").alias("at_ms"), F.try_to_timestamp(shape, F.lit(STAMP)).alias("started"), F.coalesce("acquiring", F.lit(False)).alias("acquiring"), F.col("planned").cast("double").alias("planned"))
    return made.groupBy("run").transformWithStateInPandas(_Runs(int(pd.Timedelta(idle).total_seconds() * 1000)), ROWS, "append", "eventTime")
