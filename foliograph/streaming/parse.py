"""The hierarchical parse on a stream of lines, with the fold of each article as state.

Lines carry an event time ts that rises with line_no within an article. They may come in any order as long as none is later than `late`: what the watermark has not passed yet waits in the
state, the rest is read in the order of line_no. Records are given out as soon as no later line can change them, so the state holds an open record, the open lists and the lines that wait. An article ends when
the watermark is `idle` past its last line; then the rest is given out and its state goes.

The records equal those of `tree.parse` on all lines. Lines later than the watermark are left out, as in any aggregation of Spark behind one; a line that comes after its article has ended begins
a new fold. Lines without ts are left out. Empty streams give nothing.
"""

from __future__ import annotations

import pickle
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.operators.tree import COLUMNS, RECORD, Fold, classified

WHOLE = ("line_no", "page", "w", "h", "number")


def _lines(frame: pd.DataFrame) -> list[SimpleNamespace]:
    rows = frame.astype(object).where(frame.notna(), None).to_dict("records")
    return [SimpleNamespace(**{k: int(v) if k in WHOLE and v is not None else v for k, v in r.items()}) for r in rows]


def _step(idle: int):
    def step(key, frames, state):
        doc, article = key
        fold, waiting, last = pickle.loads(state.get[0]) if state.exists else (Fold(article), [], 0)
        for frame in frames:
            waiting += _lines(frame)
        passed = state.getCurrentWatermarkMs()
        last = max([last, *(x.millis for x in waiting)])
        ready = sorted((x for x in waiting if x.millis <= passed), key=lambda x: x.line_no)
        waiting = [x for x in waiting if x.millis > passed]
        for line in ready:
            fold.read_next(line)
        ended = not waiting and passed >= last + idle
        out = fold.done(ended)
        if ended:
            state.remove()
        else:
            state.update((pickle.dumps((fold, waiting, last)),))
            state.setTimeoutTimestamp(max(passed + 1, min((x.millis for x in waiting), default=last + idle)))
        if out:
            yield pd.DataFrame({"doc_id": [doc] * len(out), **{c: pd.Series([r.get(c) for r in out], dtype=object) for c in COLUMNS}})

    return step


def parse_stream(lines: DataFrame, ts: str = "ts", late: str = "10 minutes", idle: int = 3600) -> DataFrame:
    """RECORDs, as they are finished, of a stream of lines (as for tree.parse, and ts). `idle` is in seconds."""
    marked = lines.where(F.col(ts).isNotNull()).withWatermark(ts, late)
    ready = classified(marked, ts).withColumn("millis", F.unix_millis(ts))
    schema = f"doc_id {dict(lines.dtypes)['doc_id']}, {RECORD}"
    return ready.groupBy("doc_id", "article").applyInPandasWithState(_step(idle * 1000), schema, "fold binary", "append", "EventTimeTimeout")
