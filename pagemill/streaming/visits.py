"""Visit counts and repeat flags as keyed state, inside the stream."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OUT = "site_key string, url string, visits long, first boolean, repeated boolean"


class VisitCounter(StatefulProcessor):
    """One value for each (site, URL): how often it was visited. With a time to live a
    URL is forgotten that long after its last visit."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.visits = handle.getValueState("visits", "n long", self.ttl_ms)

    def handleInputRows(self, key, rows, timer_values):
        state = self.visits.get()
        before = state[0] if state else 0
        total = before + sum(row["n"] for row in rows)
        self.visits.update((total,))
        yield Row(site_key=key[0], url=key[1], visits=total, first=before == 0, repeated=total > 1)

    def close(self) -> None:
        pass


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one batch that visit the same URL as one, so that a hot URL sends its key
    a row per batch instead of a row per visit."""
    for batch in batches:
        if batch.num_rows:
            grouped = pa.Table.from_batches([batch]).group_by(["site_key", "url"], use_threads=False).aggregate([([], "count_all")])
            n = pc.cast(grouped.column("count_all"), pa.int64())
            made = pa.table({"site_key": grouped.column("site_key"), "url": grouped.column("url"), "n": n})
            yield from made.combine_chunks().to_batches()


def flagged_visits(rows: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(site_key, url, visits, first, repeated) as visits arrive, for update mode: the
    running number of visits, whether this is the first time the URL is seen, and whether
    it has been visited before or more than once. A row stands for all visits of a
    micro-batch to its URL. With `ttl_ms`, state is bounded by what was visited that recently;
    see `jobs.write_batches` for streams that end."""
    combined = rows.select("site_key", "url").mapInArrow(_combined, "site_key string, url string, n long")
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return combined.groupBy("site_key", "url").transformWithState(VisitCounter(ttl_ms), _OUT, "Update", mode)


# Ship this module inside the operator, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
