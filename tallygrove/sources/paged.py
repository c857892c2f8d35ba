"""A paged API as a Spark data source.

The fetch function is given by the caller (tests use a folder of JSON pages), so no client lives here.
Page and offset modes know every page in advance and read them in parallel, one input partition per
page; cursor and next-link modes learn the next page from the last one and read in one partition per slice.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator

import pyspark.cloudpickle as cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def records_at(body, path: str):
    """The list of records below a dotted path; a single object counts as one record."""
    for step in [s for s in path.split(".") if s]:
        body = body[int(step)] if isinstance(body, list) else (body or {}).get(step)
    return body if isinstance(body, list) else ([] if body is None else [body])


class _Slice(InputPartition):
    def __init__(self, params: dict, first: int, pages: int | None, open_end: bool = False):
        super().__init__(first)
        self.params, self.first, self.pages, self.open_end = params, first, pages, open_end


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        import base64

        self.o = json.loads(options["spec"])
        self.fetch: Callable[[dict], object] = cloudpickle.loads(base64.b64decode(options["fetch"]))

    def partitions(self):
        o = self.o
        slices = o["slices"] or [{}]
        if o["mode"] in ("page", "offset") and o["pages"]:
            return [_Slice(s, i, 1) for s in slices for i in range(o["pages"])]
        return [_Slice(s, 0, 1 if o["mode"] == "none" else o["max_pages"], o["mode"] != "none") for s in slices]

    def read(self, part: _Slice) -> Iterator[tuple]:
        o, cursor = self.o, None
        for i in itertools.count(part.first):
            if part.pages is not None and i >= part.first + part.pages:
                if part.open_end:
                    raise RuntimeError(f"the source has more than {part.pages} pages")
                return
            req = dict(part.params)
            if o["mode"] == "page":
                req["page"] = o["first_page"] + i
            elif o["mode"] == "offset":
                req["offset"] = i * o["size"]
            elif cursor is not None:
                req["cursor"] = cursor
            body = self.fetch(req)
            rows = records_at(body, o["records"]) if body is not None else []
            for r in rows:
                yield (json.dumps(part.params, sort_keys=True), json.dumps(r))
            if o["mode"] in ("cursor", "next_url"):
                nxt = records_at(body, o["next"]) if body else []
                cursor = nxt[0] if nxt else None
                if not cursor:
                    return
            elif not rows or (o["size"] and len(rows) < o["size"]):  # a short page is the last one
                return


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tallygrove_paged"

    def schema(self) -> str:
        return "slice string, record string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)


def read_paged(spark: SparkSession, fetch: Callable[[dict], object], mode: str = "page", records: str = "", next_path: str = "next",
               size: int = 100, pages: int | None = None, first_page: int = 1, max_pages: int | None = None, slices: list[dict] | None = None) -> DataFrame:
    """(slice, record) JSON texts of every page. Modes: none, page, offset, next_url, cursor.

    ``max_pages`` guards against a source that never ends: a read that reaches it fails instead of stopping early.
    """
    import base64

    spark.dataSource.register(PagedSource)
    spec = {"mode": mode, "records": records, "next": next_path, "size": size, "pages": pages, "first_page": first_page,
            "max_pages": max_pages, "slices": slices}
    packed = base64.b64encode(cloudpickle.dumps(fetch)).decode()
    return spark.read.format("tallygrove_paged").option("spec", json.dumps(spec)).option("fetch", packed).load()


def window_slices(partitions: DataFrame, start: str, now: str, step_days: int, lookback_minutes: int = 0) -> DataFrame:
    """One row per (partition, time window) to read: windows of ``step_days`` from start minus the look-back up to now.

    Ends are exclusive, one second after the last covered moment; overlap is removed by the upsert that follows.
    """
    step = step_days
    begin = F.to_timestamp_ntz(F.lit(start)) - F.expr(f"INTERVAL {int(lookback_minutes)} MINUTES")
    stop = F.to_timestamp_ntz(F.lit(now))
    d = partitions.withColumn("window_start", F.explode(F.sequence(begin, stop, F.expr(f"INTERVAL {step} DAYS"))))
    last = F.least(F.col("window_start") + F.expr(f"INTERVAL {step} DAYS"), stop)
    return d.withColumn("window_end", last + F.expr("INTERVAL 1 SECOND")).where(F.col("window_start") < stop)
