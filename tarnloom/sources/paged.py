"""A remote listing read page by page, as a data source with a partition for each range of pages."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

PAGE = "page int, place int, body string"


class PageRange(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


def scan_pages(spark: SparkSession, fetch: Callable[[int], list], pages: int, pages_a_task: int = 8, pause: float = 0.0) -> DataFrame:
    """(page, place, body): each record of pages 0 to pages - 1 as JSON text, with its page and its place there.

    fetch(page) gives a page's records and runs in the tasks; what it needs has to be reachable from there. A page that fails is
    logged and skipped. pause is the time in seconds between two pages of a task, so a remote service is asked by as many
    tasks as run at once, each at that rate.
    """

    class Reader(DataSourceReader):
        def partitions(self) -> list[PageRange]:
            return [PageRange(k, min(pages, k + pages_a_task)) for k in range(0, pages, pages_a_task)]

        def read(self, partition: PageRange) -> Iterator[tuple]:
            for page in range(partition.first, partition.end):
                if page > partition.first and pause:
                    time.sleep(pause)
                try:
                    records = [json.dumps(r) for r in fetch(page)]
                except Exception as e:  # noqa: BLE001  whatever a fetch of one page runs into
                    logging.getLogger(__name__).warning("page %d skipped: %s", page, e)
                    continue
                yield from ((page, k, r) for k, r in enumerate(records))

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return "paged"

        def schema(self) -> str:
            return PAGE

        def reader(self, schema: StructType) -> Reader:
            return Reader()

    spark.dataSource.register(Paged)
    return spark.read.format("paged").load() if pages > 0 else spark.createDataFrame([], PAGE)


def unversioned_once(records: DataFrame, record_id: Column) -> DataFrame:
    """records with `id`, the record's without what follows its last dot; of each the first by page and place. Null ids go."""
    known = records.withColumn("id", F.regexp_replace(record_id, r"\.[^.]*$", "")).filter("id is not null")
    first = known.groupBy("id").agg(F.min_by(F.struct(*records.columns), F.struct("page", "place")).alias("r"))
    return first.select("id", "r.*")


def folder_of_pages(root: str) -> Callable[[int], list]:
    """A fetch that reads page k from the JSON lines in the folder `root`/page=k of any store that pyarrow opens by its address."""

    def fetch(page: int) -> list:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(root)
        out = []
        for f in sorted(store.get_file_info(fs.FileSelector(f"{path}/page={page}")), key=lambda f: f.path):
            if not f.base_name.startswith(("_", ".")):
                with store.open_input_stream(f.path) as stream:
                    out += [json.loads(line) for line in stream.read().decode().splitlines()]
        return out

    return fetch
