"""A catalogue that is stored page by page, as a data source: `spark.read.format("stored_pages").load(folder)`.

folder holds `query=<q>/page=<n>/` with the answer of each page in it, as `df.write.partitionBy("query", "page").text(folder)` leaves it. Partitions are ranges of
pages of one query. A range is read in order, and no farther than its first page that is missing or lists no rows: its row, with `listed` 0,
says so to `before_the_end`. Equalities on query and bounds on page, where Spark hands them down, leave out ranges and pages before anything is read.
"""

from __future__ import annotations

import json
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from weftline.shared import store
from weftline.sources.tables import ROW_KEYS


def listed(payload: str) -> int:
    """How many rows an answer lists, under the known keys at the top or one object down, or by itself; 0 of what is no answer."""
    try:
        top = json.loads(payload)
    except ValueError:
        return 0
    if isinstance(top, list):
        return len(top)
    inner = [x for x in (top.get(k) for k in ROW_KEYS) if isinstance(x, dict)] if isinstance(top, dict) else []
    lists = (x.get(k) for x in ([top] if isinstance(top, dict) else []) + inner for k in ROW_KEYS)
    return next((len(x) for x in lists if isinstance(x, list) and x), 0)


@dataclass
class PageRange(InputPartition):
    query: str
    folder: str
    start: int
    stop: int


class StoredPages(DataSource):
    """Options: pagesATask (20), and mostPages (1000), beyond which no page is looked for."""

    @classmethod
    def name(cls) -> str:
        return "stored_pages"

    def schema(self) -> str:
        return "query string, page int, payload string, listed int"

    def reader(self, schema) -> StoredPagesReader:
        return StoredPagesReader(self.options)


class StoredPagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.step, self.most = int(options.get("pagesATask", 20)), int(options.get("mostPages", 1000))
        self.queries: set[str] | None = None
        self.start, self.stop = 0, self.most

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            known = True
            if isinstance(f, EqualTo | In) and f.attribute == ("query",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.queries = asked if self.queries is None else self.queries & asked
            elif isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("page",):
                self.start = max(self.start, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThan | LessThanOrEqual) and f.attribute == ("page",):
                self.stop = min(self.stop, f.value + isinstance(f, LessThanOrEqual))
            elif isinstance(f, EqualTo) and f.attribute == ("page",):
                self.start, self.stop = max(self.start, f.value), min(self.stop, f.value + 1)
            else:
                known = False
            if not known:
                yield f

    def partitions(self) -> list[PageRange]:
        fs, root = store(self.folder)
        folders = sorted(f.base_name for f in fs.get_file_info(FileSelector(root)) if f.base_name.startswith("query="))
        named = [(urllib.parse.unquote(f.removeprefix("query=")), f) for f in folders]
        return [PageRange(q, f, i, min(i + self.step, self.stop)) for q, f in named if self.queries is None or q in self.queries for i in range(self.start, self.stop, self.step)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        fs, root = store(self.folder)
        for page in range(partition.start, partition.stop):
            at = f"{root}/{partition.folder}/page={page}"
            files = [f.path for f in fs.get_file_info(FileSelector(at, allow_not_found=True)) if f.type == FileType.File and not f.base_name.startswith(("_", "."))]
            payload = "".join(fs.open_input_file(f).read().decode() for f in sorted(files)).rstrip("\n")
            n = listed(payload)
            yield partition.query, page, payload, n
            if not n:
                return


def stored_pages(spark: SparkSession, folder: str, pages_a_task: int = 20, most_pages: int = 1000) -> DataFrame:
    """query, page, payload, listed of stored pages, each range to its first empty page, which is there too."""
    spark.dataSource.register(StoredPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("stored_pages").option("pagesATask", pages_a_task).option("mostPages", most_pages).load(folder)


def before_the_end(pages: DataFrame) -> DataFrame:
    """Of stored pages, those of each query before its first empty one, and before the number that the answers themselves give."""
    given, w = F.get_json_object("payload", "$.totalPages").try_cast("int"), Window.partitionBy("query")  # a query has mostPages rows at most
    end = F.least(F.min(F.when(F.col("listed") == 0, F.col("page"))).over(w), F.max(given).over(w))
    return pages.withColumn("_end", end).filter("_end is null or page < _end").drop("_end", "listed")
