"""A Parquet log as a data source of block ranges, in batch and as a stream.

Batch: one partition for each range of ``width`` blocks that some file has rows of, or with ``rows`` for as many neighbouring ranges as have some so many rows by the
files' statistics; comparisons of the height and equalities that Spark pushes narrow the ranges and are applied while reading. Stream: the offset is a height, a batch reads at most ``batch`` blocks above the last one.
Files and row groups whose statistics lie outside a range aren't read.

``path`` is a folder or URI that Arrow opens on the driver and on executors; logs in stores that only Spark reads are first written to a shared folder.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType


@dataclass
class Blocks(InputPartition):
    """The blocks from first to last, and the files that may have rows of them."""

    first: int
    last: int
    files: tuple[str, ...]


@dataclass
class Options:
    path: str
    height: str
    width: int
    batch: int
    first: int | None
    last: int | None
    checkpoint: str | None
    rows: int | None = None

    @classmethod
    def of(cls, given: dict[str, str]) -> Options:
        number = lambda k, default=None: int(given[k]) if k in given else default
        options = cls(given["path"], given.get("height", "block_number"), number("width", 1000), number("batch", 10_000), number("from"), number("to"), given.get("checkpoint"), number("rows"))
        if options.width < 1 or options.batch < 1:
            raise ValueError("width and batch are at least 1")
        if options.first is not None and options.last is not None and options.first > options.last:
            raise ValueError("the range ends before it begins")
        return options

    def opened(self, files: tuple[str, ...] | None = None) -> ds.Dataset:
        system, at = _located(self.path)
        return ds.dataset(list(files) if files else at, format="parquet", filesystem=system)

    def spans(self) -> list[tuple[str, int, int]]:
        """(file, lowest height, highest height) from the statistics of every file with rows, within the asked range."""
        return [s[:3] for s in self.counted_spans()]

    def counted_spans(self) -> list[tuple[str, int, int, float]]:
        """As ``spans``, with the rows that a file has for each height on average."""
        found = []
        for part in self.opened().get_fragments():
            column = part.physical_schema.get_field_index(self.height)
            held = [s for g in range(part.metadata.num_row_groups) if (s := part.metadata.row_group(g).column(column).statistics) is not None and s.has_min_max]
            if held:
                low, high = min(s.min for s in held), max(s.max for s in held)
                if (self.first is None or high >= self.first) and (self.last is None or low <= self.last):
                    rows = part.metadata.num_rows / (high - low + 1)
                    found.append((part.path, low if self.first is None else max(low, self.first), high if self.last is None else min(high, self.last), rows))
        return found


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")


def reached(checkpoint: str) -> int | None:
    """The height up to which a query with one source has planned batches, by its checkpoint; none if it hasn't run yet."""
    system, at = _located(f"{checkpoint.rstrip('/')}/offsets")
    names = [f.base_name for f in system.get_file_info(pafs.FileSelector(at, allow_not_found=True))]
    last = max((n for n in names if n.isdigit()), key=int, default=None)
    if last is None:
        return None
    with system.open_input_stream(f"{at}/{last}") as f:
        return json.loads(f.read().decode().splitlines()[-1])["height"]


def planned(spans: list[tuple[str, int, int]], first: int, last: int, width: int) -> list[Blocks]:
    """Ranges of ``width`` blocks from first to last, without those that no file has rows of."""
    ranges, inside = [], sorted((max(low, first), min(high, last), f) for f, low, high in spans if low <= last and high >= first)
    starts = sorted({first + k * width for low, high, _ in inside for k in range((low - first) // width, (high - first) // width + 1)})
    at, here = 0, []
    for start in starts:
        end = min(start + width - 1, last)
        while at < len(inside) and inside[at][0] <= end:
            here.append(inside[at])
            at += 1
        here = [x for x in here if x[1] >= start]
        ranges.append(Blocks(start, end, tuple(f for _, _, f in here)))
    return ranges


def widened(spans: list[tuple[str, int, int, float]], width: int, rows: int) -> int:
    """The multiple of ``width`` blocks that has some ``rows`` rows where the files have most for each height; ``width`` itself if that has more.

    A task costs more than what a short range has; ranges aren't cut, so that each lies in one partition."""
    steps = sorted(x for _, low, high, n in spans for x in ((low, n), (high + 1, -n)))
    most, now = 0.0, 0.0
    for _, n in steps:
        now += n
        most = max(most, now)
    return width * max(1, int(rows / most / width)) if most > 0 else width


def read_blocks(options: Options, schema: StructType, part: Blocks, also: list[ds.Expression]) -> Iterator[pa.RecordBatch]:
    wanted = (ds.field(options.height) >= part.first) & (ds.field(options.height) <= part.last)
    for e in also:
        wanted &= e
    shape = to_arrow_schema(schema)
    for batch in options.opened(part.files).scanner(columns=schema.names, filter=wanted).to_batches():
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in shape], schema=shape)


class BlockReader(DataSourceReader):
    def __init__(self, options: Options, schema: StructType):
        self.options, self.schema = options, schema
        self.also: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of the height with whole numbers, and equalities of other columns; Spark applies what is left."""
        o = self.options
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            values = list(f.value) if isinstance(f, In) else [getattr(f, "value", None)]
            whole = name == o.height and isinstance(values[0], int)
            if whole and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                low = values[0] + isinstance(f, GreaterThan)
                o.first = low if o.first is None else max(o.first, low)
            elif whole and isinstance(f, (LessThan, LessThanOrEqual)):
                high = values[0] - isinstance(f, LessThan)
                o.last = high if o.last is None else min(o.last, high)
            elif name in self.schema.names and isinstance(f, (EqualTo, In)) and all(isinstance(v, (int, str)) and not isinstance(v, bool) for v in values):
                self.also.append((name, values))
                if whole:
                    o.first, o.last = max(min(values), min(values) if o.first is None else o.first), min(max(values), max(values) if o.last is None else o.last)
            else:
                yield f

    def partitions(self) -> list[Blocks]:
        counted = self.options.counted_spans()
        if not counted:
            return [Blocks(0, -1, ())]
        spans, width = [s[:3] for s in counted], self.options.width
        width = widened(counted, width, self.options.rows) if self.options.rows else width
        return planned(spans, min(s[1] for s in spans), max(s[2] for s in spans), width) or [Blocks(0, -1, ())]

    def read(self, part: Blocks) -> Iterator[pa.RecordBatch]:
        if part.files:
            yield from read_blocks(self.options, self.schema, part, [ds.field(n).isin(v) for n, v in self.also])


class BlockStream(DataSourceStreamReader):
    """Heights as offsets. With the query's ``checkpoint`` batches are bounded from where it was; Spark doesn't tell a reader that, and without it
    the first batch after a start reads up to the head."""

    def __init__(self, options: Options, schema: StructType):
        self.options, self.schema, self.at = options, schema, None
        if options.checkpoint:
            was = reached(options.checkpoint)
            self.at = self.begin() - 1 if was is None else was

    def begin(self) -> int:
        first = self.options.first
        return first if first is not None else min((s[1] for s in self.options.spans()), default=0)

    def initialOffset(self) -> dict:
        return {"height": self.begin() - 1}

    def latestOffset(self) -> dict:
        head = max((s[2] for s in self.options.spans()), default=self.begin() - 1)
        return {"height": head if self.at is None else max(self.at, min(head, self.at + self.options.batch))}

    def partitions(self, start: dict, end: dict) -> list[Blocks]:
        self.at = max(end["height"], start["height"])
        return planned(self.options.spans(), start["height"] + 1, end["height"], self.options.width) or [Blocks(0, -1, ())]

    def commit(self, end: dict) -> None:
        self.at = max(self.at if self.at is not None else end["height"], end["height"])

    def read(self, part: Blocks) -> Iterator[pa.RecordBatch]:
        if part.files:
            yield from read_blocks(self.options, self.schema, part, [])


class BlockLog(DataSource):
    """Options: path, height (the column of the height), width (blocks of a range), rows (of a partition of several ranges), batch (blocks of a micro-batch), from, to, and for streams checkpoint (the query's)."""

    @classmethod
    def name(cls) -> str:
        return "block_log"

    def schema(self) -> StructType:
        return from_arrow_schema(Options.of(self.options).opened().schema)

    def reader(self, schema: StructType) -> BlockReader:
        return BlockReader(Options.of(self.options), schema)

    def streamReader(self, schema: StructType) -> BlockStream:
        return BlockStream(Options.of(self.options), schema)


def _with_options(reader, path: str, height: str, options: dict):
    reader = reader.format("block_log").option("path", path).option("height", height)
    for k, v in options.items():
        reader = reader.option(k.rstrip("_"), str(v))
    return reader


def block_log(spark: SparkSession, path: str, height: str = "block_number", **options: int) -> DataFrame:
    """The log as a table; ``width``, ``rows``, ``from_`` and ``to`` as in :class:`BlockLog`."""
    spark.dataSource.register(BlockLog)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return _with_options(spark.read, path, height, options).load()


def block_stream(spark: SparkSession, path: str, height: str = "block_number", **options: int | str) -> DataFrame:
    """The log as a stream from its lowest height on, ``batch`` blocks at a time; ``checkpoint`` is that of the query, as in :class:`BlockStream`."""
    spark.dataSource.register(BlockLog)
    return _with_options(spark.readStream, path, height, options).load()
