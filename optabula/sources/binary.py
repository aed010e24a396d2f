"""Fixed-width binary records of big-endian doubles, as a Spark data source.

Files are cut into byte ranges on record boundaries, so one large file is read by many
tasks, and every record knows its global position (files in name order). A range of positions or
block ids is cut out of the files before anything is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from ..cluster import qualified

READ_BYTES = 8 << 20

# Where this is on, filters reach the files.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

# Most byte ranges one scan is cut into; more would burden the driver.
MAX_SPLITS = 100_000


def open_filesystem(path):
    """(filesystem, path) of a qualified URI of a scheme pyarrow knows (file, hdfs, s3, s3a, gs)."""
    from pyarrow import fs

    scheme, found, rest = path.partition(":")
    if not found or "/" in scheme:
        raise ValueError(f"{path} names no file system; qualify it first")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri("s3:" + rest if scheme == "s3a" else path)


def data_files(path):
    """Sorted (path, size) of the data files at a path, hidden files left out."""
    from pyarrow import fs

    system, root = open_filesystem(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = [info]
    if info.type == fs.FileType.Directory:
        infos = system.get_file_info(fs.FileSelector(root, recursive=True))
    files = [
        (i.path, i.size) for i in infos
        if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))
    ]
    return sorted(files)


class Split(InputPartition):
    def __init__(self, ranges, first_record):
        self.ranges, self.first_record = ranges, first_record


def clip(files, first, end):
    """(path, start, length) of the bytes ``first`` to ``end`` of the files, one after the other."""
    kept, at = [], 0
    for path, size in files:
        low, high = max(first - at, 0), min(end - at, size)
        if low < high:
            kept.append((path, low, high - low))
        at += size
    return kept


def cut_ranges(kept, step):
    """Cuts byte ranges, one after the other, into splits of ``step`` bytes: lists of byte ranges."""
    splits, ranges, room = [], [], step
    for path, start, size in kept:
        end = start + size
        while start < end:
            length = min(room, end - start)
            ranges.append((path, start, length))
            start, room = start + length, room - length
            if not room:
                splits.append(ranges)
                ranges, room = [], step
    return [*splits, ranges] if ranges else splits


def id_range(condition):
    """(first, end) of the integers a filter admits at most; None for filters that set no range."""
    value = getattr(condition, "value", None)
    if isinstance(condition, In):
        values = [v for v in value if v is not None]
        if all(isinstance(v, int) for v in values):
            return (min(values), max(values) + 1) if values else (0, 0)
    elif isinstance(value, int):
        if isinstance(condition, EqualTo):
            return value, value + 1
        if isinstance(condition, (GreaterThan, GreaterThanOrEqual)):
            return value + isinstance(condition, GreaterThan), None
        if isinstance(condition, (LessThan, LessThanOrEqual)):
            return 0, value + isinstance(condition, LessThanOrEqual)
    return None


class FixedDoublesReader(DataSourceReader):
    """Rows, or blocks of ``block_rows`` rows of which the last one may be shorter.

    Splits are whole blocks of all files in a row, so blocks may go over file ends and many small
    files share a split.
    """

    def __init__(self, path, record_values, split_bytes, block_rows=None):
        self.path, self.record_values, self.block_rows = path, record_values, block_rows
        self.record_bytes = 8 * record_values
        self.unit_bytes = self.record_bytes * (block_rows or 1)
        self.split_bytes = max(1, split_bytes // self.unit_bytes) * self.unit_bytes
        self.first, self.end = 0, None

    def narrow(self, first, end):
        """Keeps the positions (or block ids) from ``first`` to before ``end``."""
        self.first = max(self.first, first)
        if end is not None:
            self.end = end if self.end is None else min(self.end, end)

    def partitions(self):
        files = data_files(self.path)
        for path, size in files:
            if size % self.record_bytes:
                raise ValueError(
                    f"{path}: {size} bytes are no multiple of the record of "
                    f"{self.record_bytes} bytes"
                )
        total = sum(size for _, size in files)
        first = self.first * self.unit_bytes
        kept = clip(files, first, total if self.end is None else self.end * self.unit_bytes)
        # Ranges are read in READ_BYTES pieces, so very large inputs may use larger splits.
        fewest = -(-sum(size for _, _, size in kept) // MAX_SPLITS)
        step = max(self.split_bytes, -(-fewest // self.unit_bytes) * self.unit_bytes)
        return [Split(ranges, (first + k * step) // self.record_bytes)
                for k, ranges in enumerate(cut_ranges(kept, step))]

    def pieces(self, ranges):
        """Bytes of whole units, then what is left of the last block."""
        system, _ = open_filesystem(self.path)
        held = b""
        for path, start, length in ranges:
            with system.open_input_file(path) as source:
                for at in range(start, start + length, READ_BYTES):
                    size = min(READ_BYTES, start + length - at)
                    data = source.read_at(size, at)
                    if len(data) != size:
                        raise ValueError(f"{path}: short read at {at}")
                    held += data
                    whole = len(held) // self.unit_bytes * self.unit_bytes
                    if whole:
                        yield held[:whole]
                        held = held[whole:]
        if held:
            yield held

    def read(self, split):
        import numpy as np
        import pyarrow as pa

        if split is None:  # no data files: Spark asks for one read without a partition
            return
        position = split.first_record
        for data in self.pieces(split.ranges):
            values = np.frombuffer(data, dtype=">f8").astype(np.float64)
            n = len(data) // self.record_bytes
            step = self.block_rows or 1
            starts = np.arange(0, n, step)
            rows = np.minimum(step, n - starts)
            offsets = np.append(starts, n).astype(np.int32) * self.record_values
            vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            ids = pa.array((position + starts) // step)
            if self.block_rows is None:
                yield pa.RecordBatch.from_arrays([ids, vectors], ["pos", "values"])
            else:
                width = np.full(len(starts), self.record_values, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(rows.astype(np.int32)), pa.array(width), vectors],
                    ["block_id", "n_rows", "n_cols", "values"])
            position += n


class PushingReader(FixedDoublesReader):
    """Takes its range from the query's filters on ``pos`` or ``block_id``."""

    def pushFilters(self, filters):
        name = ("pos",) if self.block_rows is None else ("block_id",)
        for condition in filters:
            limits = id_range(condition) if getattr(condition, "attribute", None) == name else None
            if limits is not None:
                self.narrow(*limits)
            if limits is None or isinstance(condition, In):
                yield condition


class FixedDoubles(DataSource):
    """``spark.read.format("fixed_doubles").option("record_values", d).load(path)``

    With option ``block_rows`` it gives blocks of so many records. Options ``first`` and ``end``
    keep a range of positions or block ids. With option ``push_filters`` filters on them set the
    range; Spark asks for ``spark.sql.python.filterPushdown.enabled`` then.
    """

    @classmethod
    def name(cls):
        return "fixed_doubles"

    def schema(self):
        if "block_rows" in self.options:
            return "block_id long, n_rows int, n_cols int, values array<double>"
        return "pos long, values array<double>"

    def reader(self, schema):
        values = int(self.options.get("record_values", "0"))
        if values < 1:
            raise ValueError("option record_values is required and must be positive")
        split_bytes = int(self.options.get("split_bytes", str(128 << 20)))
        rows = self.options.get("block_rows")
        if rows is not None and int(rows) < 1:
            raise ValueError("option block_rows must be positive")
        first, end = int(self.options.get("first", "0")), self.options.get("end")
        if first < 0 or end is not None and int(end) < 0:
            raise ValueError("options first and end must not be negative")
        kind = (PushingReader if self.options.get("push_filters", "false").lower() == "true"
                else FixedDoublesReader)
        reader = kind(self.options["path"], values, split_bytes, None if rows is None else int(rows))
        reader.narrow(first, None if end is None else int(end))
        return reader


def _load(spark, path, split_bytes, first, end, **options):
    spark.dataSource.register(FixedDoubles)
    options |= {"first": first, "push_filters": spark.conf.get(PUSHDOWN, "false")}
    if end is not None:
        options["end"] = end
    return (spark.read.format("fixed_doubles").options(split_bytes=split_bytes, **options)
            .load(qualified(spark, path)))


def read_binary_rows(spark: SparkSession, path: str, n_cols: int, split_bytes: int = 128 << 20,
                     first: int = 0, end: int | None = None) -> DataFrame:
    """Row scan: (pos, values), one record of n_cols doubles per row.

    Only the bytes of positions ``first`` to before ``end`` are read, and of those only what filters
    on ``pos`` admit where the session pushes filters to Python sources (``PUSHDOWN``).
    """
    return _load(spark, path, split_bytes, first, end, record_values=n_cols)


def read_binary_blocks(spark: SparkSession, path: str, n_rows: int, n_cols: int,
                       split_bytes: int = 128 << 20, first: int = 0,
                       end: int | None = None) -> DataFrame:
    """Block scan: (block_id, n_rows, n_cols, values), n_rows rows each; the last may be shorter.

    ``first``, ``end`` and filters on ``block_id`` as in ``read_binary_rows``.
    """
    return _load(spark, path, split_bytes, first, end, record_values=n_cols, block_rows=n_rows)
