"""One large JSON document, {"questions": [{...}, ...]}, read by many tasks: a Spark data source that cuts files into byte ranges.

Where a range begins, nothing says whether its first byte lies in a string or how deep it is nested. So the ranges are read twice. First each is summed up for both cases, outside and inside a string: the
state at its end, and by how much its brackets nest (a task a range). These sums, a row a range, are put together from the first range on, which gives the state at the start of each. Then each range is read
by a task that knows it, and the elements that begin in the range are taken, the last of them from the bytes behind it. No task holds more than a range and the elements at its end.

Bytes decide alone: a quote, a backslash and a bracket are single bytes in UTF-8 and part of no other character. An element is an object in an array of the document; question files have one such array.
A file whose brackets or quotes don't close fails the read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range; tasks at most, which read the ranges one after another.
RANGE, TASKS = 32 << 20, 256
_QUOTE, _BACK = ord('"'), ord("\\")
_OPEN, _CLOSE = (ord("{"), ord("[")), (ord("}"), ord("]"))


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def files_in(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the *.json files under ``path``, or of the one it is, by name."""
    store, place = opened(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [i for i in store.get_file_info(fs.FileSelector(place, recursive=True)) if i.type == fs.FileType.File and i.base_name.endswith(".json") and not i.base_name.startswith((".", "_"))]
    return sorted((i.path, i.size) for i in found)


@dataclass(frozen=True)
class Cut:
    """Bytes as marks: ``at`` the places of brackets outside strings, ``step`` +1 or -1 for each, and whether the bytes end in a string, and behind an odd run of backslashes."""

    at: np.ndarray
    step: np.ndarray
    in_string: bool
    escaped: bool


def cut(data: bytes, in_string: bool, escaped: bool) -> Cut:
    """The brackets of ``data``, which begins in a string or not, and behind an odd run of backslashes or not."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return Cut(np.zeros(0, np.int64), np.zeros(0, np.int64), in_string, escaped)
    back = b == _BACK
    # the length of the run of backslashes that ends before each byte; one that begins at the first byte goes on the one before
    place = np.arange(len(b))
    last_other = np.maximum.accumulate(np.where(~back, place, -1))
    run = place - last_other  # backslashes up to and with this byte
    run = np.where(last_other < 0, run + escaped, run)
    before = np.concatenate([[int(escaped)], run[:-1]])
    quote = (b == _QUOTE) & (before % 2 == 0)
    inside = (np.cumsum(quote) - quote + in_string) % 2 == 1  # before this byte
    bracket = ~inside & ((b == _OPEN[0]) | (b == _OPEN[1]) | (b == _CLOSE[0]) | (b == _CLOSE[1]))
    at = np.flatnonzero(bracket)
    step = np.where((b[at] == _OPEN[0]) | (b[at] == _OPEN[1]), 1, -1)
    return Cut(at, step, bool((quote.sum() + in_string) % 2), bool(back[-1] and run[-1] % 2))


class JsonRanges(DataSource):
    """The elements of JSON documents, as text, with the file and the byte at which each begins; ``elements`` sets its options."""

    @classmethod
    def name(cls) -> str:
        return "json_ranges"

    def schema(self) -> str:
        return "file string, start long, element string"

    def reader(self, schema) -> JsonRangesReader:
        return JsonRangesReader(self.options)


@dataclass
class ByteRange(InputPartition):
    file: str
    size: int
    begin: int
    end: int
    in_string: bool
    escaped: bool
    depth: int


@dataclass
class Ranges(InputPartition):
    """The ranges of a task, in their order."""

    ranges: list[ByteRange]


class JsonRangesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.states = [tuple(map(int, s.split(","))) for s in options["states"].split(";") if s]
        self.names = options["files"].split("\n")

    def __getstate__(self) -> dict:
        """What a task gets with its ranges: not the states of all the others, which grow with the file."""
        return {"path": self.path}

    def partitions(self) -> list[Ranges]:
        every = [ByteRange(self.names[n], size, begin, end, bool(in_string), bool(escaped), depth) for n, size, begin, end, in_string, escaped, depth in self.states]
        many = -(-len(every) // TASKS) or 1
        return [Ranges(every[a : a + many]) for a in range(0, len(every), many)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for one in partition.ranges:
            yield from self._read(one)

    def _read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        with store.open_input_file(partition.file) as f:
            f.seek(partition.begin)
            data = f.read(partition.end - partition.begin)
            c = cut(data, partition.in_string, partition.escaped)
            depth = partition.depth + np.cumsum(c.step)
            begins = [int(c.at[i]) for i in np.flatnonzero((c.step == 1) & (depth == 3))]  # objects in an array of the document
            if not begins:
                return
            ends = [int(c.at[i]) + 1 for i in np.flatnonzero((c.step == -1) & (depth == 2)) if c.at[i] > begins[0]]
            if len(ends) < len(begins):  # the last one ends behind the range
                level, state = int(depth[-1]), (c.in_string, c.escaped)
                while len(ends) < len(begins):
                    more = f.read(min(RANGE, 1 << 20))
                    if not more:
                        raise ValueError(f"{partition.file} ends inside an element")
                    c = cut(more, *state)
                    depth = level + np.cumsum(c.step)
                    closed = np.flatnonzero((c.step == -1) & (depth == 2))
                    if len(closed):
                        ends.append(len(data) + int(c.at[closed[0]]) + 1)
                    data, level, state = data + more, int(depth[-1]) if len(depth) else level, (c.in_string, c.escaped)
            for a in range(0, len(begins), 1000):
                some = list(zip(begins[a : a + 1000], ends[a : a + 1000]))
                columns = [pa.array([partition.file] * len(some)), pa.array([partition.begin + x for x, _ in some], pa.int64()), pa.array([data[x:y].decode() for x, y in some])]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "start", "element"])


SUMS = "file int, begin long, state int, in_string int, escaped int, nests long"


def range_states(spark: SparkSession, path: str, files: list[tuple[str, int]], size: int = RANGE) -> list[tuple[int, ...]]:
    """(file, its bytes, begin, end, in a string, escaped, depth) of each range of the files: the state at its start. The driver gets four numbers a range and state."""
    ranges = [(n, begin) for n, (_, total) in enumerate(files) for begin in range(0, total, size)]
    if not ranges:
        return []
    names = [name for name, _ in files]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = opened(path)
        for batch in batches:
            for n, begin in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(names[n]) as f:
                    f.seek(begin)
                    data = f.read(size)
                rows = []
                for state in range(4):  # outside or inside a string, behind an even or an odd run of backslashes
                    c = cut(data, bool(state & 1), bool(state & 2))
                    rows.append((n, begin, state, int(c.in_string), int(c.escaped), int(c.step.sum())))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=[x.split()[0] for x in SUMS.split(", ")])

    asked = spark.createDataFrame(ranges, "file int, begin long").repartition(min(len(ranges), TASKS), "file", "begin")
    sums = {(r["file"], r["begin"], r["state"]): r for r in asked.mapInArrow(run, SUMS).collect()}
    out = []
    for n, (_, total) in enumerate(files):
        state, depth = 0, 0
        for begin in range(0, total, size):
            out.append((n, total, begin, min(begin + size, total), state & 1, state >> 1, depth))
            r = sums[n, begin, state]
            state, depth = r["in_string"] + 2 * r["escaped"], depth + r["nests"]
        if state or depth:
            raise ValueError(f"{names[n]} is no whole JSON document")
    return out


def elements(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(file, start, element): each object in the array of each document under ``path``, as JSON text."""
    files = files_in(path)
    spark.dataSource.register(JsonRanges)
    states = ";".join(",".join(map(str, s)) for s in range_states(spark, path, files, size))
    return spark.read.format("json_ranges").option("files", "\n".join(name for name, _ in files)).option("states", states).load(path)
