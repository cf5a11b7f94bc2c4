"""A Spark data source of strings: lines of text or sequences of FASTQ records, by byte range, with exact numbers."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a partition and of one read, and of all files up to which the driver counts lines itself.
SPLIT, CHUNK, COUNTED = 64 << 20, 8 << 20, 256 << 20
#: Bits of an id in a stream that say where in its file a string begins.
PLACE_BITS = 40
NEWLINE = 10


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a URI or path, and the path in it."""
    plain = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")
    return pafs.FileSystem.from_uri(plain) if "://" in plain else (pafs.LocalFileSystem(), plain)


def files_of(path: str) -> list[pafs.FileInfo]:
    """The file, or the files of the folder (not those that Spark hides), by name."""
    store, root = store_of(path)
    info = store.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [info]
    found = store.get_file_info(pafs.FileSelector(root))
    return sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)


@dataclass
class Split(InputPartition):
    """Bytes ``begin`` to ``end`` of a file: the lines that begin there. ``first`` is the number of the first of them, or the number of the file
    where lines are not counted."""

    path: str
    begin: int
    end: int
    number: int
    fastq: bool = False
    first: int = 0
    records: int = -1


def splits_of(files: list[pafs.FileInfo], size: int) -> list[Split]:
    out: list[Split] = []
    for f in files:
        out += [Split(f.path, b, min(b + size, f.size), len(out) + k) for k, b in enumerate(range(0, f.size, size))]
    return out


def is_fastq_file(store: pafs.FileSystem, path: str) -> bool:
    with store.open_input_stream(path, compression=None) as f:
        return f.read(1) == b"@"


def line_start(file: pa.NativeFile, begin: int) -> int:
    """The first place from ``begin`` on at which a line begins."""
    at = begin - 1
    while begin:
        data = file.read_at(1 << 16, at)
        if not data:
            return at
        if (k := data.find(b"\n")) >= 0:
            return at + k + 1
        at += len(data)
    return 0


def blocks(file: pa.NativeFile, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Whole lines that begin in the range, several at once, each block with its place; the last line of a file may lack its end."""
    at, size = line_start(file, begin), file.size()
    while at < min(end, size):
        data = file.read_at(CHUNK, at)
        wanted = end - at  # lines that begin from here on are another split's
        while True:
            cut = data.rfind(b"\n") + 1 if wanted >= len(data) else data.find(b"\n", wanted - 1) + 1
            if cut or at + len(data) >= size:
                break
            data += file.read_at(CHUNK, at + len(data))
        data = data[: cut or len(data)]
        yield at, data
        at += len(data)


def lines_in(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each line of a block."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == NEWLINE)
    if not data.endswith(b"\n"):
        ends = np.append(ends, len(data))
    return np.concatenate(([0], ends[:-1] + 1)), ends


def strings(data: bytes, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Those lines as strings; bytes that are no UTF-8 become replacement characters."""
    found = pa.array([data[b:e] for b, e in zip(begin.tolist(), end.tolist())], pa.binary())
    try:
        return found.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in found.to_pylist()], pa.string())


def numbered_lines(split: Split) -> Iterator[pa.RecordBatch]:
    """``i``, ``s`` of a split whose first line's number is known: lines, or of FASTQ each complete record's second line."""
    store, path = store_of(split.path)
    number = split.first
    with store.open_input_file(path) as file:
        for _, data in blocks(file, split.begin, split.end):
            begin, end = lines_in(data)
            i = number + np.arange(len(begin))
            number += len(begin)
            if split.fastq:
                own = (i % 4 == 1) & (i // 4 < split.records)
                i, begin, end = i[own] // 4, begin[own], end[own]
            yield pa.RecordBatch.from_arrays([pa.array(i), strings(data, begin, end)], ["i", "s"])


def found_records(split: Split) -> Iterator[pa.RecordBatch]:
    """The same of a split of which no line's number is known: ``i`` is the file's number and the place in it.

    A record begins where a line has ``@`` and the second after it has ``+``: a line of qualities may begin with ``@`` too, but then a
    sequence, which has no ``+``, is the second after it. A record belongs to the split that it begins in; one that is cut off is left out.
    """
    store, path = store_of(split.path)
    with store.open_input_file(path) as file:
        held: list[tuple[int, bytes]] = []
        known = not split.fastq
        for at, data in blocks(file, split.begin, file.size() if split.fastq else split.end):
            begin, end = lines_in(data)
            if not split.fastq:
                yield pa.RecordBatch.from_arrays([pa.array((split.number << PLACE_BITS) + at + begin), strings(data, begin, end)], ["i", "s"])
                continue
            held += [(at + b, data[b:e]) for b, e in zip(begin.tolist(), end.tolist())]
            while not known and len(held) >= 3:
                known = held[0][1][:1] == b"@" and held[2][1][:1] == b"+"
                if not known:
                    held.pop(0)
            whole = len(held) // 4 * 4 if known else 0
            mine = [(held[k][0], held[k + 1][1]) for k in range(0, whole, 4) if held[k][0] < split.end]
            ids = pa.array([(split.number << PLACE_BITS) + p for p, _ in mine], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array([s.decode("utf-8", "replace") for _, s in mine], pa.string())], ["i", "s"])
            if 4 * len(mine) < whole or (held and held[0][0] >= split.end):
                return
            held = held[whole:]


def count_lines(split: Split) -> int:
    """Lines that begin in a split."""
    store, path = store_of(split.path)
    n = 0
    with store.open_input_file(path) as file:
        for _, data in blocks(file, split.begin, split.end):
            n += data.count(b"\n") + (not data.endswith(b"\n"))
    return n


class StringsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.size = options["path"], int(options.get("splitbytes", SPLIT))
        self.counting = options.get("count", "false").lower() == "true"
        self.counts = json.loads(options["counts"]) if "counts" in options else None
        self.format = options.get("format", "auto")

    def partitions(self) -> list[Split]:
        files = files_of(self.path)
        splits = splits_of(files, self.size)
        if self.counting or not splits:
            return splits or [Split("", 0, 0, -1)]
        if self.counts is None:
            if sum(f.size for f in files) > COUNTED:
                raise ValueError("files of this size are counted by tasks: use threadloom.sources.strings.read_strings")
            self.counts = [count_lines(s) for s in splits]
        store, first = store_of(self.path)[0], 0
        fastq = is_fastq_file(store, splits[0].path) if self.format == "auto" else self.format == "fastq"
        records = sum(self.counts) // 4
        for s, n in zip(splits, self.counts, strict=True):
            s.fastq, s.first, s.records = fastq, first, records
            first += n
        return splits

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if partition.number < 0:
            return
        if self.counting:
            yield pa.RecordBatch.from_arrays([pa.array([partition.number], pa.int64()), pa.array([str(count_lines(partition))])], ["i", "s"])
            return
        yield from numbered_lines(partition)


class StringsStreamReader(DataSourceStreamReader):
    """Files in the order of their time, then name. A file is read once, when it first appears, and must be whole by then."""

    def __init__(self, options: dict[str, str]):
        self.path, self.size = options["path"], int(options.get("splitbytes", SPLIT))

    def _files(self) -> list[pafs.FileInfo]:
        return sorted(files_of(self.path), key=lambda f: (f.mtime_ns or 0, f.path))

    def initialOffset(self) -> dict:
        return {"time": -1, "path": "", "files": 0}

    def latestOffset(self) -> dict:
        files = self._files()
        return {"time": files[-1].mtime_ns or 0, "path": files[-1].path, "files": len(files)} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Split]:
        at = lambda o: (o["time"], o["path"])
        new = [f for f in self._files() if at(start) < (f.mtime_ns or 0, f.path) <= at(end)]
        out = []
        for k, f in enumerate(new):
            fastq = is_fastq_file(store_of(self.path)[0], f.path)
            for s in splits_of([f], self.size):
                s.number, s.fastq = start["files"] + k, fastq
                out.append(s)
        return out or [Split("", 0, 0, -1)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if partition.number >= 0:
            yield from found_records(partition)


class StringsSource(DataSource):
    """``spark.read.format("threadloom_strings").load(path)``: ``i``, ``s`` of a text or FASTQ file, or of a folder's files one after the other.

    Options: ``format`` (``text``, ``fastq``, or ``auto``: by the first character), ``splitBytes``; ``counts``, the lines of each split as a JSON list, where
    tasks have counted them (``count``: such a job). As a stream each string has the number of its file and its place in it as id.
    """

    @classmethod
    def name(cls) -> str:
        return "threadloom_strings"

    def schema(self) -> str:
        return "i long, s string"

    def reader(self, schema: StructType) -> StringsReader:
        return StringsReader(dict(self.options))

    def streamReader(self, schema: StructType) -> StringsStreamReader:
        return StringsStreamReader(dict(self.options))
