"""The binary dataset and map formats: 32-bit integers in native order.

A dataset is grid size, last tick and number of trajectories; per trajectory its
id, its number of samples and their x, y, t; the number of known groups, and per
group its id, size and members. A map begins with the three level bits and the
number of trajectories, and has no groups.

A file is one stream, but where a sample stands in it follows from its trajectory's
place and its own among all samples, and likewise for members. So tasks write their
samples where they belong, beside each other and in any order; a task that runs again
writes the same bytes in the same place. A file is read in ranges, the bounds of which
one pass over the records' heads finds. Both open files as the tasks' machines see them
(a shared folder); for other stores there are ``read_whole`` and ``write_stream``.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from driftmesh.model import SAMPLE
from driftmesh.operators.ranking import rank_keys, ranked_rows
from driftmesh.storage import materialize

#: Bytes of a file that one task reads.
RANGE = 64 << 20
#: Samples handed on at once.
BATCH = 1 << 16
WORD = 4
MEMBER = "group_id long, trajectory_idx long"


def local_path(path: str) -> str | None:
    """The path as ``open`` takes it, or None for a store that only Spark reads."""
    parsed = urlparse(path)
    return path if not parsed.scheme else unquote(parsed.path) if parsed.scheme == "file" else None


def _pack(*numbers: int) -> bytes:
    return np.array(numbers, np.int32).tobytes()


def pack_trajectories(samples: DataFrame) -> DataFrame:
    """trajectory_idx, record: the binary record of each trajectory."""
    triples = F.array_sort(F.collect_list(F.struct("seq", "x", "y", "t")))
    rows = samples.groupBy("trajectory_idx").agg(F.first("trajectory_id").alias("trajectory_id"), triples.alias("s"))
    flat = F.flatten(F.transform("s", lambda s: F.array(s["x"], s["y"], s["t"])))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            records = [_pack(i, len(v) // 3, *v) for i, v in zip(batch["trajectory_id"], batch["v"], strict=True)]
            yield pd.DataFrame({"trajectory_idx": batch["trajectory_idx"], "record": records})

    return rows.select("trajectory_idx", "trajectory_id", flat.alias("v")).mapInPandas(pack, "trajectory_idx long, record binary")


def unpack_trajectories(records: DataFrame) -> DataFrame:
    """The samples of records made by ``pack_trajectories``."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for index, record in zip(batch["trajectory_idx"], batch["record"], strict=True):
                frame = _sample_frame(_trajectories(np.frombuffer(record, np.int32), 0, 1)[0])
                yield frame.assign(trajectory_idx=index)

    return records.select("trajectory_idx", "record").mapInPandas(unpack, SAMPLE)


# writing


def placed_samples(samples: DataFrame, base: int) -> tuple[DataFrame, DataFrame]:
    """Words of samples (place, a, b, c) and of trajectories' heads (place, a, b), from word ``base`` on."""
    ranked = ranked_rows(samples.select("trajectory_idx", "trajectory_id", "seq", "x", "y", "t"), ["trajectory_idx", "seq"], "nth")
    ranked = materialize(ranked, "placed")
    place = F.lit(base) + 2 * (F.col("trajectory_idx") + 1) + 3 * F.col("nth")
    heads = ranked.groupBy("trajectory_idx").agg(F.min("nth").alias("nth"), F.count("*").alias("b"), F.min("trajectory_id").alias("a"))
    return ranked.select(place.alias("place"), F.col("x").alias("a"), F.col("y").alias("b"), F.col("t").alias("c")), heads.select((place - 2).alias("place"), "a", "b")


def placed_members(groups: DataFrame, base: int) -> tuple[DataFrame, DataFrame]:
    """Words of members (place, a) and of groups' heads (place, a, b), from word ``base`` on."""
    members = groups.select("group_id", "trajectory_idx")
    ranked = materialize(ranked_rows(members, ["group_id", "trajectory_idx"], "nth").join(rank_keys(members, ["group_id"], "g"), "group_id"), "placed")
    place = F.lit(base) + 2 * (F.col("g") + 1) + F.col("nth")
    heads = ranked.groupBy("group_id", "g").agg(F.min("nth").alias("nth"), F.count("*").alias("b"))
    return ranked.select(place.alias("place"), F.col("trajectory_idx").alias("a")), heads.select((place - 2).alias("place"), F.col("group_id").alias("a"), "b")


def _write_words(path: str, words: DataFrame) -> None:
    """Every row's numbers at its place; runs of rows that lie next to each other go at once."""
    columns = words.columns[1:]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = os.open(path, os.O_WRONLY)
        try:
            for batch in batches:
                places = batch.column("place").to_numpy()
                order = np.argsort(places)
                numbers = np.stack([batch.column(c).to_numpy() for c in columns], axis=1)[order].astype(np.int32)
                places = places[order]
                cuts = np.flatnonzero(np.diff(places) != len(columns)) + 1
                for begin, end in zip([0, *cuts], [*cuts, len(places)], strict=True):
                    if end > begin:
                        os.pwrite(file, numbers[begin:end].tobytes(), int(places[begin]) * WORD)
            os.fsync(file)
        finally:
            os.close(file)
        yield pa.RecordBatch.from_pydict({"done": pa.array([1], pa.int64())})

    words.mapInArrow(write, "done long").agg(F.sum("done")).collect()


@contextmanager
def _created(path: str, head: bytes) -> Iterator[str]:
    """A new file beside ``path``, which takes its place once all is written."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    made = f"{path}.part-{os.getpid()}"
    with open(made, "wb") as file:
        file.write(head)
    try:
        yield made
        os.replace(made, path)
    finally:
        if os.path.exists(made):
            os.remove(made)


def write_dataset(path: str, samples: DataFrame, known_groups: DataFrame | None, grid_size: int, max_t: int) -> None:
    """A dataset file; trajectories must be numbered from 0 without gaps, and their samples by ``seq``.

    Only the header and the number of groups are written by the driver.
    """
    local = local_path(path)
    if local is None:
        write_stream(path, samples, known_groups, grid_size, max_t)
        return
    sizes = samples.agg(F.count("*").alias("samples"), F.count_distinct("trajectory_idx").alias("n")).first()
    at = 3 + 2 * sizes["n"] + 3 * sizes["samples"]
    n_groups = known_groups.select("group_id").distinct().count() if known_groups is not None else 0
    with _created(local, _pack(grid_size, max_t, sizes["n"])) as made:
        with open(made, "r+b") as file:
            file.seek(at * WORD)
            file.write(_pack(n_groups))
        parts = [*placed_samples(samples, 3), *(placed_members(known_groups, at + 1) if n_groups else ())]
        for words in parts:
            _write_words(made, words)


def write_map(path: str, cells: DataFrame, level: tuple[int, int, int]) -> None:
    local, n = local_path(path), cells.select("trajectory_idx").distinct().count()
    if local is None:
        with _stream(cells.sparkSession, path) as write:
            write(_pack(*level, n))
            _write_trajectories(write, cells)
        return
    with _created(local, _pack(*level, n)) as made:
        for words in placed_samples(cells, 4):
            _write_words(made, words)


# reading


@dataclass
class Span(InputPartition):
    """Whole records of a file from a byte on, or a part of one long record's samples."""

    path: str
    begin: int
    end: int
    #: number of the first record, and of the first and one past the last sample if it is one record's part
    index: int
    low: int = 0
    high: int | None = None


def spans(path: str, data: np.ndarray, at: int, n: int, size: int = RANGE) -> tuple[list[Span], int]:
    """Ranges of about ``size`` bytes that cover ``n`` trajectories from word ``at`` on, and the word after them."""
    found, begin, first, most = [], at, 0, max(1, size // (3 * WORD))
    for index in range(n):
        count = int(data[at + 1])
        if count > most:  # cut a long record into parts of its own
            if begin < at:
                found.append(Span(path, begin, at, first))
            found += [Span(path, at, at + 2 + 3 * count, index, low, min(low + most, count)) for low in range(0, count, most)]
            at += 2 + 3 * count
            begin, first = at, index + 1
            continue
        at += 2 + 3 * count
        if (at - begin) * WORD >= size:
            found.append(Span(path, begin, at, first))
            begin, first = at, index + 1
    if begin < at:
        found.append(Span(path, begin, at, first))
    return found, at


def _words(path: str) -> np.ndarray:
    """A file's integers, read as they are asked for."""
    return np.memmap(path, np.int32, "r")


def _sample_batches(index: int, name: int, low: int, points: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(points), BATCH):
        part = points[k : k + BATCH].astype(np.int64)
        columns = [np.full(len(part), index), np.full(len(part), name), np.arange(low + k, low + k + len(part)), *part.T]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["trajectory_idx", "trajectory_id", "seq", "x", "y", "t"])


def read_span(span: Span) -> Iterator[pa.RecordBatch]:
    """The samples of a range, short records joined to batches."""
    data = _words(span.path)
    at, index, held, n = span.begin, span.index, [], 0
    while at < span.end:
        name, count = int(data[at]), int(data[at + 1])
        low, high = span.low, count if span.high is None else span.high
        points = np.array(data[at + 2 + 3 * low : at + 2 + 3 * high]).reshape(-1, 3)
        for batch in _sample_batches(index, name, low, points):
            held.append(batch)
            n += batch.num_rows
            if n >= BATCH:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        at, index = at + 2 + 3 * count, index + 1
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def read_members(span: Span) -> Iterator[pa.RecordBatch]:
    data, at = _words(span.path), span.begin
    for _ in range(span.index):
        name, size = int(data[at]), int(data[at + 1])
        for k in range(0, size, BATCH):
            part = np.array(data[at + 2 + k : at + 2 + min(k + BATCH, size)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), name), pa.int64()), pa.array(part, pa.int64())], ["group_id", "trajectory_idx"])
        at += 2 + size


class TrajectoryFiles(DataSource):
    """``spark.read.format("driftmesh")``: samples, or the known groups, of dataset and map files.

    Options: ``header``, the integers before the first record (3, of a map 4), ``what``
    (samples or groups) and ``range``, the bytes that a task reads.
    """

    @classmethod
    def name(cls) -> str:
        return "driftmesh"

    def schema(self) -> str:
        return MEMBER if self.options.get("what") == "groups" else SAMPLE

    def reader(self, schema) -> DataSourceReader:
        return TrajectoryReader(dict(self.options))


class TrajectoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files = sorted(glob.glob(options["path"])) or [options["path"]]
        self.groups = options.get("what") == "groups"
        self.header, self.size = int(options.get("header", 3)), int(options.get("range", RANGE))

    def partitions(self) -> list[Span]:
        found = []
        for path in self.files:
            data = _words(path)
            own, at = spans(path, data, self.header, int(data[self.header - 1]), self.size)
            # the groups of a file are one range: they are few next to its samples
            found += [Span(path, at + 1, len(data), int(data[at]))] if self.groups else own
        return found

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return read_members(partition) if self.groups else read_span(partition)


def _loaded(spark: SparkSession, path: str, **options: object) -> DataFrame:
    spark.dataSource.register(TrajectoryFiles)
    return spark.read.format(TrajectoryFiles.name()).options(**{k: str(v) for k, v in options.items()}).load(path)


def read_samples(spark: SparkSession, path: str, header: int = 3, range_bytes: int = RANGE) -> DataFrame:
    """Samples of one or more dataset files (header 3) or map files (header 4), a task for each range of bytes."""
    local = local_path(path)
    if local is None:
        return read_whole(spark, path, header)
    return _loaded(spark, local, header=header, range=range_bytes)


def read_known_groups(spark: SparkSession, path: str) -> DataFrame:
    """group_id, trajectory_idx as stored in a dataset file."""
    local = local_path(path)
    return _loaded(spark, local, what="groups") if local is not None else read_whole_groups(spark, path)


def read_header(spark: SparkSession, path: str, names: tuple[str, ...] = ("grid_size", "max_t", "n_trajectories")) -> DataFrame:
    """The leading integers of a file: of a map, pass lx, ly, lt, n_trajectories."""
    local = local_path(path)
    if local is None:

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame([np.frombuffer(c, np.int32, len(names)).astype(np.int64) for c in batch["content"]], columns=list(names))

        return _files(spark, path).mapInPandas(read, ", ".join(f"{n} long" for n in names))
    rows = [[int(v) for v in _words(file)[: len(names)]] for file in sorted(glob.glob(local)) or [local]]
    return spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))


# stores that only Spark reads: a file is one task's, and records pass the driver when it is written

#: Bytes of records sent to a file at a time.
BLOCK = 1 << 20


@contextmanager
def _stream(spark: SparkSession, path: str) -> Iterator[Callable[[bytes], None]]:
    """A file in any store that Spark reaches, written in blocks."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    held = bytearray()

    def write(record: bytes) -> None:
        held.extend(record)
        while len(held) >= BLOCK:
            stream.write(bytearray(held[:BLOCK]))
            del held[:BLOCK]

    try:
        yield write
        stream.write(held)
    finally:
        stream.close()


def _write_trajectories(write: Callable[[bytes], None], samples: DataFrame) -> None:
    for row in pack_trajectories(samples).orderBy("trajectory_idx").toLocalIterator():
        write(bytes(row["record"]))


def write_stream(path: str, samples: DataFrame, known_groups: DataFrame | None, grid_size: int, max_t: int) -> None:
    """As ``write_dataset``, record by record over the driver."""
    n = samples.select("trajectory_idx").distinct().count()
    with _stream(samples.sparkSession, path) as write:
        write(_pack(grid_size, max_t, n))
        _write_trajectories(write, samples)
        if known_groups is None:
            write(_pack(0))
            return
        groups = known_groups.groupBy("group_id").agg(F.array_sort(F.collect_list("trajectory_idx")).alias("m"))
        write(_pack(groups.count()))
        for group in groups.orderBy("group_id").toLocalIterator():
            write(_pack(group["group_id"], len(group["m"]), *group["m"]))


def _trajectories(data: np.ndarray, at: int, n: int) -> tuple[list[tuple[int, int, int, np.ndarray]], int]:
    found = []
    for index in range(n):
        name, size = int(data[at]), int(data[at + 1])
        found.append((index, name, size, data[at + 2 : at + 2 + 3 * size].reshape(-1, 3)))
        at += 2 + 3 * size
    return found, at


def _sample_frame(found: list[tuple[int, int, int, np.ndarray]]) -> pd.DataFrame:
    sizes = [size for _, _, size, _ in found]
    points = np.concatenate([p for *_, p in found] or [np.zeros((0, 3), np.int32)])
    frame = pd.DataFrame(points, columns=["x", "y", "t"])
    frame.insert(0, "trajectory_idx", np.repeat([i for i, *_ in found], sizes).astype(np.int64))
    frame.insert(1, "trajectory_id", np.repeat([n for _, n, *_ in found], sizes).astype(np.int64))
    frame.insert(2, "seq", np.concatenate([np.arange(s) for s in sizes] or [np.zeros(0, np.int64)]).astype(np.int64))
    return frame


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_whole(spark: SparkSession, path: str, header: int = 3) -> DataFrame:
    """As ``read_samples``, a task for each file, of 2 GB at most."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                data = np.frombuffer(content, np.int32)
                yield _sample_frame(_trajectories(data, header, int(data[header - 1]))[0])

    return _files(spark, path).mapInPandas(read, SAMPLE)


def read_whole_groups(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_known_groups``, a task for each file."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                data = np.frombuffer(content, np.int32)
                at = _trajectories(data, 3, int(data[2]))[1] + 1
                rows = []
                for _ in range(int(data[at - 1])):
                    name, size = int(data[at]), int(data[at + 1])
                    rows += [(name, int(m)) for m in data[at + 2 : at + 2 + size]]
                    at += 2 + size
                yield pd.DataFrame(rows, columns=["group_id", "trajectory_idx"])

    return _files(spark, path).mapInPandas(read, MEMBER)
