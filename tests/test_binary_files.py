"""Dataset files written by tasks and read in ranges, byte for byte against the format."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmesh.sources import binary

SCHEMA = "trajectory_idx long, trajectory_id long, seq long, x long, y long, t long"


def table(seed=1, n=40):
    rng = random.Random(seed)
    return [[(rng.randrange(-9, 500), rng.randrange(500), t) for t in range(rng.choice([1, 2, 7, 60]))] for _ in range(n)]


def rows(paths):
    return [(i, 100 - i, s, *p) for i, path in enumerate(paths) for s, p in enumerate(path)]


def expected_bytes(paths, groups, head):
    words = [*head, len(paths)]
    for i, path in enumerate(paths):
        words += [100 - i, len(path), *[v for p in path for v in p]]
    if groups is not None:
        words.append(len(groups))
        for name, members in sorted(groups.items()):
            words += [name, len(members), *sorted(members)]
    return np.array(words, np.int32).tobytes()


@pytest.mark.parametrize("groups", [None, {}, {3: [5, 1, 0], 9: [2], 4: list(range(40))}])
def test_files_are_the_format(spark, tmp_path, groups):
    paths, path = table(), str(tmp_path / "made set.dat")
    samples = spark.createDataFrame(rows(paths), SCHEMA).repartition(5)
    known = None if groups is None else spark.createDataFrame([(g, m) for g, own in groups.items() for m in own], "group_id long, trajectory_idx long")
    binary.write_dataset(path, samples, known, 500, 59)
    with open(path, "rb") as file:
        made = file.read()
    assert made == expected_bytes(paths, groups or {}, (500, 59))
    assert [p.name for p in tmp_path.iterdir()] == ["made set.dat"]
    binary.write_stream(f"file://{tmp_path}/streamed.dat", samples, known, 500, 59)
    with open(tmp_path / "streamed.dat", "rb") as file:
        assert file.read() == made
    for size in (1, 200, 1 << 20):
        got = binary.read_samples(spark, path, range_bytes=size)
        assert sorted(map(tuple, got.collect())) == sorted(rows(paths))
        assert (got.rdd.getNumPartitions() > 30) == (size < 1000)
    members = sorted((g, m) for g, own in (groups or {}).items() for m in own)
    assert sorted(map(tuple, binary.read_known_groups(spark, path).collect())) == members
    assert sorted(map(tuple, binary.read_whole_groups(spark, path).collect())) == members
    assert tuple(binary.read_header(spark, path).first()) == (500, 59, 40)


def test_maps(spark, tmp_path):
    paths, path = table(2), f"file://{tmp_path}/cells.map"
    binary.write_map(path, spark.createDataFrame(rows(paths), SCHEMA), (5, 5, 3))
    with open(tmp_path / "cells.map", "rb") as file:
        assert file.read() == expected_bytes(paths, None, (5, 5, 3))
    assert sorted(map(tuple, binary.read_samples(spark, path, header=4, range_bytes=500).collect())) == sorted(rows(paths))
    assert binary.read_whole(spark, path, 4).count() == len(rows(paths))


def test_large_file_is_many_ranges(spark, tmp_path):
    """A file above 2 GB (with holes), the second of whose records is longer than a range."""
    path, sizes = str(tmp_path / "large.dat"), [3, 190_000_000, 5]
    with open(path, "wb") as file:
        file.write(np.array([1, 2, 3], np.int32).tobytes())
        for k, n in enumerate(sizes):
            file.write(np.array([k + 50, n], np.int32).tobytes())
            file.seek(12 * n - 12, 1)
            file.write(np.array([k, n % 1000, 7], np.int32).tobytes())
        file.write(np.array([0], np.int32).tobytes())
    reader = binary.TrajectoryReader({"path": path})
    parts = reader.partitions()
    assert len(parts) > 30
    ends = [list(reader.read(p))[-1].to_pylist()[-1] for p in (parts[0], parts[-2], parts[-1])]
    assert [(e["trajectory_idx"], e["trajectory_id"], e["seq"], e["x"], e["y"], e["t"]) for e in ends] == [(0, 50, 2, 0, 3, 7), (1, 51, sizes[1] - 1, 1, 0, 7), (2, 52, 4, 2, 5, 7)]
    assert sum((p.high - p.low) if p.high is not None else 0 for p in parts) == sizes[1]
    assert binary.read_samples(spark, path).rdd.getNumPartitions() == len(parts)
    assert binary.read_samples(spark, path).filter(F.col("trajectory_idx") != 1).limit(3).count() == 3


def test_tasks_that_run_again_write_the_same(spark, tmp_path):
    path = str(tmp_path / "words")
    with open(path, "wb") as file:
        file.write(bytes(400))
    words = spark.range(100).select(F.col("id").alias("place"), (F.col("id") * 3).alias("a"))
    for _ in range(2):
        binary._write_words(path, words.union(words.filter("place > 40")))
    assert np.fromfile(path, np.int32).tolist() == [3 * k for k in range(100)]
