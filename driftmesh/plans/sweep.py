"""Parameter sweeps: combinations as a table, run with shared stages."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import TypeVar

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def combinations(spark: SparkSession, lists: dict[str, list[str]]) -> DataFrame:
    """params with set_id: every combination of the values, the last list fastest."""
    frames = []
    for name, values in lists.items():
        quoted = F.array(*[F.lit(str(v)) for v in values])
        frames.append(spark.range(1).select(F.posexplode(quoted).alias(f"__{name}", name)))
    rows = reduce(lambda a, b: a.crossJoin(b), frames)  # the result is the product
    number = F.lit(0).cast("long")
    for name, values in lists.items():
        number = number * len(values) + F.col(f"__{name}")
    return rows.select(number.alias("set_id"), *lists)


def feasible(params: DataFrame, space_bits: int, time_bits: int) -> DataFrame:
    """Sets whose levels exist, with the bits to drop for each.

    The bits of x are taken for y too.
    """
    space, time = F.col("space").cast("long"), F.col("time").cast("long")
    kept = params.filter((space <= space_bits) & (time <= time_bits))
    return kept.withColumn("shift_xy", F.lit(space_bits) - space).withColumn("shift_t", F.lit(time_bits) - time)


def pending(params: DataFrame, status: DataFrame) -> DataFrame:
    """Sets without a row in ``status`` (set_id), finished or failed."""
    return params.join(status.select("set_id"), "set_id", "left_anti")


def fill_template(template: str, values: list[str], node: int | None = None) -> str:
    """``%0`` to ``%9`` become values and ``%N`` the node; other text stays."""
    made, at = [], 0
    while at < len(template):
        mark = template[at : at + 2]
        if len(mark) == 2 and mark[0] == "%" and mark[1].isdigit() and int(mark[1]) < len(values):
            made.append(str(values[int(mark[1])]))
            at += 2
        elif mark == "%N" and node is not None:
            made.append(str(node))
            at += 2
        else:
            made.append(template[at])
            at += 1
    return "".join(made)


def batches(params: DataFrame, size: int) -> DataFrame:
    """params with batch: consecutive ranges of ``size`` sets, for one node each."""
    return params.withColumn("batch", F.floor(F.col("set_id") / F.lit(size)).cast("long"))


T = TypeVar("T")
STATUS = "set_id long, batch long, status string, n_groups long, seconds double, note string"


class _Deadline:
    """Ends the Spark jobs of the thread that entered it once its time is up.

    A run is a number of jobs one after the other, so jobs go on being cancelled until
    the run has noticed. A limit of None never ends.
    """

    def __init__(self, context: SparkContext, seconds: float | None):
        self.context, self.seconds = context, seconds
        self.tag, self.over, self.passed = f"sweep-{uuid.uuid4().hex}", threading.Event(), False
        self.watcher = threading.Thread(target=self._watch, daemon=True)

    def _watch(self) -> None:
        if self.over.wait(self.seconds):
            return
        self.passed = True
        while not self.over.wait(0.2):
            self.context.cancelJobsWithTag(self.tag)

    def __enter__(self) -> _Deadline:
        self.context.addJobTag(self.tag)
        if self.seconds is not None:
            self.watcher.start()
        return self

    def __exit__(self, *error: object) -> None:
        self.over.set()
        self.context.removeJobTag(self.tag)


def limited(run: Callable[[], T], seconds: float | None) -> tuple[str, T | None, str]:
    """Status, result and error of ``run`` (a miner, a strategy), whose jobs are cancelled once its time is up."""
    with _Deadline(SparkContext.getOrCreate(), seconds) as deadline:
        try:
            return "completed", run(), ""
        except Exception as error:
            return ("timed out" if deadline.passed else "failed"), None, str(error)[:200]


def run_sweep(params: list[dict], run: Callable[[dict], int], slots: int = 4, limit: float | None = None) -> list[dict]:
    """``run`` for every set, several at once; a set that raises is marked failed, one beyond ``limit`` seconds timed out.

    The jobs of a set that is out of time are cancelled, and the sweep goes on.
    """

    def one(values: dict) -> dict:
        begin = time.perf_counter()
        status, rows, error = limited(lambda: run(values), limit)  # a sweep goes on after a failed set
        made = {"status": status, "rows": rows or 0} | ({"error": error} if error else {})
        return {**values, **made, "seconds": time.perf_counter() - begin}

    with ThreadPoolExecutor(slots) as pool:
        return list(pool.map(one, params))


class SweepStatus:
    """What became of the sets of a sweep: a table that only grows, a range at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        """set_id, batch, status, n_groups, seconds, note of the sets that have ended, one way or another."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target):
            return self.spark.createDataFrame([], STATUS)
        return self.spark.read.schema(STATUS).parquet(self.path)

    def append(self, batch: int, made: list[dict]) -> None:
        rows = [(r["set_id"], batch, r["status"], r["rows"], r["seconds"], r.get("error", "")) for r in made]
        self.spark.createDataFrame(rows, STATUS).coalesce(1).write.mode("append").parquet(self.path)


def run_batches(params: DataFrame, status: SweepStatus, size: int, run: Callable[[dict, int], int], slots: int = 4, limit: float | None = None) -> DataFrame:
    """Sets in ranges of ``size``, one range after the other; those that ``status`` has are skipped.

    ``run`` gets a set's values and its range, which is what ``%N`` stands for. A range's
    outcome is written when it is done, so a sweep that was killed goes on, when called
    again, with the first range that is not; only one range is on the driver at a time.
    Sets that failed or ran out of time are not tried again.
    """
    numbered = batches(params, size)
    for row in pending(numbered, status.read()).select("batch").distinct().orderBy("batch").toLocalIterator():
        batch = row["batch"]
        left = pending(numbered.filter(F.col("batch") == batch), status.read()).orderBy("set_id").collect()
        status.append(batch, run_sweep([r.asDict() for r in left], lambda values, b=batch: run(values, b), slots, limit))
    return status.read()
