"""Shared scratch space: where lineage is cut and small tables are parked.

Everything goes to the folder named by ``spark.checkpoint.dir``, which every
executor can read. Only where that setting is absent and Spark runs in one process
(tests, a laptop) a temporary local folder is used instead; on a cluster that raises.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session, or a local one if none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="driftmesh-")
    return "file://" + _LOCAL["dir"]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the scratch folder that nothing uses yet; removed when the Python process ends."""
    path = f"{scratch_dir(spark)}/driftmesh/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the scratch folder and read it back.

    A lost executor then costs only the running stage: what was written is not
    derived again. The files are removed when the Python process ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote and nothing will read again.

    What Spark shuffled for them goes with the next collection of the driver's memory,
    which is asked for, as scratch space is shared.
    """
    for df in frames:
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            for spark, path in [w for w in _WRITTEN if file.endswith(w[1].rsplit("/", 1)[1])]:
                _forget(spark, path)
                _WRITTEN.remove((spark, path))
    gc.collect()
    if frames:
        frames[0].sparkSession._jvm.System.gc()


def _forget(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _cleanup() -> None:
    for spark, path in _WRITTEN:
        try:
            _forget(spark, path)
        except Exception:  # the session may already be gone
            pass
