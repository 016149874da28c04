"""HTML extraction: a page's main text, by comparing it with its nearest page.

Pages are sorted by host and URL path, and neighbours of a host are paired. The
blocks of both are aligned by a longest common subsequence, and what they share is
page furniture and goes. Zones read from the markup guard the result: blocks of named
furniture go though no other page has them (an advert that is new on every page),
and an article stays whole (a heading or a sentence that two articles share is part
of both). Where there is no article, two pages that share everything are copies, of
which the shared lines say nothing.

The order is found on host, path, id and size alone. Split points, one for each
chunk, are taken at even ranks within a host, so every pair falls into one chunk;
texts are then shuffled once, into chunks of a bounded number of bytes, however
many pages a host has.
"""

from __future__ import annotations

from bisect import bisect_right
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmesh.llm.arrow import map_batches
from driftmesh.llm.markup import MAIN, OTHER, page_blocks
from driftmesh.llm.urls import host_and_path
from driftmesh.storage import materialize

#: Bytes of pages in a chunk, about.
CHUNK_BYTES = 4 << 20
#: Split points that are broadcast at most (some 100 MB); beyond (4 TB of pages) chunks grow instead.
MAX_POINTS = 1_000_000
#: Bytes that a task gets, of keys and of pages.
KEY_BYTES, TASK_BYTES = 32 << 20, 16 << 20
#: Tasks that pages are dealt to at most; beyond (3 TB) a task gets more chunks, one at a time.
MAX_TASKS = 200_000


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence of ``a`` and ``b``.

    One big integer holds a row of the table, a bit per line of ``b``. Rows are
    kept at every square root of the number of lines and made again in between.
    """
    where: dict[str, int] = {}
    for i, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << i
    full = (1 << len(b)) - 1
    a_rows = [i for i, line in enumerate(a) if line in where]
    step = max(1, isqrt(len(a_rows)))

    def rows(row: int, begin: int, end: int) -> list[int]:
        made = [row]
        for i in a_rows[begin:end]:
            same = row & where[a[i]]
            row = ((row + same) | (row - same)) & full
            made.append(row)
        return made

    marks = [full]
    for begin in range(0, len(a_rows), step):
        marks.append(rows(marks[-1], begin, min(begin + step, len(a_rows)))[-1])
    shared: set[int] = set()
    row, col, held, base = len(a_rows), len(b), [], len(a_rows)
    while row and col:
        if row <= base or not held:
            base = (row - 1) // step * step
            held = rows(marks[base // step], base, min(base + step, len(a_rows)))
        if held[row - base] >> (col - 1) & 1:
            col -= 1
        elif held[row - 1 - base] >> (col - 1) & 1:
            row, col = row - 1, col - 1
            shared.add(a_rows[row])
        else:
            row -= 1
    return shared


def main_text(blocks: list[str], zones: list[int], other: list[str]) -> str:
    """The main text of a page, given the blocks of its nearest page.

    An article stays whole: a heading or a sentence that two articles share belongs to
    both. Furniture always goes. What stands in neither goes if it is shared; if there is
    an article and no page to compare it with, it goes as well.
    """
    shared = common_lines(blocks, other) if other else set()
    article = {i for i, z in enumerate(zones) if z == MAIN}
    plain = {i for i, z in enumerate(zones) if z == OTHER}
    own = plain - shared
    if not article:
        # two copies of a page share everything, which says nothing about furniture
        return "\n".join(blocks[i] for i in sorted(own or plain))
    return "\n".join(blocks[i] for i in sorted(article | own if other else article))


def _split_points(pages: DataFrame, chunk_bytes: int) -> list[tuple[str, str, int]]:
    """Keys (host, path, id) at which chunks begin, each at an even rank in its host.

    ``pages`` has host, path, id and n_bytes.
    """
    order = ["host", "path", "id"]
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = materialize(pages, "page-keys")
    key_bytes, n_bytes = keys.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 16), F.sum("n_bytes")).first()
    chunk_bytes = max(chunk_bytes, (n_bytes or 0) // MAX_POINTS)
    dealt = keys.repartitionByRange(max(tasks, (key_bytes or 0) // KEY_BYTES), *order).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "page-order")
    sizes = dealt.groupBy("host", "part").agg(F.count("*").alias("n"))
    within = Window.partitionBy("host").orderBy("part")
    sizes = sizes.withColumn("before", F.sum("n").over(within) - F.col("n")).withColumn("in_host", F.sum("n").over(Window.partitionBy("host")))
    in_part = Window.partitionBy("part").orderBy(*order)
    piece = F.floor((F.sum("n_bytes").over(in_part.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_bytes")) / chunk_bytes)
    placed = dealt.select(*order, "part", F.row_number().over(in_part).alias("row"), piece.alias("piece"))
    at = F.col("row") - F.min("row").over(Window.partitionBy("part", "host"))
    ranked = placed.withColumn("at", at).join(sizes, ["host", "part"]).withColumn("rank", F.col("before") + F.col("at"))
    alone = (F.col("rank") == F.col("in_host") - 1) & (F.col("rank") > 0)
    fit = ranked.filter((F.col("rank") % 2 == 0) & ~alone)
    points = fit.groupBy("part", "piece").agg(F.min(F.struct(*order)).alias("key"))
    # one row per chunk
    return sorted((r["key"]["host"], r["key"]["path"], r["key"]["id"]) for r in points.collect())


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars.

    Null and empty pages have an empty text. Pages without a host (null or odd
    URLs) are neighbours of each other. Repeated rows are paired like any others;
    a null id sorts first. A page that is alone on its host is judged by its
    markup only. Long and malformed pages are read whole, in time linear in them
    but for the alignment (lines of one page times lines of the other, 64 at a time).
    """
    host, path = host_and_path(F.col(url_col))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    keyed = pages.select(host.alias("host"), path.alias("path"), key.alias("id"), F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.col(html_col).alias("text"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 64
    found = _split_points(keyed.select("host", "path", "id", n_bytes.alias("n_bytes")), chunk_bytes)
    points = pages.sparkSession.sparkContext.broadcast(found[1:])
    tasks = min(MAX_TASKS, max(pages.sparkSession.sparkContext.defaultParallelism, len(found) * chunk_bytes // TASK_BYTES))
    kind = keyed.schema["page"].dataType.simpleString()

    def cut(batch: pa.RecordBatch) -> dict:
        columns = {name: batch.column(name) for name in ("host", "path", "id", "page", "url")}
        parsed = [page_blocks(t or "") for t in batch.column("text").to_pylist()]
        keys = zip(*(columns[c].to_pylist() for c in ("host", "path", "id")), strict=True)
        return columns | {"chunk": [bisect_right(points.value, k) for k in keys], "blocks": [p[0] for p in parsed], "zones": [p[1] for p in parsed]}

    def compare(chunk: pa.Table) -> pa.Table:
        rows = sorted(chunk.to_pylist(), key=lambda r: (r["host"].encode(), r["path"].encode(), r["id"]))
        made, begin = [], 0
        while begin < len(rows):
            end = begin + 1
            while end < len(rows) and end < begin + 2 and rows[end]["host"] == rows[begin]["host"]:
                end += 1
            alone = end - begin == 1
            before = begin and rows[begin - 1]["host"] == rows[begin]["host"]
            mates = [rows[begin - 1]] if alone and before else [] if alone else [rows[begin + 1], rows[begin]]
            for row, mate in zip(rows[begin:end], mates or [{"blocks": []}], strict=True):
                made.append((row["page"], row["url"], main_text(row["blocks"], row["zones"], mate["blocks"])))
            begin = end
        page, url, text = ([m[i] for m in made] for i in range(3))
        return pa.table({"page": pa.array(page, chunk.schema.field("page").type), "url": pa.array(url, pa.string()), "text": pa.array(text, pa.string())})

    dealt = map_batches(keyed, cut, f"host string, path string, id long, page {kind}, url string, chunk long, blocks array<string>, zones array<int>")
    texts = dealt.repartition(tasks, "chunk").groupBy("chunk").applyInArrow(compare, f"page {kind}, url string, text string")
    return texts.select(F.col("page").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
