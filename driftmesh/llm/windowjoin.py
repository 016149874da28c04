"""Prefix-filtered join of documents with a benchmark that no broadcast holds.

Windows, their shingles and the shingles' counts are tables. Documents are read
twice, whatever the benchmark's size: once to count the shingles of windows, once to
name the places of each window's rarest shingle, with the words about it. Both times
a bit table of fixed size, which knows all wanted shingles and some others, keeps the
rest of the documents' shingles out of the shuffle. Places meet windows by the hash
of the shingle, and are compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmesh.llm.arrow import chunks
from driftmesh.storage import discard, materialize

SHINGLE = 3
#: Bits of the table that is broadcast: 16 MiB, however many shingles are wanted.
SCREEN_BITS = 1 << 27
#: Parts that the windows of a shingle are dealt to when they meet its counts.
SALTS = 8
#: A shingle with more than one in so many of all places is split, so at most so many are.
HOT_SHARE = 256
#: Places in a record batch.
BATCH_ROWS = 10_000
#: An odd multiplier that spreads the hashes of words (a parameter).
SPREAD = np.uint64(0x9E3779B97F4A7C15)

#: Word bytes are digits, letters (A-Z made small) and all bytes from 0x80.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def item_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


def binary_texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def hashed_words(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All words, an empty one after each text; their hashes, 0 for the empty ones; and where each text starts."""
    words, starts, seen = [], [0], {b"": 0}
    for text in texts:
        words += item_words(text)
        words.append(b"")
        starts.append(len(words))
    for word in set(words) - seen.keys():
        seen[word] = xxhash.xxh64_intdigest(word) or 1
    return words, np.array([seen[w] for w in words], np.uint64), np.array(starts, np.int64)


def shingle_keys(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of ``size`` words within a text start, and a hash of each."""
    n = max(0, len(hashes) - size + 1)
    key, whole = np.full(n, size, np.uint64), np.ones(n, bool)
    for i in range(size):
        part = hashes[i : i + n]
        key = (key + part) * SPREAD
        key ^= key >> np.uint64(29)
        whole &= part > 0
    at = np.flatnonzero(whole)
    return at, key[at].view(np.int64)


def _screen(keys: DataFrame) -> np.ndarray:
    """The bit table of the column ``key``; made in tasks, of 2^21 rows at most."""
    slot = F.pmod("key", F.lit(SCREEN_BITS))
    bit = F.expr(f"shiftleft(1L, CAST(pmod(key, {SCREEN_BITS}L) & 63L AS INT))")
    found = keys.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(SCREEN_BITS // 64, np.int64)
    table[found["at"].to_numpy()] = found["bits"].to_numpy()
    return table


def _known(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & (SCREEN_BITS - 1)
    return (table[slot >> 6] >> (slot & 63)) & 1 == 1


def _window_keys(windows: DataFrame) -> DataFrame:
    """window, n_words, keys: the hashes of a window's shingles, in order."""
    schema = pa.schema([("window", pa.string()), ("n_words", pa.int32()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "window"):
            texts = batch.column("window").cast(pa.binary()).to_pylist()
            rows = [hashed_words([text])[1] for text in texts]
            sizes = [len(r) - 1 for r in rows]
            keys = [shingle_keys(r, min(n, SHINGLE))[1] for r, n in zip(rows, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("window").cast(pa.string()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    return windows.mapInArrow(run, "window string, n_words int, keys array<long>")


def _counts(docs: DataFrame, screen: Broadcast, sizes: list[int]) -> DataFrame:
    """key, n: how often the shingles that the screen knows occur, by batch."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            hashes = hashed_words(binary_texts(batch))[1]
            for size in sizes:
                keys = shingle_keys(hashes, size)[1]
                keys, n = np.unique(keys[_known(screen.value, keys)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], schema=schema)

    return docs.mapInArrow(run, "key long, n long")


def _places(docs: DataFrame, screen: Broadcast, sizes: list[int], window: int) -> DataFrame:
    """A row id, version, n_words for each document; and a row id, version, key, start, back, near
    for each place of a shingle that the screen knows: near are the words that its windows may hold, and
    ``back`` of them stand before it."""
    kind = docs.schema["id"].dataType.simpleString()
    names = ["id", "version", "n_words", "key", "start", "back", "near"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words, hashes, first = hashed_words(binary_texts(batch))
            ids, versions = batch.column("id"), batch.column("version")

            def made(rows: np.ndarray, *columns: pa.Array) -> pa.RecordBatch:
                at = pa.array(rows)
                return pa.RecordBatch.from_arrays([ids.take(at), versions.take(at), *columns], names=names)  # noqa: B023

            n = batch.num_rows
            none = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.string())]
            yield made(np.arange(n), pa.array(np.diff(first) - 1, pa.int64()), *none)
            for size in sizes:
                at, keys = shingle_keys(hashes, size)
                hit = _known(screen.value, keys)
                at, keys = at[hit], keys[hit]
                doc = np.searchsorted(first, at, side="right") - 1
                low = np.maximum(first[doc], at - (window - size))
                high = np.minimum(first[doc + 1] - 1, at + window)
                for k in range(0, len(at), BATCH_ROWS):
                    part = slice(k, k + BATCH_ROWS)
                    near = [b" ".join(words[a:b]).decode() for a, b in zip(low[part].tolist(), high[part].tolist(), strict=True)]
                    start, back = at[part] - first[doc[part]], at[part] - low[part]
                    yield made(doc[part], pa.nulls(len(near), pa.int64()), pa.array(keys[part], pa.int64()), pa.array(start, pa.int64()), pa.array(back, pa.int32()), pa.array(near, pa.string()))

    return docs.select("id", "version", "text").mapInArrow(run, f"id {kind}, version long, n_words long, key long, start long, back int, near string")


def _ranked(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """window, n_words, key, offset, n: each window with its rarest shingle; ties go to the smaller hash."""
    spread = windows.select("window", "n_words", F.posexplode("keys").alias("offset", "key"), F.pmod(F.xxhash64("window"), F.lit(SALTS)).alias("salt"))
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    known = spread.join(salted, ["key", "salt"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    rarest = F.min(F.struct("n", "key", "offset")).alias("rarest")
    return known.groupBy("window", "n_words").agg(rarest).select("window", "n_words", "rarest.key", "rarest.offset", "rarest.n")


def _released(df: DataFrame, name: str, screen: Broadcast) -> DataFrame:
    """``df`` as a table; its broadcast is not needed again."""
    made = materialize(df, name)
    screen.destroy()
    return made


def _runs(hits: DataFrame) -> DataFrame:
    """id, version, spans: hits (start, end) of a document united to disjoint spans, in order."""
    before = Window.partitionBy("id", "version").orderBy("start", "end")
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    marked = hits.withColumn("new", F.when(reach >= F.col("start"), 0).otherwise(1))
    numbered = marked.withColumn("run", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("id", "version", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("id", "version").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _same(left: str, right: str) -> Column:
    return F.col(f"{left}.id").eqNullSafe(F.col(f"{right}.id")) & F.col(f"{left}.version").eqNullSafe(F.col(f"{right}.version"))


def window_hits(docs: DataFrame, pieces: DataFrame, window: int) -> DataFrame:
    """id, version, n_words, spans, items of every row of ``docs`` (id, version, text).

    ``pieces`` are (item, text) with the words of an item, or of a part of a long one,
    small and with single spaces. Rows with the same id and version have the same text.
    """
    context = docs.sparkSession.sparkContext
    words = F.split("text", " ")
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - window + 1, F.lit(1)))
    cut = F.transform(starts, lambda k: F.array_join(F.slice(words, k, F.lit(window)), " "))
    owned = materialize(pieces.select("item", F.explode(cut).alias("window")).distinct(), "item-windows")
    keyed = materialize(_window_keys(owned.select("window").distinct()), "window-shingles")
    sizes = sorted(r["size"] for r in keyed.select(F.least("n_words", F.lit(SHINGLE)).alias("size")).distinct().collect())

    screen = context.broadcast(_screen(keyed.select(F.explode("keys").alias("key"))))
    counts = _counts(docs.select("text"), screen, sizes).groupBy("key").agg(F.sum("n").alias("n"))
    ranked = _released(_ranked(keyed, counts), "ranked-windows", screen)
    discard(keyed)

    screen = context.broadcast(_screen(ranked.select("key")))
    marked = _released(_places(docs, screen, sizes, window), "window-places", screen)
    chosen = ranked.select("key", "n").distinct()
    total = chosen.agg(F.sum("n")).first()[0] or 0
    hot = chosen.filter(F.col("n") * HOT_SHARE > total).select("key", F.ceil(F.col("n") * HOT_SHARE / F.lit(max(total, 1))).cast("int").alias("parts"))
    hot = F.broadcast(hot)  # fewer than HOT_SHARE rows, as their counts add up to the total at most
    parts = F.coalesce("parts", F.lit(1))
    dealt = ranked.join(hot, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts").withColumnRenamed("n_words", "length")
    places = marked.filter("key IS NOT NULL").join(hot, "key", "left")
    places = places.withColumn("part", F.pmod(F.xxhash64("id", "version", "start"), parts).cast("int")).drop("parts", "n_words")
    begin = F.greatest(F.col("back") - F.col("offset") + 1, F.lit(1))
    held = F.array_join(F.slice(F.split("near", " "), begin, F.col("length")), " ") == F.col("window")
    met = places.join(dealt, ["key", "part"]).filter((F.col("back") >= F.col("offset")) & held)
    first = F.col("start") - F.col("offset")
    hits = materialize(met.select("id", "version", first.alias("start"), (first + F.col("length")).alias("end"), "window", "part"), "window-hits")

    spans = _runs(hits.select("id", "version", "start", "end").distinct())
    owners = owned.join(dealt.select("window", "part"), "window")
    named = hits.select("id", "version", "window", "part").distinct().join(owners, ["window", "part"]).select("id", "version", "item").distinct()
    items = named.groupBy("id", "version").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = spans.alias("s").join(items.alias("i"), _same("s", "i")).select("s.id", "s.version", "spans", "items")
    base = marked.filter("n_words IS NOT NULL").select("id", "version", "n_words")
    return base.alias("a").join(found.alias("b"), _same("a", "b"), "left").select(
        "a.id", "a.version", "n_words", F.coalesce("spans", F.array().cast("array<struct<start: long, end: long>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )
