"""Benchmark decontamination: which document words lie in a benchmark window.

A set join with prefix filtering. Every window of ``window`` item words is a set
of shingles of up to three words. Shingles are ordered by how rare they are in
the documents, counted over all of them. As a window must be contained whole, a
prefix of one shingle suffices: documents can only hold a window where they hold
its rarest shingle. Each such place gives one start for the window; starts that
leave the document on either side fail the positional and length bounds, and the
rest are verified word by word.

The index of a benchmark of up to ``BLOCK_BYTES`` of text and ``BLOCK_WORDS`` words is
broadcast; long items are cut into pieces that overlap by all but one word of a window. A
larger benchmark is a table that the documents are joined with (``windowjoin``). Both ways
give the same rows, and read the documents twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmesh.llm.arrow import chunks, map_batches
from driftmesh.llm.columns import ascii_lower
from driftmesh.llm.windowjoin import SHINGLE, binary_texts, item_words, window_hits
from driftmesh.storage import materialize

#: Benchmark text and words that a broadcast index covers at most: three word numbers fit in 63 bits.
BLOCK_BYTES = 4 << 20
BLOCK_WORDS = 1 << 20
#: Window starts in a piece of a long item.
PIECE_WORDS = 1 << 15
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class WindowIndex:
    """The distinct windows of some items and, once ranked, their rarest shingles."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            ids = [numbers.setdefault(w, len(numbers) + 1) for w in item_words(text)]
            for start in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[start : start + window]), set()).add(name)
        self.numbers, self.base = numbers, len(numbers) + 1
        self.windows = list(found)
        self.items = [sorted(names) for names in found.values()]
        self.keys = {s: np.unique(np.concatenate([self.shingles(np.array(w, np.int64), s) for w in self.windows if min(len(w), SHINGLE) == s] or [np.zeros(0, np.int64)])) for s in range(1, SHINGLE + 1)}

    def shingles(self, ids: np.ndarray, size: int) -> np.ndarray:
        """A number for each run of ``size`` words; 0 if one is no benchmark word."""
        n = max(0, len(ids) - size + 1)
        key, known = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(size):
            part = ids[i : i + n]
            key = key * self.base + part
            known &= part > 0
        return np.where(known, key, 0)

    def number(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All words as numbers, 0 after each text, and where each text starts."""
        get, flat, starts = self.numbers.get, [], [0]
        for text in texts:
            flat += [get(w, 0) for w in item_words(text)]
            flat.append(0)
            starts.append(len(flat))
        return np.array(flat, np.int64), np.array(starts, np.int64)

    def count(self, ids: np.ndarray) -> dict[int, np.ndarray]:
        """How often each shingle of the windows occurs."""
        counts = {}
        for size, keys in self.keys.items():
            counts[size] = np.zeros(len(keys), np.int64)
            if len(keys):
                at, hit = _find(keys, self.shingles(ids, size))
                counts[size] += np.bincount(at[hit], minlength=len(keys))
        return counts

    def rank(self, counts: dict[int, np.ndarray]) -> None:
        """Choose the rarest shingle of every window; ties go to the smaller number."""
        chosen: dict[int, list[tuple[int, int, int]]] = {s: [] for s in self.keys}
        for number, words in enumerate(self.windows):
            size = min(len(words), SHINGLE)
            keys = self.shingles(np.array(words, np.int64), size)
            rare = counts[size][np.searchsorted(self.keys[size], keys)]
            offset = int(np.lexsort((keys, rare))[0])
            chosen[size].append((int(keys[offset]), number, offset))
        self.prefix = {}
        for size, rows in chosen.items():
            table = np.array(sorted(rows), np.int64).reshape(-1, 3)
            keys, first = np.unique(table[:, 0], return_index=True)
            self.prefix[size] = (keys, np.append(first, len(table)), table[:, 1], table[:, 2])
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        self.padded = np.zeros((len(self.windows), max(self.lengths, default=1)), np.int64)
        for number, words in enumerate(self.windows):
            self.padded[number, : len(words)] = words

    def matches(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and window numbers of all occurrences."""
        starts, numbers = [], []
        for size, (keys, first, window, offset) in self.prefix.items():
            if not len(keys):
                continue
            at, hit = _find(keys, self.shingles(ids, size))
            place, at = np.flatnonzero(hit), at[hit]
            n = first[at + 1] - first[at]
            row = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            start, number = np.repeat(place, n) - offset[row], window[row]
            bounded = (start >= 0) & (start + self.lengths[number] < len(ids))
            start, number = start[bounded], number[bounded]
            for i in range(self.padded.shape[1]):
                here = self.padded[number, i]
                same = (here == 0) | (ids[np.minimum(start + i, len(ids) - 1)] == here)
                start, number = start[same], number[same]
            starts.append(start)
            numbers.append(number)
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *starts]), np.concatenate([none, *numbers])


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, (keys[at] == wanted) & (wanted > 0)


def _runs(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """The union of some spans, as disjoint spans in order."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)
    return list(zip(start[new].tolist(), end[last].tolist(), strict=True))


def _shingle_counts(docs: DataFrame, index) -> DataFrame:
    """size, at, n: how often each shingle of the index occurs, by task."""
    schema = pa.schema([("size", pa.int32()), ("at", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = index.value, None
        for batch in chunks(batches):
            counts = table.count(table.number(binary_texts(batch))[0])
            total = counts if total is None else {s: total[s] + counts[s] for s in counts}
        for size, n in (total or {}).items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int32)), pa.array(at), pa.array(n[at])], schema=schema)

    return docs.mapInArrow(run, "size int, at long, n long")


def _scan(docs: DataFrame, items: list[tuple[str, bytes | None]], window: int) -> DataFrame:
    """id, version, n_words, spans, items, with the index of ``items`` broadcast."""
    context = docs.sparkSession.sparkContext
    index = WindowIndex(items, window)
    counts = {s: np.zeros(len(k), np.int64) for s, k in index.keys.items()}
    if index.windows:
        per_task = _shingle_counts(docs.select("text"), context.broadcast(index))
        # at most one row per shingle of the index
        for row in per_task.groupBy("size", "at").agg(F.sum("n").alias("n")).collect():
            counts[row["size"]][row["at"]] = row["n"]
    index.rank(counts)
    shared = context.broadcast(index)

    def mark(batch: pa.RecordBatch) -> dict:
        table = shared.value
        ids, first = table.number(binary_texts(batch))
        start, number = table.matches(ids)
        order = np.argsort(start, kind="stable")
        start, number = start[order], number[order]
        doc = np.searchsorted(first, start, side="right") - 1
        spans: list[list] = [[] for _ in range(batch.num_rows)]
        names: list[list] = [[] for _ in range(batch.num_rows)]
        for row in np.unique(doc).tolist():
            mine = slice(*np.searchsorted(doc, [row, row + 1]))
            begin, which = start[mine] - first[row], number[mine]
            spans[row] = [{"start": a, "end": b} for a, b in _runs(begin, begin + table.lengths[which])]
            names[row] = sorted({name for w in np.unique(which) for name in table.items[w]})
        return {"id": batch.column("id"), "version": batch.column("version"), "n_words": np.diff(first) - 1, "spans": spans, "items": names}

    kind = docs.schema["id"].dataType.simpleString()
    return map_batches(docs, mark, f"id {kind}, version long, n_words long, spans array<struct<start: long, end: long>>, items array<string>")


def _pieces(benchmark: DataFrame, window: int, item_id_col: str, item_text_col: str) -> DataFrame:
    """item, piece, text: items as pieces of bounded length, of at least a window unless the item is shorter."""
    words = F.regexp_extract_all(ascii_lower(F.col(item_text_col)), F.lit(WORD), F.lit(0))
    named = benchmark.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("null")).alias("item"), words.alias("words")).filter(F.size("words") > 0)
    n_pieces = F.greatest(F.ceil((F.size("words") - window + 1) / F.lit(PIECE_WORDS)), F.lit(1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n_pieces - 1), lambda k: F.array_join(F.slice("words", k * PIECE_WORDS + 1, F.lit(PIECE_WORDS + window - 1)), " "))
    return named.select("item", F.posexplode(parts).alias("piece", "text"))


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str, item_id_col: str, item_text_col: str, block_bytes: int) -> DataFrame:
    """id, version (of the text), n_words, spans, items of every row."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("version"))
    pieces = _pieces(benchmark, window, item_id_col, item_text_col)
    n_words = F.sum(F.size(F.split("text", " ")))
    size, n_words = pieces.agg(F.sum(F.octet_length("text")), n_words).first()
    if (size or 0) > block_bytes or (n_words or 0) > BLOCK_WORDS:
        return window_hits(plain, pieces.select("item", "text"), window)
    held = [(r["item"], r["text"].encode()) for r in pieces.collect()]  # block_bytes at most
    return _scan(plain, held, window)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, spans, items.

    Words are runs of digits, ASCII letters (case ignored) and characters beyond
    ASCII. spans are the hit words as disjoint [start, end) word positions, items
    the ids of the items with a window in the text, as sorted strings. Null and
    empty texts have no words and hit nothing; items without words match nothing;
    a null item id is named ``null``, and items that share an id are one. Repeated
    rows of ``docs`` are all returned. An empty benchmark hits nothing.
    """
    found = _hits(docs, benchmark, window, id_col, text_col, item_id_col, item_text_col, block_bytes)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), "spans", "items")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The rows of ``docs`` without a word in a benchmark window.

    Rows that share an id go together; a row with a null id goes if its own text is hit.
    """
    found = _hits(docs, benchmark, window, id_col, text_col, item_id_col, item_text_col, block_bytes)
    own = lambda name, version: F.when(name.isNull(), version).otherwise(F.lit(0).cast("long"))
    hit = found.filter(F.size("items") > 0).select(F.col("id").alias("__id"), own(F.col("id"), F.col("version")).alias("__own")).distinct()
    hit = materialize(hit, "contaminated")
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (own(F.col(id_col), F.xxhash64(F.col(text_col))) == F.col("__own"))
    return docs.join(hit, same, "left_anti").select(docs.columns)
