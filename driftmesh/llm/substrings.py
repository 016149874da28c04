"""Suffix-array dedup: bytes covered by long strings of earlier documents.

A string of ``length`` bytes that starts in a document is removed if it also
starts in one with a smaller id. Documents are cut into segments by minimizers, so
equal strings meet under equal keys:

1. documents are dealt to chunks; each chunk names its segment keys, once each;
2. keys are gathered by bucket, and those of several documents are returned;
3. chunks send the segments with such keys; of equal segments in a chunk only the
   smallest id's goes to the key's bucket, the others are known to be covered;
4. a bucket finds covered windows: equal segments directly, and where segments of
   one key differ, with a run-length index of the different ones;
5. chunks cut the covered bytes out of their documents.

Rows of these exchanges hold many keys or segments each. Texts are shuffled once:
steps 1, 3 and 5 share an exchange. Chunks and buckets grow in number with the
input, not in size. A string that a third of all documents holds alike goes to its
bucket once from each chunk; where what stands around it differs, each surrounding
does, and the bucket of such a string grows with them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmesh.llm.minimizers import GRAIN, Segments, no_segments, segments
from driftmesh.llm.runindex import RunIndex

#: Bytes of text that a chunk holds about, and those that a bucket's keys are from.
CHUNK_BYTES = 6 << 20
BUCKET_BYTES = 8 << 20
#: Bytes of text cut into segments at a time, few enough for a core's cache.
PIECE_BYTES = 128 << 10
#: Segments are shorter than twice the length of the strings looked for, and have 16-bit sizes.
MAX_LENGTH = 30_000
_LOW = np.uint64((1 << 48) - 1)
#: An odd multiplier and its inverse modulo 2^64, and a number for each byte.
SPREAD = 0x9E3779B97F4A7C15
UNSPREAD = pow(SPREAD, -1, 1 << 64)
BYTE_VALUES = np.array([(k + 1) * 0xBF58476D1CE4E5B9 % (1 << 64) for k in range(256)], np.uint64) ** np.uint64(3)


class Chunk:
    """A chunk's rows, sorted; rows that share an id follow each other as one text."""

    def __init__(self, table: pa.Table):
        rows = zip(table["id"].to_pylist(), table["text"].to_pylist(), strict=True)
        known = sorted({(i, t or b"") for i, t in rows if i is not None})
        self.ids = np.array([i for i, _ in known], np.int64)
        self.texts = [t for _, t in known]
        lengths = np.array([len(t) for t in self.texts], np.int64)
        before = np.cumsum(lengths) - lengths
        first = np.searchsorted(self.ids, self.ids, side="left")
        self.base = before - before[first] if len(first) else before

    def pieces(self, length: int) -> Segments:
        """Segments of all texts; text numbers rows, and start and end count from the row's base."""
        made: list[Segments] = []
        batch: list[tuple[int, int, bytes]] = []

        def flush() -> None:
            found = segments([b for _, _, b in batch], length)
            rows = np.array([r for r, _, _ in batch], np.int64)[found.text]
            shift = np.array([a for _, a, _ in batch], np.int64)[found.text]
            made.append(Segments(rows, found.start + shift, found.end + shift, found.grain + shift, found.key))
            batch.clear()

        held = 0
        for row, text in enumerate(self.texts):
            # a long text is cut so that every window lies in one piece
            for at in range(0, max(1, len(text) - length + 1), PIECE_BYTES):
                piece = text[at : at + PIECE_BYTES + length - 1] if len(text) > PIECE_BYTES else text
                if batch and held + len(piece) > PIECE_BYTES:
                    flush()
                    held = 0
                batch.append((row, at, piece))
                held += len(piece)
        if batch:
            flush()
        parts = made or [no_segments()]
        return Segments(*(np.concatenate([p[i] for p in parts]) for i in range(len(parts[0]))))


def _lists(group: np.ndarray, *columns: tuple[np.ndarray | list, pa.DataType]) -> tuple[np.ndarray, list[pa.ListArray]]:
    """The distinct groups, and each column as one list per group; rows sorted by group."""
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(first, len(group)), pa.int32())
    return group[first], [pa.ListArray.from_arrays(offsets, pa.array(values, kind)) for values, kind in columns]


def _flat(table: pa.Table, column: str) -> np.ndarray:
    return table[column].combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _packed(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The distinct groups, and the low 48 bits of their keys as one binary each."""
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    data = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
    offsets = (np.append(first, len(group)) * 6).astype(np.int32)
    return group[first], pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _unpacked(values: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all binaries, and how many each has."""
    blobs = values.to_pylist()
    wide = np.zeros((sum(map(len, blobs)) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
    return wide.view("<u8").reshape(-1), np.array([len(b) // 6 for b in blobs], np.int64)


def name_keys(table: pa.Table, length: int, n_buckets: int) -> pa.Table:
    """Step 1: bucket, chunk, keys, several (whether two ids of the chunk have them)."""
    chunk = Chunk(table)
    found = chunk.pieces(length)
    order = np.lexsort((found.text, found.key))
    key, ids = found.key[order], chunk.ids[found.text[order]]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first) if len(first) else np.zeros(0, bool)
    key = key[first]
    bucket = ((key >> np.uint64(16)) % np.uint64(n_buckets)).astype(np.int64)
    group = 2 * bucket + several
    order = np.argsort(group, kind="stable")
    group, keys = _packed(key[order] & _LOW, group[order])
    number = table["chunk"][0].as_py() if table.num_rows else 0
    return pa.table({"bucket": group // 2, "chunk": np.full(len(group), number, np.int64), "keys": keys, "several": group % 2 == 1})


def shared_keys(table: pa.Table) -> pa.Table:
    """Step 2: chunk, keys: the keys of several documents, for each chunk that has them."""
    keys, sizes = _unpacked(table["keys"])
    chunk = np.repeat(table["chunk"].to_numpy(), sizes)
    several = np.repeat(table["several"].to_numpy(), sizes)
    order = np.argsort(keys, kind="stable")
    keys, chunk, several = keys[order], chunk[order], several[order]
    if len(keys):
        new = np.append(True, keys[1:] != keys[:-1])
        first = np.flatnonzero(new)
        often = (np.diff(np.append(first, len(keys))) > 1) | np.logical_or.reduceat(several, first)
        chosen = often[np.cumsum(new) - 1]
        keys, chunk = keys[chosen], chunk[chosen]
    order = np.argsort(chunk, kind="stable")
    group, packed = _packed(keys[order], chunk[order])
    return pa.table({"chunk": group, "keys": packed})


def send_segments(table: pa.Table, shared: pa.Table, length: int, n_buckets: int) -> pa.Table:
    """Step 3: by bucket the segments under shared keys, and copies known to be covered."""
    chunk = Chunk(table)
    wanted = np.unique(_unpacked(shared["keys"])[0])
    found = chunk.pieces(length)
    low = found.key & _LOW
    at = np.minimum(np.searchsorted(wanted, low), max(len(wanted) - 1, 0))
    hit = np.flatnonzero(wanted[at] == low) if len(wanted) else np.zeros(0, np.int64)
    row, start, end, grain, key = (c[hit] for c in found)
    ids, place = chunk.ids[row], start + chunk.base[row]
    texts = chunk.texts
    parts = [texts[r][a:b] for r, a, b in zip(row.tolist(), start.tolist(), end.tolist(), strict=True)]
    least: dict[bytes, int] = {}
    for part, owner in zip(parts, ids.tolist(), strict=True):  # rows are in order of ids
        least.setdefault(part, owner)
    own = np.array([least[p] == i for p, i in zip(parts, ids.tolist(), strict=True)], bool)
    number = table["chunk"][0].as_py() if table.num_rows else 0
    # copies need no bucket of their key, which may be a hot one: they go to one of the chunk's own
    bucket = np.where(own, ((key >> np.uint64(16)) % np.uint64(n_buckets)).astype(np.int64), n_buckets + number)
    order = np.lexsort((~own, bucket))
    first = np.flatnonzero(np.append(True, np.diff(bucket[order]) > 0)) if len(order) else np.zeros(0, np.int64)
    sealed = []
    for low, high in zip(first.tolist(), [*first.tolist()[1:], len(order)], strict=True):
        here = order[low:high]
        n = int(own[here].sum())
        sealed.append(_seal(ids[here], place[here], (end - start)[here], (grain - start)[here[:n]], (key >> np.uint64(32))[here[:n]], [parts[i] for i in here[:n].tolist()]))
    return pa.table({"bucket": bucket[order][first], "chunk": np.full(len(first), number, np.int64), "sealed": pa.array(sealed, pa.binary())})


def _seal(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, grains: np.ndarray, keys: np.ndarray, parts: list[bytes]) -> bytes:
    """One compressed record: all ids, starts and sizes, and the sent ones' grains, keys and bytes."""
    columns = (ids.astype("<i8"), starts.astype("<i8"), sizes.astype("<u2"), grains.astype("<u2"), keys.astype("<u4"))
    data = b"".join([np.array([len(ids), len(parts)], "<i8").tobytes(), *(c.tobytes() for c in columns), *parts])
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unseal(sealed: bytes) -> tuple[np.ndarray, ...]:
    """The columns of a record, and the sent bytes as one string."""
    data = pa.decompress(sealed[8:], int.from_bytes(sealed[:8], "little"), codec="zstd", asbytes=True)
    n, sent = np.frombuffer(data, "<i8", 2).tolist()
    at, made = 16, []
    for kind, count in (("<i8", n), ("<i8", n), ("<u2", n), ("<u2", sent), ("<u4", sent)):
        made.append(np.frombuffer(data, kind, count, at).astype(np.int64))
        at += made[-1].size * np.dtype(kind).itemsize
    return (*made, data[at:])


def _may_share(mixed: np.ndarray, texts: list[bytes], grain: np.ndarray, length: int) -> np.ndarray:
    """Those of the segments ``mixed`` that may share a window with another one.

    A window holds the grain, and its other bytes stand before or after it. Rounded
    down to steps, what two segments that share a window have in common on both sides
    makes ``n_steps`` at least: a segment stays if for some split of that number it has
    a neighbourhood of the grain with another one. Neighbourhoods are told apart by
    hashes, so a segment may stay that need not, but none goes that has to stay.
    """
    rest = length - GRAIN
    step = max(1, rest // 8)
    n_steps = -(-(rest - 2 * (step - 1)) // step)
    data = np.frombuffer(b"".join([texts[i] for i in mixed.tolist()]), np.uint8)
    size = np.array([len(texts[i]) for i in mixed.tolist()], np.int64)
    end = np.cumsum(size)
    at = end - size + grain[mixed]
    # the sum of a byte's value times a power that grows with its place; shifted back to place 0, it is the same for equal bytes
    power, back = (np.cumprod(np.append(np.uint64(1), np.full(len(data), p, np.uint64))) for p in (SPREAD, UNSPREAD))
    sums = np.append(np.uint64(0), np.cumsum(BYTE_VALUES[data] * power[:-1], dtype=np.uint64))
    stay = np.zeros(len(mixed), bool)
    for steps in range(n_steps + 1):
        low, high = at - steps * step, at + GRAIN + (n_steps - steps) * step
        room = np.flatnonzero((low >= end - size) & (high <= end))
        hashed = (sums[high[room]] - sums[low[room]]) * back[low[room]]
        ordered = np.sort(hashed)
        often = ordered[1:][ordered[1:] == ordered[:-1]]
        stay[room[np.isin(hashed, often)]] = True
    return mixed[stay]


def covered_spans(table: pa.Table, length: int) -> pa.Table:
    """Step 4: chunk, ids, starts, ends: bytes that lie in strings of smaller ids."""
    records = [_unseal(r) for r in table["sealed"].to_pylist()]
    chunks = np.repeat(table["chunk"].to_numpy(), [len(r[0]) for r in records])
    sent = np.concatenate([np.arange(len(r[0])) < len(r[3]) for r in records])
    all_ids, all_starts, all_sizes, grains, short = (np.concatenate([r[i] for r in records]) for i in range(5))
    copy = ~sent
    spans = [(chunks[copy], all_ids[copy], all_starts[copy], all_starts[copy] + all_sizes[copy])]
    chunk, ids, starts, sizes = chunks[sent], all_ids[sent], all_starts[sent], all_sizes[sent]
    data, at = b"".join(r[5] for r in records), np.cumsum(sizes)
    numbers: dict[bytes, int] = {}
    parts = (data[a:b] for a, b in zip((at - sizes).tolist(), at.tolist(), strict=True))
    number = np.array([numbers.setdefault(p, len(numbers)) for p in parts], np.int64)
    least = np.full(len(numbers), np.iinfo(np.int64).max)
    np.minimum.at(least, number, ids)
    later = ids > least[number]
    spans.append((chunk[later], ids[later], starts[later], starts[later] + sizes[later]))
    # of keys with different segments, those segments go into an index
    pairs = np.unique(short.astype(np.uint64) << np.uint64(32) | number.astype(np.uint64))
    key, of_key = pairs >> np.uint64(32), (pairs & np.uint64((1 << 32) - 1)).astype(np.int64)
    alike = key[1:] == key[:-1]
    mixed = np.unique(of_key[np.append(False, alike) | np.append(alike, False)]) if len(key) else of_key
    grain = np.zeros(len(numbers), np.int64)
    grain[number] = grains
    mixed = _may_share(mixed, list(numbers), grain, length)
    if len(mixed):
        texts = list(numbers)
        index = RunIndex([texts[i] for i in mixed.tolist()], least[mixed], length)
        text, place, owner = index.stream()
        early = owner < least[mixed[text]]
        text, place = text[early], place[early]
        order = np.lexsort((place, text))
        text, place = mixed[text[order]], place[order]
        if len(text):
            first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1)))
            last = np.append(first[1:], len(text)) - 1
            run_text, run_start, run_end = text[first], place[first], place[last] + length
            # every holder with the smallest id has these spans
            holder = np.flatnonzero(~later)
            holder = holder[np.argsort(number[holder], kind="stable")]
            low, high = (np.searchsorted(number[holder], run_text, side=s) for s in ("left", "right"))
            n = high - low
            run = np.repeat(np.arange(len(n)), n)
            who = holder[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            spans.append((chunk[who], ids[who], starts[who] + run_start[run], starts[who] + run_end[run]))
    chunk, ids, starts, ends = (np.concatenate([s[i] for s in spans]) for i in range(4))
    order = np.lexsort((starts, ids, chunk))
    group, lists = _lists(chunk[order], *((c[order], pa.int64()) for c in (ids, starts, ends)))
    return pa.table({"chunk": group, "ids": lists[0], "starts": lists[1], "ends": lists[2]})


def cut_out(table: pa.Table, covered: pa.Table) -> pa.Table:
    """Step 5: id, n_bytes, n_removed, n_spans, kept of every row."""
    chunk = Chunk(table)
    ids, starts, ends = (_flat(covered, c) for c in ("ids", "starts", "ends"))
    order = np.lexsort((starts, ids))
    ids, starts, ends = ids[order], starts[order], ends[order]
    made: dict[tuple[int, bytes], tuple[int, int, bytes]] = {}
    for id_, text, base in zip(chunk.ids.tolist(), chunk.texts, chunk.base.tolist(), strict=True):
        mine = slice(*np.searchsorted(ids, [id_, id_ + 1]))
        begin, end = np.maximum(starts[mine] - base, 0), np.minimum(ends[mine] - base, len(text))
        here = begin < end
        begin, end = begin[here], np.maximum.accumulate(end[here])
        if len(begin):
            new = np.append(True, begin[1:] > end[:-1])
            first, last = begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
            bounds = zip([0, *last.tolist()], [*first.tolist(), len(text)], strict=True)
            made[id_, text] = (int((last - first).sum()), len(first), b"".join(text[a:b] for a, b in bounds))
    rows = [(i, t or b"") for i, t in zip(table["id"].to_pylist(), table["text"].to_pylist(), strict=True)]
    results = [made.get(r, (0, 0, r[1])) for r in rows]
    return pa.table(
        {
            "id": pa.array([i for i, _ in rows], pa.int64()),
            "n_bytes": pa.array([len(t) for _, t in rows], pa.int64()),
            "n_removed": pa.array([r[0] for r in results], pa.int64()),
            "n_spans": pa.array([r[1] for r in results], pa.int64()),
            "kept": pa.array([r[2] for r in results], pa.binary()),
        }
    )


def dedup_substrings(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept (binary).

    Ids are whole numbers. Null and empty texts have no bytes. Rows with a null id
    neither remove nor lose anything. Rows that share an id are one document: they
    do not remove each other's bytes, and equal rows lose the same. ``length`` is
    at least 16, and at most 30,000, as segments (under twice that) have 16-bit sizes.
    """
    if not GRAIN <= length <= MAX_LENGTH:
        raise ValueError(f"length must be from {GRAIN} to {MAX_LENGTH}")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_chunks, n_buckets = max(1, round(size / chunk_bytes)), max(1, round(size / bucket_bytes))
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    dealt = keyed.select(F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.col("text"))), F.lit(n_chunks)).alias("chunk"), "id", "text")
    keys = dealt.groupBy("chunk").applyInArrow(lambda t: name_keys(t, length, n_buckets), "bucket long, chunk long, keys binary, several boolean")
    shared = keys.groupBy("bucket").applyInArrow(shared_keys, "chunk long, keys binary")
    sent = (
        dealt.groupBy("chunk")
        .cogroup(shared.groupBy("chunk"))
        .applyInArrow(lambda d, s: send_segments(d, s, length, n_buckets), "bucket long, chunk long, sealed binary")
    )
    spans = sent.groupBy("bucket").applyInArrow(lambda t: covered_spans(t, length), "chunk long, ids array<long>, starts array<long>, ends array<long>")
    cut = dealt.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(cut_out, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return cut.withColumnRenamed("id", id_col)
