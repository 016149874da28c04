"""Fill-in-middle: a text is cut in two places and put together in another order.

Where the units of a text begin is a predicate on two neighbouring bytes. A batch of
texts is one buffer, cut into chunks that overlap by the byte before them, so each
chunk counts its own units without the others. Prefix sums over the counts tell which
chunk owns a cut, and only the owning chunks are scanned a second time. Work is linear
in the texts, memory is a batch and a block of chunks, and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmesh.llm.arrow import id_and_text, map_batches

#: Bytes of a chunk, and chunks that are scanned at once.
CHUNK, BLOCK = 1 << 12, 1 << 10
MARKERS = ("<P>", "<S>", "<M>")


def _blank(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


#: Whether a unit begins at a byte, from the byte before it and the byte itself.
UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "codepoint": lambda before, byte: (byte & 0xC0) != 0x80,
    "word": lambda before, byte: _blank(before) & ~_blank(byte),
    "line": lambda before, byte: before == 0x0A,
}


class Chunks:
    """The units of several texts that lie one after the other in a buffer of bytes.

    A text's first byte begins a unit whatever its kind; a text without bytes has none.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, unit: str = "codepoint", size: int = CHUNK):
        self.data, self.ends, self.begins_unit = data, ends.astype(np.int64), UNITS[unit]
        lengths = np.diff(self.ends)
        per_text = -(-lengths // size)
        #: the first chunk of each text, and one past the last
        self.first = np.concatenate([[0], np.cumsum(per_text)])
        nth = np.arange(self.first[-1]) - np.repeat(self.first[:-1], per_text)
        self.starts = np.repeat(self.ends[:-1], per_text) + nth * size
        self.stops = np.minimum(self.starts + size, np.repeat(self.ends[1:], per_text))
        self.opening = nth == 0
        counts = [self._counts(k, min(k + BLOCK, len(self.starts))) for k in range(0, len(self.starts), BLOCK)]
        self.before = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
        #: units of each text
        self.units = self.before[self.first[1:]] - self.before[self.first[:-1]]

    def _marks(self, begin: int, end: int) -> np.ndarray:
        """Whether a unit begins at each byte of a range; the byte before the range is seen too."""
        byte = self.data[begin:end]
        before = self.data[begin - 1 : end - 1] if begin else np.concatenate([byte[:1], byte[:-1]])
        return self.begins_unit(before, byte)

    def _counts(self, low: int, high: int) -> np.ndarray:
        begin, end = self.starts[low], self.stops[high - 1]
        marks = self._marks(begin, end)
        marks[self.starts[low:high][self.opening[low:high]] - begin] = True
        return np.add.reduceat(marks, self.starts[low:high] - begin, dtype=np.int64)

    def cut(self, text: int, rank: int) -> int:
        """The byte in the buffer where unit ``rank`` of a text begins, or its end after the last unit."""
        if rank >= self.units[text]:
            return int(self.ends[text + 1])
        wanted = self.before[self.first[text]] + rank
        owner = int(np.searchsorted(self.before, wanted, "right")) - 1
        begin = int(self.starts[owner])
        marks = self._marks(begin, int(self.stops[owner]))
        if self.opening[owner]:
            marks[0] = True
        return begin + int(np.flatnonzero(marks)[wanted - self.before[owner]])


def draws(seed: int, name: object) -> list[int]:
    """Four numbers below 2^32, the first four groups of a hash of the seed and a document's id."""
    digest = hashlib.sha256(f"{seed}:{'null' if name is None else name}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def fill_in_middle(
    docs: DataFrame, unit: str = "codepoint", seed: int = 1, plain: int = 10, suffix_first: int = 20, markers: tuple[str, str, str] = MARKERS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, n, form, prefix_chars, middle_chars, output.

    ``unit`` is codepoint, word or line and n the number of units of the text. Two cuts
    and the form are drawn from ``seed`` and the id. ``plain`` percent of the texts, empty
    ones and those that hold a marker stay as they are (form ``plain``, no lengths); of
    the others ``suffix_first`` percent are ``spm`` (suffix, prefix, middle), the rest
    ``psm`` (prefix, suffix, middle). Lengths are code points.

    Null texts count as empty; null ids share the draws of the name ``null``; repeated
    rows give repeated rows; long texts are scanned in chunks, whole; other columns are
    not carried, so no name can clash. An empty table gives an empty one.
    """
    head, tail, last = (m.encode() for m in markers)
    held = re.compile(b"|".join(re.escape(m) for m in (head, tail, last)))

    def transform(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").fill_null("").cast(pa.large_string())
        _, offsets, buffer = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
        chunks, whole = Chunks(data, ends, unit), memoryview(data)
        made: dict[str, list] = {"form": [], "prefix_chars": [], "middle_chars": [], "output": []}
        for k, name in enumerate(batch.column("id").to_pylist()):
            begin, end, n = int(ends[k]), int(ends[k + 1]), int(chunks.units[k])
            text = bytes(whole[begin:end])
            one, other, whether, which = draws(seed, name)
            if not text or whether % 100 >= 100 - plain or held.search(text):
                row = ("plain", None, None, text)
            else:
                low, high = (chunks.cut(k, r) - begin for r in sorted((one % (n + 1), other % (n + 1))))
                prefix, middle, suffix = text[:low], text[low:high], text[high:]
                sizes = (len(prefix.decode()), len(middle.decode()))
                if which % 100 < suffix_first:
                    row = ("spm", *sizes, b"".join((tail, suffix, head, prefix, last, middle)))
                else:
                    row = ("psm", *sizes, b"".join((head, prefix, tail, suffix, last, middle)))
            for column, value in zip(made, row, strict=True):
                made[column].append(value)
        outputs = pa.array(made.pop("output"), pa.large_binary()).cast(pa.large_string()).cast(pa.string())
        return {"id": batch.column("id"), "n": chunks.units, **made, "output": outputs}

    cut = id_and_text(docs, id_col, text_col)
    kind = cut.schema["id"].dataType.simpleString()
    made = map_batches(cut, transform, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that ``fill_in_middle`` made an output from.

    A cut text holds no marker, and no end of a part makes an earlier one with the start
    of the next marker as no marker begins within another, so splitting finds the parts.
    """
    parts = F.split(output, "|".join(re.escape(m) for m in markers), -1)
    first, second, last = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, last, second)).when(form == "spm", F.concat(second, last, first)).otherwise(output)
