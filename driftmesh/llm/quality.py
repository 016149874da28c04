"""Quality rules: counts of a text, and how well a public vocabulary fits it.

A vocabulary made for natural text spends few characters per token on symbol
soup, falls back to bytes on damaged encodings, and draws from few tokens on
tables and templates. Each text gets its characters per token, its share of byte
fallback and the entropy of its tokens; bands per language, or per script where
the language has none, reject what lies outside.

Bands of languages are fitted to labelled documents (``fit_bands``). Labels say how
badly a vocabulary fits the bad ones, so they set the lower limit of characters per
token and of entropy; a text that the vocabulary fits better than those labelled is
no worse for it, so the upper limits are wide and alike for all.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmesh.llm.arrow import map_batches

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Distinct words whose tokens a worker remembers.
MEMORY = 300_000
#: Bytes of text that a worker splits into words at once.
WORD_BYTES = 1_000_000


#: Labelled documents that bands are fitted to at most, and good ones that a language needs.
MAX_LABELLED = 20_000
MIN_GOOD = 40
#: Characters per token of a text of whole words only; more is no running text.
TOP = 8.0


class Band(NamedTuple):
    """What a language's texts may measure; short texts get more room.

    Characters of words per token: at least ``centre - sqrt(wide**2 + short**2 /
    tokens)``, at most ``top``. Byte fallback: at most ``fallback + 1 / sqrt(tokens)``.
    Token entropy in bits: at least the smaller of ``entropy`` and ``0.7 * log2(tokens)``.
    """

    centre: float
    wide: float
    short: float
    fallback: float
    entropy: float
    top: float = TOP


#: Unicode blocks of scripts, as first and last code points.
RANGES = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "indic": [(0x900, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x9FFF), (0x20000, 0x323AF)],
}
#: Where the language has no band: by the script of most letters. A vocabulary of 32k
#: pieces has long pieces of Latin and Cyrillic, single letters of other alphabets, and
#: bytes (up to three a character) for much of the rest.
SCRIPTS = {
    "latin": Band(1.8, 0.3, 3.0, 0.12, 4.0),
    "greek": Band(1.0, 0.3, 2.0, 0.3, 3.0),
    "cyrillic": Band(1.4, 0.3, 2.5, 0.2, 3.5),
    "hebrew": Band(0.9, 0.3, 2.0, 0.4, 3.0),
    "arabic": Band(0.9, 0.3, 2.0, 0.4, 3.0),
    "indic": Band(0.5, 0.2, 1.0, 0.9, 3.0),
    "thai": Band(0.5, 0.2, 1.0, 0.9, 3.0),
    "hangul": Band(0.4, 0.1, 1.0, 0.95, 3.0),
    "kana": Band(0.5, 0.2, 1.0, 0.9, 3.0),
    "han": Band(0.4, 0.1, 1.0, 0.95, 3.0),
    "other": Band(0.4, 0.15, 1.0, 1.0, 2.0),
}


class PieceCounter:
    """Tokens of words under a piece vocabulary, remembered as flat arrays."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n_pieces = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.n_pieces)])
        self._forget()

    def _forget(self) -> None:
        self.words: dict[bytes, int] = {}
        self.starts, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.words) > MEMORY:
            self._forget()
        new = [w for w in dict.fromkeys(words) if w not in self.words]
        if new:
            made = self.model.encode([w.decode() for w in new], num_threads=1)
            ends = self.starts[-1] + np.cumsum([len(t) for t in made])
            self.starts = np.concatenate([self.starts, ends])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(made), np.int32)])
            self.words.update(zip(new, range(len(self.words), len(self.words) + len(new)), strict=True))
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def measure(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: number of tokens, share of byte fallback, entropy in bits."""
        word = self.numbers(list(chain.from_iterable(texts)))
        n_words = np.array([len(t) for t in texts], np.int64)
        lengths = self.starts[word + 1] - self.starts[word]
        before = np.cumsum(lengths) - lengths
        token = self.flat[np.repeat(self.starts[word] - before, lengths) + np.arange(lengths.sum())]
        text = np.repeat(np.repeat(np.arange(len(texts)), n_words), lengths)
        n = np.bincount(text, minlength=len(texts))
        fallback = np.bincount(text[self.is_byte[token]], minlength=len(texts))
        key, count = np.unique(text * self.n_pieces + token, return_counts=True)
        owner = key // self.n_pieces
        share = count / n[owner]
        entropy = np.bincount(owner, -share * np.log2(share), minlength=len(texts))
        return n, fallback / np.maximum(n, 1), entropy


@lru_cache(maxsize=2)
def _pieces(path: str) -> PieceCounter:
    return PieceCounter(path)


def repeat_words(words: list[bytes], size: int = 5) -> int:
    """Words covered by windows of ``size`` words that occur twice or more."""
    windows = list(zip(*[words[i:] for i in range(size)], strict=False))
    often = Counter(windows)
    if len(often) == len(windows):
        return 0
    covered, until = 0, 0
    for start, window in enumerate(windows):
        if often[window] > 1:
            covered += start + size - max(start, until)
            until = start + size
    return covered


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = Counter(text.split("\n"))
    return sum(n - 1 for line, n in lines.items() if n > 1 and line.strip(BLANKS))


def script(text: str) -> str:
    """The script of most letters of the whole text; ``other`` without letters."""
    counts: Counter[str] = Counter()
    for c, n in Counter(text).items():
        if c.isalpha():
            point = ord(c)
            counts[next((name for name, runs in RANGES.items() if any(a <= point <= b for a, b in runs)), "other")] += n
    order = [*RANGES, "other"]
    return max(counts, key=lambda name: (counts[name], -order.index(name))) if counts else "other"


def lower_limit(band: Band, tokens: np.ndarray | int) -> np.ndarray | float:
    return band.centre - np.sqrt(band.wide**2 + band.short**2 / np.maximum(tokens, 1))


def within(band: Band, chars_per_token: float, fallback: float, entropy: float, tokens: int) -> bool:
    return (
        lower_limit(band, tokens) <= chars_per_token <= band.top
        and fallback <= band.fallback + max(tokens, 1) ** -0.5
        and entropy >= min(band.entropy, 0.7 * np.log2(max(tokens, 1)))
    )


def _fitted(good: np.ndarray, bad: np.ndarray) -> Band:
    """A band for rows (tokens, characters per token, fallback, entropy) of good and bad texts.

    The room below the centre follows the spread of the good texts, in quarters by
    their length. How much of it is given is decided by both: the limit that gains
    most, where a good text lost weighs as much as five bad ones found, and at
    most 2 % of the good ones are lost.
    """
    centre = float(np.median(good[:, 1]))
    order = good[np.argsort(good[:, 0], kind="stable")]
    rows = [(1 / np.median(q[:, 0]), np.quantile(centre - q[:, 1], 0.97) ** 2) for q in np.array_split(order, 4)]
    inverse, square = np.array(rows).T
    slope, base = np.polyfit(inverse, square, 1)
    base, slope = max(base, 1e-4), max(slope, 1e-4)

    def room(rows: np.ndarray) -> np.ndarray:
        return (centre - rows[:, 1]) / np.sqrt(base + slope / rows[:, 0])

    tries = np.quantile(room(good), [0.98, 0.985, 0.99, 0.995])
    gain = [float((room(bad) > k).mean()) - 5 * float((room(good) > k).mean()) if len(bad) else k for k in tries]
    scale = max(float(tries[int(np.argmax(gain))]), 0.1)
    long = good[good[:, 0] >= 200]
    entropy = float(np.quantile(long[:, 3], 0.005)) - 0.1 if len(long) >= MIN_GOOD else 4.0
    fallback = max(0.06, float(np.quantile(good[:, 2], 0.995)))
    return Band(*(round(float(x), 4) for x in (centre, scale * base**0.5, scale * slope**0.5, fallback, entropy)))


def fit_bands(
    docs: DataFrame, labels: DataFrame, path: str, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality"
) -> dict[str, Band]:
    """Bands of the languages with enough good documents among the labelled ones.

    ``labels`` has the id and 1 for good or 0 for bad documents; other labels, null ids
    and null languages are left out. Of more than ``max_labelled`` labelled documents
    those with the smallest hash of their id are used. Documents that fail the base
    rules say nothing about bands. No labels give no bands.
    """
    chosen = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("__label"))
    # bounded by max_labelled rows
    chosen = F.broadcast(chosen.orderBy(F.xxhash64(id_col), id_col).limit(max_labelled))
    found = docs.select(F.col(id_col), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang IS NOT NULL").join(chosen, id_col)

    def measure(batch: pa.RecordBatch) -> dict:
        made = _counts(batch, path)
        failed = pa.array([not f for f in made["base_failed"]])
        columns = {"lang": batch.column("lang"), "label": batch.column("label")} | {c: pa.array(made[c]) for c in ("tokens", "chars_per_token", "fallback_share", "token_entropy")}
        return {name: column.filter(failed) for name, column in columns.items()}

    rows = map_batches(found.select("text", "lang", F.col("__label").alias("label")), measure, "lang string, label int, tokens long, chars_per_token double, fallback_share double, token_entropy double", WORD_BYTES).collect()
    table: dict[str, tuple[list, list]] = {}
    for r in sorted(rows, key=tuple):
        table.setdefault(r["lang"], ([], []))[r["label"]].append(r[2:])
    return {lang: _fitted(np.array(good, float), np.array(bad, float).reshape(-1, 4)) for lang, (bad, good) in table.items() if len(good) >= MIN_GOOD}


def _counts(batch: pa.RecordBatch, path: str) -> dict:
    """Counts, base rules and measures of the texts of a batch."""
    texts = [t or "" for t in batch.column("text").to_pylist()]
    words = [t.encode().split() for t in texts]
    n, fallback, entropy = _pieces(path).measure(words)
    made: dict = {
        "n_words": [len(w) for w in words],
        "word_chars": [len(t) - sum(map(t.count, BLANKS)) for t in texts],
        "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
        "n_dup_lines": list(map(dup_lines, texts)),
        "n_repeat_words": list(map(repeat_words, words)),
    }
    failed = [w < 10 or 100 * r > 20 * w for w, r in zip(made["n_words"], made["n_repeat_words"], strict=True)]
    per_token = np.array(made["word_chars"]) / np.maximum(n, 1)
    return made | {"base_failed": failed, "tokens": n, "chars_per_token": per_token, "fallback_share": fallback, "token_entropy": entropy}


def quality_rules(
    docs: DataFrame,
    path: str,
    bands: dict[str, Band],
    scripts: dict[str, Band] = SCRIPTS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    keep_columns: bool = False,
) -> DataFrame:
    """Counts, measures and verdict of every row, under the languages' ``bands``.

    Columns: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, chars_per_token, fallback_share, token_entropy, kept. With
    ``keep_columns`` the rows of ``docs`` pass through with only ``kept`` added
    (a column of that name is replaced). Null texts have no words and fail; a null
    or unknown language, or one without a band, is judged by script. Rows are independent: repeated rows
    get the same verdict, and there is no shuffle.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judge(batch: pa.RecordBatch) -> dict:
        made = _counts(batch, path)
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        chosen = [bands.get(lang) or scripts[script(t or "")] for lang, t in zip(langs, texts, strict=True)]
        measured = (made[c] for c in ("chars_per_token", "fallback_share", "token_entropy", "tokens"))
        made["kept"] = [not f and bool(within(*x)) for f, *x in zip(made["base_failed"], chosen, *measured, strict=True)]
        return made | {name: batch.column(name) for name in batch.schema.names if name.startswith("id")}

    measures = "base_failed boolean, chars_per_token double, fallback_share double, token_entropy double, kept boolean"
    if keep_columns:
        return _pass_through(docs, judge, text_col, lang_col)
    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    kind = made.schema["id"].dataType.simpleString()
    judged = map_batches(made, judge, f"id {kind}, {', '.join(f'{c} long' for c in counts)}, {measures}", WORD_BYTES)
    return judged.withColumnRenamed("id", id_col)


def _pass_through(docs: DataFrame, judge, text_col: str, lang_col: str) -> DataFrame:
    """The rows of ``docs`` themselves, with the verdict, in one pass over the texts."""
    others = [c for c in docs.columns if c not in (text_col, "kept")]
    row = F.struct(*[F.col(f"`{c}`") for c in others])
    packed = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), row.alias("row"))
    kind = packed.schema["row"].dataType.simpleString()

    def verdict(batch: pa.RecordBatch) -> dict:
        return {"text": batch.column("text"), "row": batch.column("row"), "kept": judge(batch)["kept"]}

    judged = map_batches(packed, verdict, f"text string, row {kind}, kept boolean", WORD_BYTES)
    columns = [F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c != "kept"]
    return judged.select(*columns, "kept")
