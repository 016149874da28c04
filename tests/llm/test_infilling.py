"""Fill-in-middle against plain slicing."""

import random

import duckdb
import numpy as np
import pytest

from driftmesh.llm import catalogue, infilling
from driftmesh.llm.infilling import Chunks, draws, fill_in_middle, restored
from tests.test_queries import values

ODD = ["", None, "a", "é", "naïve 😀 text\nof two lines\n\n", "with <P> in it", "< P> <S", "<<<<", "<S<S<M<P", " \t x", "😀" * 3000, "z" * 20000 + "é" * 3000, "ab\n" * 4000]


def unit_starts(text, unit):
    if unit == "codepoint":
        return list(range(len(text)))
    blank = set(" \t\n\x0b\x0c\r")
    begins = {"word": lambda a, b: a in blank and b not in blank, "line": lambda a, b: a == "\n"}[unit]
    return [k for k in range(len(text)) if k == 0 or begins(text[k - 1], text[k])]


@pytest.mark.parametrize("unit", list(infilling.UNITS))
@pytest.mark.parametrize("size", [1, 3, 64, 4096])
def test_chunks_find_every_cut(unit, size):
    texts = [t or "" for t in ODD if len(t or "") < 400] + ["é \n" * 40]
    encoded = [t.encode() for t in texts]
    ends = np.cumsum([0] + [len(e) for e in encoded])
    chunks = Chunks(np.frombuffer(b"".join(encoded), np.uint8), ends, unit, size)
    for k, text in enumerate(texts):
        starts = unit_starts(text, unit)
        assert chunks.units[k] == len(starts)
        for rank in range(len(starts) + 1):
            at = starts[rank] if rank < len(starts) else len(text)
            assert chunks.cut(k, rank) - ends[k] == len(text[:at].encode())


def test_only_owning_chunks_are_scanned_again(monkeypatch):
    data = np.frombuffer(b"x" * (1 << 20), np.uint8)
    chunks = Chunks(data, np.array([0, len(data)]))
    seen = []
    scan = Chunks._marks
    monkeypatch.setattr(Chunks, "_marks", lambda self, begin, end: seen.append(end - begin) or scan(self, begin, end))
    assert [chunks.cut(0, r) for r in (0, 777_777, 1 << 20)] == [0, 777_777, 1 << 20]
    assert sum(seen) <= 2 * infilling.CHUNK


def slow(name, text, unit="codepoint", seed=1):
    text = text or ""
    starts = unit_starts(text, unit)
    n, (a, b, c, d) = len(starts), draws(seed, name)
    if not text or any(m in text for m in infilling.MARKERS) or c % 100 >= 90:
        return (n, "plain", None, None, text, text)
    low, high = (([*starts, len(text)])[r] for r in sorted((a % (n + 1), b % (n + 1))))
    p, m, s = text[:low], text[low:high], text[high:]
    form = "spm" if d % 100 < 20 else "psm"
    return (n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", text)


@pytest.mark.parametrize("unit", list(infilling.UNITS))
def test_against_slices(spark, unit):
    rng = random.Random(3)
    table = [(k, t) for k, t in enumerate(ODD)] + [(None, "no name"), (4, ODD[4]), (4, ODD[4])]
    table += [(100 + k, "".join(rng.choice("aé<>PSM \n😀") for _ in range(rng.randrange(60)))) for k in range(300)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in table], "doc_id long, text string, form string, id int")
    made = fill_in_middle(docs, unit)
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", restored(made.output, made.form).alias("back")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *slow(i, t, unit))) for i, t in table)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs.limit(0)).count() == 0


def test_twin(spark):
    duck = duckdb.connect()
    duck.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got, expected = catalogue.op13_fill_middle(spark, "/root/testdata/sf0.001"), duck.sql(catalogue.OP13_SQL)
    assert got.columns == expected.columns
    assert values(got.collect(), got.columns) == values(expected.fetchall(), expected.columns)
