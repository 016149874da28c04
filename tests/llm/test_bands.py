"""Bands against labels that they were not fitted to, real prose, and a slow version of the verdict."""

import math
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from driftmesh.llm import quality
from tests.llm.test_text_operators import BANDS, DOCS, SCHEMA, brute_quality

PATH = public_tokenizers.path("piece_bpe_32k.model")
PROSE = {
    "en": "The harbour was quiet when the ferry came in. Two fishermen were mending a net on the wall, and a dog slept between the crates. Nobody had told them that the bridge would be closed for the summer, so they were surprised to see the square full of people with suitcases. The captain shouted something that the wind carried away, then laughed and began to unload the mail himself.",
    "de": "Am Morgen lag noch Nebel ueber dem Fluss, und die ersten Schiffe warteten vor der Schleuse. Der Waerter hatte vergessen, den Kaffee mitzunehmen, und ging deshalb noch einmal nach Hause. Als er zurueckkam, stand eine lange Schlange von Booten vor dem Tor, und alle Leute redeten gleichzeitig auf ihn ein.",
    "fr": "Le matin, la place du village restait vide jusqu'au passage du facteur. Ensuite les volets s'ouvraient un par un, et l'odeur du pain sortait de la boulangerie. Ma tante disait que rien n'avait change depuis la guerre, sauf le prix du journal et la couleur des voitures devant la mairie.",
    "es": "La biblioteca cierra a las ocho, pero el guardia siempre deja entrar a los estudiantes que llegan tarde. En la segunda planta hay una mesa junto a la ventana desde donde se ve el puerto. Mi hermana estudia allí todas las noches y vuelve a casa cuando ya no queda nadie en la calle.",
    "ru": "Утром в деревне было тихо, только собаки лаяли за рекой. Старик вышел на крыльцо, посмотрел на небо и сказал, что к вечеру будет дождь. Никто ему не поверил, потому что солнце светило ярко, но после обеда с запада пришли тучи.",
    "el": "Το πρωί το λιμάνι ήταν ήσυχο και οι ψαράδες μάζευαν τα δίχτυα τους. Ένα παιδί έτρεχε στην παραλία με τον σκύλο του, και η μητέρα του το φώναζε από το παράθυρο.",
}
FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.fixture(scope="module")
def bands(tables):
    return quality.fit_bands(*tables, PATH)


def test_held_out_labels(tables):
    docs, labels = tables
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    for k in (0, 1):
        fitted = quality.fit_bands(docs, labels.filter(half == k), PATH)
        judged = quality.quality_rules(docs, PATH, fitted).join(labels.filter(half != k), "doc_id")
        share = {r["quality"]: r["share"] for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
        assert share[1] > 0.93 and share[0] < 0.3


def test_fit_is_bounded_and_repeats(tables, bands):
    assert quality.fit_bands(*tables, PATH) == bands and "en" in bands
    assert quality.fit_bands(tables[0], tables[1], PATH, max_labelled=10) == {}
    assert quality.fit_bands(tables[0].limit(0), tables[1], PATH) == quality.fit_bands(tables[0], tables[1].limit(0), PATH) == {}


def test_real_prose_stays(spark, bands):
    rows = [(k, text, lang) for k, (lang, text) in enumerate(PROSE.items())] + [(100 + k, text, None) for k, text in enumerate(PROSE.values())]
    judged = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PATH, bands).collect()
    assert [r["doc_id"] for r in judged if not r["kept"]] == []


def test_what_no_vocabulary_fits_goes(spark, bands):
    soup = " ".join(f"q{k}#x%{k * 7919 % 997}|zz$k" for k in range(60))
    broken = "Ã¢â‚¬â„¢" + " ".join(chr(0xE000 + k) * 3 for k in range(60))
    table = " ".join("a" if k % 2 else "b" + "." * (k % 3) for k in range(1, 200))
    rows = [(k, text, lang) for k, text in enumerate((soup, broken, table)) for lang in ("en", None)]
    judged = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PATH, bands).collect()
    assert [r["kept"] for r in judged] == [False] * len(rows)


def test_scripts():
    named = {"latin": "aé", "greek": "αω", "cyrillic": "яж", "hebrew": "אב", "arabic": "اب", "indic": "कखా", "thai": "กข", "hangul": "한글", "kana": "かカ", "han": "漢字", "other": "ⴰⴱ"}
    assert {name: quality.script(text) for name, text in named.items()} == {name: name for name in named}
    assert quality.script("") == quality.script("123 !?") == "other"


def slow_kept(text, lang, bands, model):
    """The verdict by its definition, a word and a token at a time."""
    n_words, chars, *_, failed = brute_quality(text)
    ids = [i for w in (text or "").encode().split() for i in model.encode(w.decode())]
    if failed or not ids:
        return False
    band = bands.get(lang) or quality.SCRIPTS[quality.script(text)]
    shares = [c / len(ids) for c in Counter(ids).values()]
    entropy = -sum(s * math.log2(s) for s in shares)
    low = band.centre - math.sqrt(band.wide**2 + band.short**2 / len(ids))
    fallback = sum(model.is_byte(i) for i in ids) / len(ids)
    return low <= chars / len(ids) <= band.top and fallback <= band.fallback + 1 / math.sqrt(len(ids)) and entropy >= min(band.entropy, 0.7 * math.log2(len(ids)))


def test_kept_by_its_definition(spark, tables, bands):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = tables[0].select("doc_id", "text", "lang").limit(300).collect()
    rows = [tuple(r) for r in docs] + [(1000 + k, text, lang) for k, (lang, text) in enumerate(PROSE.items())]
    judged = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PATH, bands).collect()
    assert {r["doc_id"]: r["kept"] for r in judged} == {i: slow_kept(text, lang, bands, model) for i, text, lang in rows}
    awkward = quality.quality_rules(spark.createDataFrame([(*r, "a", 1, "b", "c", "d", "e", "f") for r in DOCS], SCHEMA), PATH, BANDS).collect()
    assert sorted((str(r["doc_id"]), r["kept"]) for r in awkward) == sorted((str(i), slow_kept(text, lang, BANDS, model)) for i, text, lang, _ in DOCS)


def test_registered_query(spark, tables, bands):
    from driftmesh.llm import catalogue

    got = catalogue.op9_quality_rules(spark, FOLDER)
    assert got.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "chars_per_token"] and "kept" in got.columns
    expected = quality.quality_rules(tables[0], PATH, bands)
    assert sorted(map(tuple, got.select("doc_id", "kept").collect())) == sorted(map(tuple, expected.select("doc_id", "kept").collect()))
