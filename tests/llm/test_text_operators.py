"""Every operator against a brute-force version on small awkward tables."""

import hashlib
import math
import re
from collections import Counter

import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftmesh.llm import bpe, contamination, extraction, lines, markup, minimizers, mixing, neardup, quality, runindex, substrings, tokens, urls, vptree
from driftmesh.llm.fingerprints import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Nulls everywhere, empty and blank texts, ties, repeated rows, and columns with names the operators use.
LINE = "A line that many documents share, word for word"
DOCS = [
    (0, None, "en", "s1"), (1, "", "en", "s1"), (2, " \n\t\n ", None, None), (3, f"own words\n{LINE}\nmore words", "en", "s2"), (4, f"{LINE}\n\n  {LINE.upper()} \r", "fr", "s2"),
    (5, f"x\n{LINE}", "xx", None), (6, f"{LINE}", "de", ""), (6, f"{LINE}", "de", ""), (6, "another text under one id", "de", "S"), (None, f"{LINE}\n{LINE}", "en", "s1"),
    (None, None, None, None), (7, "short é日本 line\n" * 9, "es", "s3"), (8, "word " * 4000 + "end", "en", "s3"),
]
SCHEMA = "doc_id long, text string, lang string, source string, size string, pos int, n_lines string, copies string, id string, kept string, target string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, "a", 1, "b", "c", "d", "e", "f") for r in DOCS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


def by_text(found):
    return sorted(found, key=lambda r: tuple((v is None, str(v)) for v in r))


# line dedup


def brute_lines(table, min_docs=3, min_chars=20):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(SMALL)
    holders = {}
    for i, text in table:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    made = []
    for i, text in table:
        split = (text or "").split("\n")
        gone = [i is not None and len(holders.get(key(x), ())) >= min_docs and i < max(holders[key(x)]) for x in split]
        made.append((i, "\n".join(x for x, g in zip(split, gone, strict=True) if not g), len(split), sum(gone)))
    return by_text(made)


def test_line_dedup(docs, empty):
    assert rows(lines.dedup_lines(docs), "doc_id", "text", "n_lines", "n_dropped") == brute_lines([r[:2] for r in DOCS])
    assert rows(lines.dedup_lines(empty)) == []


# mixing


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    full, left = set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level >= 2 * sizes[s]]
        if not over:
            return {s: 2.0 * sizes[s] if s in full else weight[s] * level for s in names}
        full.update(over)
        left -= sum(2 * sizes[s] for s in over)


def test_mixing(docs, empty):
    sizes = Counter()
    for _, text, _, source in DOCS:
        sizes[source] += len(WORD.findall(text or ""))
    targets = brute_targets(sizes)
    mixed = mixing.mix(docs)
    seen = mixed.select("doc_id", "text", "source", "size", "source_size", "target", "copies").collect()
    assert len(seen) == len(DOCS)
    for r in seen:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], targets[r["source"]], abs_tol=1e-9)
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert math.floor(rate) <= r["copies"] <= math.floor(rate) + (rate % 1 > 0) <= 2
    assert rows(mixing.mix(docs), "doc_id", "copies") == rows(mixed, "doc_id", "copies")
    assert mixing.emit_copies(mixed).count() == sum(r["copies"] for r in seen)
    assert rows(mixing.mix(empty)) == []


def test_mix_comes_near_targets(spark):
    made = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 30 + 1).cast("int")).alias("text"))
    taken = mixing.mix(made).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] / r["target"] - 1) < 0.08 for r in taken)


# token counts


@pytest.fixture(scope="module")
def counter():
    return bpe.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


PIECES = ["a", "the", " ", "  ", "\n", "\t", "'", "'l", "'re", "é", "<|endoftext|>", "<|", "12", "日本", "!!", "\x1c", "\x85", "\xa0", "🤦", "aaaa", "\r\n", "²", "Ⅷ", "\u200b"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_every_prefix(counter, library, text):
    index = bpe.PrefixIndex(counter, text)
    sizes = [len(library.encode(text[:n], add_special_tokens=False).ids) for n in range(len(text) + 1)]
    assert [index.count(n) for n in range(len(text) + 1)] == sizes
    assert counter.total(text) == sizes[-1]
    for budget in range(4):
        fitting = max(n for n, size in enumerate(sizes) if size <= budget)
        assert index.longest(budget) == fitting
        assert counter.measure(text, budget) == (sizes[-1], fitting)


def test_token_counts(docs, empty, library):
    path = public_tokenizers.path("byte_bpe_50k.json")
    expected = []
    for i, text, *_ in DOCS:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        expected.append((i, len((text or "").encode()), n, n > 512))
    got = tokens.token_counts(docs, path)
    assert rows(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == by_text(expected)
    long = next(t for _, t, *_ in DOCS if t and len(t) > 9000)
    fit = next(r["n_fit"] for r in got.collect() if r["doc_id"] == 8)
    sizes = [len(library.encode(long[:n], add_special_tokens=False).ids) for n in (fit, fit + 1)]
    assert sizes[0] <= 512 < sizes[1]
    assert rows(tokens.token_counts(empty, path)) == []


# quality


BANDS = {"en": quality.Band(2.22, 0.02, 2.4, 0.06, 5.9)}


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if often[w] > 1 for d in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_quality(docs, empty, spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = quality.quality_rules(docs, path, BANDS)
    assert rows(judged, *columns) == by_text((i, *brute_quality(t)) for i, t, *_ in DOCS)
    assert judged.filter("base_failed AND kept").count() == 0
    assert rows(quality.quality_rules(empty, path, BANDS)) == []
    passed = quality.quality_rules(docs, path, BANDS, keep_columns=True)
    assert passed.drop("kept").columns == [c for c in docs.columns if c != "kept"] and passed.count() == len(DOCS)


def test_quality_measures(spark):
    counter = quality.PieceCounter(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["the of and the", "€ \U00010348", "", "aaa aaa aaa aaa"]
    n, fallback, entropy = counter.measure([t.encode().split() for t in texts])
    for k, text in enumerate(texts):
        ids = [t for w in text.split() for t in counter.model.encode(w)]
        shares = [c / len(ids) for c in Counter(ids).values()]
        assert n[k] == len(ids)
        assert math.isclose(entropy[k], -sum(s * math.log2(s) for s in shares), abs_tol=1e-9)
        assert math.isclose(fallback[k], sum(counter.is_byte[i] for i in ids) / max(1, len(ids)))


# contamination

ITEMS = [("b", "One two three four five six seven eight nine ten eleven"), ("a", "two THREE"), ("c", None), ("d", "..."), (None, "zz"), ("a", "six, seven"), ("e", "one two three four five six seven eight nine ten")]
TEXTS = [
    (0, None), (1, ""), (2, "one-two-three four five six seven eight nine ten eleven twelve one"), (3, "zero one two three; zz zz"), (4, "two é three six seven"),
    (4, "two three"), (None, "x two three"), (5, "zz"), (5, "zz"), (6, ("a b c " * 500) + "one two three four five six seven eight nine ten"),
]


def brute_hits(texts, items, window=10):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: find.findall((t or "").translate(SMALL))
    windows = {}
    for name, text in items:
        own = words(text)
        for k in range(max(1, len(own) - window + 1) if own else 0):
            windows.setdefault(tuple(own[k : k + window]), set()).add("null" if name is None else name)
    made = []
    for i, text in texts:
        own, hit, names = words(text), set(), set()
        for w, held in windows.items():
            for k in range(len(own) - len(w) + 1):
                if tuple(own[k : k + len(w)]) == w:
                    hit.update(range(k, k + len(w)))
                    names |= held
        made.append((i, len(own), len(hit), tuple(sorted(names))))
    return by_text(made)


@pytest.mark.parametrize(("block_bytes", "piece_words", "block_words"), [(1 << 20, 1 << 15, 1 << 20), (40, 1 << 15, 1 << 20), (1 << 20, 1, 12), (30, 2, 1 << 20)])
def test_contamination(spark, monkeypatch, block_bytes, piece_words, block_words):
    monkeypatch.setattr(contamination, "PIECE_WORDS", piece_words)
    monkeypatch.setattr(contamination, "BLOCK_WORDS", block_words)
    texts, items = spark.createDataFrame(TEXTS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id string, text string")
    found = contamination.find_contamination(texts.withColumn("spans", F.lit(1)), items, block_bytes=block_bytes)
    got = [(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in found.collect()]
    assert by_text(got) == brute_hits(TEXTS, ITEMS)
    for r in found.collect():
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))


def test_contamination_of_nothing(spark):
    texts, items = spark.createDataFrame(TEXTS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id string, text string")
    assert contamination.find_contamination(texts, items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert contamination.find_contamination(texts.limit(0), items).count() == 0
    kept = contamination.drop_contaminated(texts, items)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 0), (False, 1)]
    nameless = spark.createDataFrame([(None, "two three"), (None, "two four"), (None, None), (None, "two four")], "doc_id long, text string")
    assert rows(contamination.drop_contaminated(nameless, items), "text") == by_text([("two four",), ("two four",), (None,)])


def test_block_words_keep_shingles_in_63_bits():
    assert (contamination.BLOCK_WORDS + contamination.PIECE_WORDS + 64) ** contamination.SHINGLE < 1 << 63


# near copies


def brute_print(text):
    words = WORD.findall((text or "").translate(SMALL))
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[k : k + 4]).encode(), seed=42).intdigest() for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for _, text, *_ in DOCS:
        assert simhash(text.encode() if text is not None else None) == brute_print(text)


def brute_groups(table, radius=4):
    prints = [(i, brute_print(t)) for i, t in table]
    group = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= radius and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    least = {}
    for g, (i, _) in zip(group, prints, strict=True):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    return by_text((i, p - (1 << 64) if p >> 63 else p, least[g]) for g, (i, p) in zip(group, prints, strict=True))


def test_near_groups(docs, empty):
    assert rows(neardup.near_groups(docs), "doc_id", "fingerprint", "component_id") == brute_groups([r[:2] for r in DOCS])
    assert rows(neardup.near_groups(empty)) == []
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    expected = {c for i, _, c in brute_groups([r[:2] for r in DOCS]) if i is not None}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(expected) and ids.count(None) == 2


@pytest.mark.parametrize("radius", [1, 3, 4])
def test_links_connect_all_near_prints(spark, radius):
    import random

    rng = random.Random(radius)
    seeds = [rng.getrandbits(64) for _ in range(60)]
    prints = set(seeds)
    for _ in range(600):
        p = rng.choice(sorted(prints))
        for b in rng.sample(range(64), rng.randint(1, radius + 2)):
            p ^= 1 << b
        prints.add(p)
    values = sorted(prints)
    made = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in values], "fingerprint long")
    links = vptree.near_links(made, radius, shard_rows=500).collect()
    parent = {p: p for p in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        a, b = (v % (1 << 64) for v in r)
        parent[root(a)] = root(b)
    truth = {p: p for p in values}

    def top(x):
        while truth[x] != x:
            x = truth[x]
        return x

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= radius:
                truth[top(a)] = top(b)
    same = lambda f: {frozenset(p for p in values if f(p) == r) for r in {f(p) for p in values}}
    assert same(root) == same(top)


def _random_prints(n, seed=3):
    import numpy as np

    return np.unique(np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * 2)


@pytest.mark.parametrize("radius", range(9))
def test_some_view_allows_every_near_pair(radius):
    found = vptree.views(radius)
    assert sum(v.radius + 1 for v in found) > radius
    covered = [b for v in found for b in range(v.shift, v.shift + v.bits)]
    assert len(covered) == len(set(covered)) and max(covered) < 64


def test_compared_pairs_grow_slowly():
    import numpy as np

    def compared(n):
        prints, views = _random_prints(n), 3
        columns = np.repeat(np.arange(views), len(prints)), np.zeros(views * len(prints), np.int64)
        return vptree.shard_links(*columns, np.tile(prints, views), np.ones(views * len(prints), bool), 4)[2] / len(prints)

    few, many = compared(4_000), compared(64_000)
    assert many < 4 * few  # sixteen times the fingerprints


def test_no_leaf_is_left_large():
    import numpy as np

    prints = _random_prints(20_000)
    for view in vptree.views(4):
        row, leaf, home = vptree.fine_leaves(prints, np.zeros(len(prints), np.int64), np.ones(len(prints), bool), view)
        assert sorted(row[home]) == list(range(len(prints)))
        values = view.of(prints[row[home]])
        for name, n in Counter(leaf[home].tolist()).items():
            assert n <= vptree.LEAF_ROWS or len(set(values[leaf[home] == name])) == 1


def test_hot_leaf_is_dealt_in_parts(spark):
    """A third of all fingerprints in one narrow place: the shards stay bounded, and no link is lost."""
    import numpy as np

    rng = np.random.default_rng(9)
    near = np.uint64(0x123456789ABCDEF0) ^ (np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64))
    values = np.unique(np.concatenate([near, _random_prints(1400)]))
    made = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fingerprint long")
    links = vptree.near_links(made, 4, shard_rows=150, sample=60).collect()
    at = lambda column: np.searchsorted(values, np.array([r[column] for r in links], np.int64).view(np.uint64))
    labels = vptree._roots(np.arange(len(values)), at("src"), at("dst"))
    truth = np.arange(len(values))
    for k in range(len(values)):
        same = np.flatnonzero(np.bitwise_count(values ^ values[k]) <= 4)
        truth = vptree._roots(truth, same, np.full(len(same), k))
    classes = lambda found: {frozenset(np.flatnonzero(found == x).tolist()) for x in set(found.tolist())}
    assert classes(labels) == classes(truth)


# long repeated strings


def brute_substrings(table, length=50):
    first = {}
    for i, text in table:
        data = (text or "").encode()
        for k in range(len(data) - length + 1):
            if i is not None:
                first[data[k : k + length]] = min(i, first.get(data[k : k + length], i))
    made = []
    for i, text in table:
        data = (text or "").encode()
        gone = set()
        for k in range(len(data) - length + 1):
            if i is not None and first[data[k : k + length]] < i:
                gone.update(range(k, k + length))
        spans = sum(k - 1 not in gone for k in gone)
        made.append((i, len(data), len(gone), spans, hashlib.sha256(bytes(b for k, b in enumerate(data) if k not in gone)).hexdigest()))
    return by_text(made)


def test_substrings(spark, docs, empty):
    import random

    rng = random.Random(4)
    base = "".join(rng.choice("ab c") for _ in range(300))
    table = [r[:2] for r in DOCS if r[0] != 8]
    for _ in range(60):
        at = rng.randrange(200)
        part = base[at : at + rng.randint(20, 140)]
        table.append((rng.randrange(40), part + rng.choice(["", "x" * 70, "é" * 30]) + part[: rng.randrange(60)]))
    made = spark.createDataFrame(table, "doc_id long, text string")
    for chunk_bytes in (1500, 1 << 20):
        cut = substrings.dedup_substrings(made, chunk_bytes=chunk_bytes, bucket_bytes=chunk_bytes)
        assert rows(cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))) == brute_substrings(table)
    assert rows(substrings.dedup_substrings(empty)) == []
    assert substrings.dedup_substrings(docs).count() == len(DOCS)


def test_long_texts_are_cut_without_loss(monkeypatch):
    import numpy as np
    import pyarrow as pa

    text = bytes(np.random.default_rng(1).integers(97, 101, 5000, np.uint8))
    table = pa.table({"chunk": [0], "id": [1], "text": [text]})
    whole = substrings.Chunk(table).pieces(50)
    monkeypatch.setattr(substrings, "PIECE_BYTES", 700)
    parts = substrings.Chunk(table).pieces(50)
    windows = lambda s: {(int(a) + k, int(key)) for a, b, key in zip(s.start, s.end, s.key, strict=True) for k in range(int(b - a) - 49)}
    assert windows(whole) == windows(parts) and len(windows(whole)) == 4951


def test_run_index():
    import numpy as np

    texts = [b"abracadabra abracadabra", b"cadabra abra", b"", b"abra", b"zzzz\x00zz"]
    index = runindex.RunIndex(texts, np.array([5, 2, 9, 1, 3]), 4)
    joined = b"".join(t + b"$" for t in texts)
    owners = np.repeat([5, 2, 9, 1, 3], [len(t) + 1 for t in texts])
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
    got = {(int(t), int(p)): int(o) for t, p, o in zip(*index.stream(), strict=True)}
    expected = {}
    for n, text in enumerate(texts):
        for p in range(len(text) - 3):
            places = [k for k in range(len(joined)) if joined[k : k + 4] == text[p : p + 4]]
            expected[n, p] = int(min(owners[places]))
    assert got == expected
    assert len(index.run_start) < index.n_rows
    assert sorted(index.locate(r) for r in range(index.n_rows)) == list(range(int(starts[-1])))


def test_segments_cover_all_windows():
    texts = [b"x" * 49, b"", b"abc" * 40, bytes(range(256))]
    found = minimizers.segments(texts, 50)
    covered = [(int(t), int(a) + k) for t, a, b in zip(found.text, found.start, found.end, strict=True) for k in range(int(b - a) - 49)]
    assert sorted(covered) == [(n, k) for n, t in enumerate(texts) for k in range(len(t) - 49)]


# urls

URLS = [
    (0, "http://A.example.ORG/es/5?x#y"), (1, "https://example.org"), (2, None), (3, "no separator"), (4, "http://x.com/de/1#/fr/"), (5, "http://x.com/fr/1"), (6, "http://x.com/en/1"), (None, "http://x.com/en/2"),
    (7, "http://example.org/en/17"), (8, "http://notexample.org.evil.net/es/"), (8, "http://notexample.org.evil.net/es/"), (9, "://"), (10, "http://h?x://y/z"), (11, "http://org/a b\nc/d/e/f/g/h/i/j"),
]


def test_urls(spark):
    found = {}
    for r in urls.filter_urls(spark.createDataFrame(URLS, "page_id long, url string").withColumn("host", F.lit(3))).collect():
        found.setdefault(r["page_id"], []).append((r["host"], r["path"], r["rule"], r["verdict"]))
    assert sum(map(len, found.values())) == len(URLS)
    assert found[0] == [("a.example.org", "/es/5", "example.org/es/", "block")]
    assert found[1][0][:3] == ("example.org", "", None)
    assert found[2][0][:3] == found[3][0][:3] == found[9][0][:3] == ("", "", None)
    assert found[4] == [("x.com", "/de/1", "com/de/", "block")] and found[5] == [("x.com", "/fr/1", "com/fr/", "allow")]
    assert found[7] == [("example.org", "/en/17", "example.org/en/1", "block")]
    assert found[8][0][2] is None and len(found[8]) == 2
    assert found[10][0][:2] == ("h", "")
    assert found[11] == [("org", "/a b\nc/d/e/f/g/h/i/j", "org/", "allow")]
    assert {v[3] for values in found.values() for v in values} <= {"allow", "block"}
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_templates_learn_from_labels(spark):
    leaves = [("h", ["spam", "*"], 100, 90, 2), ("h", ["news", "*"], 100, 1, 60), ("h", ["junk", "*"], 50, 40, 1), ("k", ["a"], 10, 0, 0)]
    leaves += [("w", [f"user{k}x"], 1, k % 2, 0) for k in range(40)]
    made = spark.createDataFrame(leaves, "host string, shape array<string>, n long, blocked long, allowed long")
    got = {(r["host"], tuple(r["shape"])): (tuple(r["template"]), r["verdict"], r["purity"]) for r in urls.template_verdicts(made).collect()}
    assert got["h", ("spam", "*")][1] == got["h", ("junk", "*")][1] == "block" and got["h", ("news", "*")][1] == "allow"
    assert got["h", ("spam", "*")][2] == got["h", ("junk", "*")][2]
    assert got["w", ("user3x",)][0] == ("*",)


# pages


def test_common_lines():
    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for k, y in enumerate(b):
                row.append(last[k] + 1 if x == y else max(row[k], last[k + 1]))
        return row[-1]

    import random

    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(14))] for _ in range(2))
        shared = sorted(extraction.common_lines(a, b))
        at = iter(b)
        assert len(shared) == length(a, b) and all(any(a[i] == y for y in at) for i in shared)


def test_markup():
    page = """<html><head><title>x</title></head><body><div class="menu"><a>Home</a> <a>About</a></div><main><h1>T</h1><p>a<br>b <i>c</i>d</p><div class="ad-box">Buy</div>
    <ul><li>one<li>two</ul><aside>side</aside><script>if(a<b){x='</p>'}</script><p>c&nbsp;&lt;d&gt;&amp;&#233;</p><form>Name</form><!-- <p>no</p> --></main><section class="comments"><article>Nice!</article></section><footer>f</body>"""
    blocks, zones = markup.page_blocks(page)
    assert [b for b, z in zip(blocks, zones, strict=True) if z == markup.MAIN] == ["T", "a b cd", "one", "two", "c <d>&é"]
    assert markup.page_blocks("<nav><ul><li>Home</ul><article><p>Body</article>") == (["Home", "Body"], [markup.CHROME, markup.MAIN])
    assert markup.page_blocks("") == ([], []) and markup.page_blocks("a < b")[0] == ["a < b"]
    assert markup.page_blocks("<script>never closed <p>x")[0] == []


def test_extraction(spark):
    plain = "<body><div>Site of things</div><p>{}</p><div>All rights kept</div></body>"
    pages = [(k, f"http://h.net/{k:03d}", plain.format(f"Text number {k}")) for k in range(31)]
    pages += [(100, "http://solo.net/", plain.format("alone")), (101, None, None), (None, "http://h.net/000", ""), (102, "http://c.net/1", plain.format("copy")), (103, "http://c.net/2", plain.format("copy"))]
    made = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    for size in (300, 1 << 20):
        got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in extraction.extract_text(made, chunk_bytes=size).collect()}
        assert len(got) == len(pages)
        for k in range(1, 31):
            assert got[k] == (f"http://h.net/{k:03d}", f"Text number {k}", len(f"Text number {k}"))
        assert got[100][1] == "Site of things\nalone\nAll rights kept"
        assert got[101] == (None, "", 0) and got[None][1] == ""
        assert got[102][1] == got[103][1] == "Site of things\ncopy\nAll rights kept"
    assert extraction.extract_text(made.limit(0)).count() == 0
