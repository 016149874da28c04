"""Near copies of the pipeline against brute-force Jaccard similarity."""

import random

import pytest

from driftmesh.llm import neardup, shingles
from tests.llm.test_text_operators import DOCS, SMALL, WORD, by_text, rows


def brute_set(text):
    words = WORD.findall((text or "").translate(SMALL))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_similar(table, similarity=0.8):
    sets = [brute_set(t) for _, t in table]
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            joint, shared = len(sets[a] | sets[b]), len(sets[a] & sets[b])
            if shared >= similarity * joint - 1e-9 and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    least = {}
    for g, (i, _) in zip(group, table, strict=True):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    return by_text((i, least[g]) for g, (i, _) in zip(group, table, strict=True))


def edited_copies(seed=5):
    """Texts and copies with a few words replaced, at similarities about 0.8, and chains of such."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    common = [rng.choice(words) for _ in range(40)]
    texts = []
    for n in (6, 12, 60, 100, 200, 300) * 6:
        text = [rng.choice(words) for _ in range(n)] + common
        texts.append(text)
        for _ in range(4):
            text = list(rng.choice(texts[-3:]))
            for _ in range(rng.randint(0, max(1, len(text) // 40))):
                text[rng.randrange(len(text))] = rng.choice(words)
            texts.append(text)
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("stars", "rows_per_set"), [(0, 4), (3, 0)])
def test_similar_groups(spark, monkeypatch, stars, rows_per_set):
    monkeypatch.setattr(shingles, "STARS", stars)
    monkeypatch.setattr(shingles, "ROWS", rows_per_set)
    table = edited_copies()
    made = spark.createDataFrame(table, "doc_id long, text string")
    assert rows(shingles.similar_groups(made), "doc_id", "component_id") == brute_similar(table)


def test_similar_groups_of_awkward_rows(spark):
    made = spark.createDataFrame([r[:2] for r in DOCS], "doc_id long, text string")
    assert rows(shingles.similar_groups(made), "doc_id", "component_id") == brute_similar([r[:2] for r in DOCS])
    assert rows(shingles.similar_groups(made.limit(0))) == []


def test_near_copies_stage_by_similarity(spark):
    import corpus_pipeline

    table = edited_copies(8)
    made = spark.createDataFrame(table, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, made, "").collect())
    assert kept == sorted({c for _, c in brute_similar(table)})
    assert len(kept) < neardup.keep_one(made).count()


@pytest.mark.parametrize("similarity", [0.5, 0.8, 1.0])
def test_sets_under_a_hot_shingle_meet_in_parts_by_size(spark, similarity):
    """One shingle is in all 300 sets, another in a third; every pair of allowed sizes is made once."""
    rng = random.Random(2)
    sizes = [rng.choice([0, 1, 4, 5, 100, rng.randint(1, 400)]) for _ in range(300)]
    table = [(s, k, sizes[k], 0, k) for s, step in ((7, 1), (9, 3)) for k in range(0, 300, step)]
    made = spark.createDataFrame(table, "shingle long, node long, n long, pos int, label long")
    met = shingles._meeting(made, similarity)
    got = [(r["shingle"], r["node"], r["node2"]) for r in met.select("shingle", "node", "node2").collect()]
    expected = set()
    for s, step in ((7, 1), (9, 3)):
        for a in range(0, 300, step):
            for b in range(0, 300, step):
                if (sizes[a], a) < (sizes[b], b) and sizes[a] >= similarity * sizes[b] - 1e-9:
                    expected.add((s, a, b))
    assert len(got) == len(set(got)) and set(got) == expected
    parts = met.groupBy("shingle", "class", "part").count().collect()
    assert len({r["part"] for r in parts if r["shingle"] == 7}) > 8
    assert shingles._meeting(made.limit(0), similarity).count() == 0
