"""The registered queries, as they return it, on small tables of their own."""

import hashlib
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from driftmesh.llm import catalogue, urls
from tests.llm.test_text_operators import DOCS, brute_groups, brute_substrings, by_text, rows

TABLE = [r[:2] for r in DOCS] + [(20 + k, "Of the many words that stand here only the last one differs from text to text, says " + w) for k, w in enumerate(("him", "her", "us", "me"))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(TABLE, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def test_simhash_query(spark, folder):
    got = catalogue.op3_simhash(spark, folder)
    assert got.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    assert rows(got) == by_text((i, f"{p % (1 << 64):016x}", c) for i, p, c in brute_groups(TABLE))


def test_token_count_query(spark, folder):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = [(i, t or "", len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in TABLE]
    got = catalogue.op6_token_counts(spark, folder)
    assert got.columns[:4] == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert rows(got, *got.columns[:4]) == by_text((i, len(t.encode()), n, n > 512) for i, t, n in size)


def test_substring_query(spark, folder):
    got = catalogue.op7_substring_dedup(spark, folder)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert rows(got) == brute_substrings(TABLE)
    kept = {r["doc_id"]: r["kept_sha256"] for r in got.collect()}
    assert kept[1] == hashlib.sha256(b"").hexdigest()


def slow_verdicts(pages, rules, max_children=16, min_share=0.05, z=1.64, prior=4.0, threshold=0.6):
    """page -> verdict by one loop after the other."""
    parsed = []
    for page, url in pages:
        found = re.search("://([^/?#]*)([^?#]*)", url or "")
        host, path = (found[1].lower(), found[2]) if found else ("", "")
        fits = [(len(r), r, v) for v, r in rules if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        parts = re.split("/+", re.sub("^/+|/+$", "", path))
        shape = tuple("*" + (m[0] if (m := re.search(r"\.[A-Za-z]{2,5}$", s)) else "") if re.search("[0-9]", s) or len(s) > 24 else s for s in parts)
        parsed.append((page, host, shape, max(fits)[2] if fits else None))
    template = {(h, s): () for _, h, s, _ in parsed}
    for level in range(max(len(s) for _, s in template)):
        nodes = {}
        for _, h, s, _ in parsed:
            if len(s) > level:
                kids = nodes.setdefault((h, template[h, s]), {})
                kids[s[level]] = kids.get(s[level], 0) + 1
        for (h, s), t in list(template.items()):
            if len(s) > level:
                kids = nodes[h, t]
                rare = len(kids) > max_children and kids[s[level]] < min_share * sum(kids.values())
                template[h, s] = (*t, "*" if rare else s[level])
    counts = {}
    for _, h, s, v in parsed:
        own = counts.setdefault((h, template[h, s]), [0, 0])
        own[0] += v == "block"
        own[1] += v is not None
    branch = {key: () for key in counts}
    for level in range(max(len(t) for _, t in counts)):
        nodes = {}
        for (h, t), (b, n) in counts.items():
            if len(t) > level:
                own = nodes.setdefault((h, branch[h, t]), {}).setdefault(t[level], [0, 0])
                own[0] += b
                own[1] += n
        number = {}
        for key, kids in nodes.items():
            last, at = None, 0
            for name in sorted(kids, key=lambda c: (kids[c][1] == 0, kids[c][0] / kids[c][1] if kids[c][1] else 0, c)):
                b, n = kids[name]
                alike = last is not None and n == last[1] == 0
                if last is not None and n and last[1]:
                    pooled = (b + last[0] + 1) / (n + last[1] + 2)
                    alike = b / n - last[0] / last[1] < z * (pooled * (1 - pooled) * (1 / n + 1 / last[1])) ** 0.5
                at += not alike
                number[key, name] = at
                last = (b, n)
        grown = {(h, t): (*br, number[(h, br), t[level]]) if len(t) > level else br for (h, t), br in branch.items()}
        branch = grown
    overall = [sum(c[k] for c in counts.values()) for k in (0, 1)]
    share = overall[0] / overall[1] if overall[1] else 0.0
    made = {}
    for page, h, s, v in parsed:
        host = [sum(c[k] for (g, _), c in counts.items() if g == h) for k in (0, 1)]
        key = branch[h, template[h, s]]
        own = [sum(c[k] for (g, t), c in counts.items() if g == h and branch[g, t] == key) for k in (0, 1)]
        purity = (own[0] + prior * (host[0] + prior * share) / (host[1] + prior)) / (own[1] + prior)
        made[page] = v or ("block" if purity >= threshold else "allow")
    return made


def test_url_verdicts_by_plain_loops(spark):
    import random

    rng = random.Random(11)
    kinds = ["news", "spam", "shop", "about"]
    rules = (("block", "a.net/spam/x"), ("allow", "a.net/news"), ("block", "net/shop/q"), ("allow", "b.net/shop/r"), ("allow", "net/about/"))
    pages = []
    for k in range(700):
        kind = rng.choice(kinds)
        leaf = rng.choice(["x", "q", "r", f"p{rng.randrange(40)}", "".join(rng.choice("abc") for _ in range(3)), "z" * 30])
        tail = rng.choice(["", "/", f"/{rng.choice('uvw')}.html", "//u/"])
        pages.append((k, f"http{rng.choice(['', 's'])}://{rng.choice(['a.net', 'b.net', 'www.B.net', 'c.org'])}/{kind}/{leaf}{tail}{rng.choice(['', '?q', '#f'])}"))
    pages += [(900, None), (901, "no host"), (902, "http://a.net")]
    got = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), rules=rules).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == slow_verdicts(pages, rules)
    assert {r["verdict"] for r in got if r["rule"] is None} == {"allow", "block"}
