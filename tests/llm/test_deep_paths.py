"""Paths that differ only far down keep templates and labels of their own."""

from driftmesh.llm import urls


def test_deep_branches_are_judged_apart(spark):
    deep = "/a/b/c/d/e/f"
    rules = (("block", f"h.org{deep}/bad/q"), ("allow", f"h.org{deep}/good/q"))
    made = [f"http://h.org{deep}/{branch}/{leaf}" for branch in ("bad", "good") for leaf in ["q"] * 40 + ["x"]]
    pages = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    seen = {r["path"]: r for r in urls.filter_urls(pages, rules=rules).collect() if r["rule"] is None}
    bad, good = seen[f"{deep}/bad/x"], seen[f"{deep}/good/x"]
    assert bad["template"] != good["template"] and "**" not in bad["template"] + good["template"]


def test_long_urls_and_wide_nodes(spark):
    long = "http://h.org/" + "/".join(f"s{chr(97 + k % 26)}" for k in range(9)) + "/" + "x" * 20_000
    wide = [f"http://w.org/{chr(97 + k % 26)}{chr(97 + k // 26)}/p" for k in range(400)]
    rows = [(1, long), (1, long), *[(10 + k, u) for k, u in enumerate(wide)]]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=(("block", "w.org/a"), ("allow", "w.org/b"))).collect()
    assert len(got) == len(rows) and {r["template"] for r in got if r["host"] == "w.org"} == {"*/p"}
    assert all(r["path"] == long[12:] and r["template"].count("/") == 9 for r in got if r["page_id"] == 1)
    # as many pages of the one template are blocked as allowed: too few to block the rest
    assert {r["verdict"] for r in got if r["host"] == "w.org" and r["rule"] is None} == {"allow"}


def test_rounds_do_not_follow_the_longest_path(spark, monkeypatch):
    written = []
    keep = urls.materialize
    monkeypatch.setattr(urls, "materialize", lambda df, name: written.append(name) or keep(df, name))
    flat = [(k, f"http://h.org/{'ab'[k % 2]}/{'pqr'[k % 3]}") for k in range(60)]
    # one very long path, another that leaves it at the end, and paths that end along it
    long = "/".join(["a", *(f"s{chr(97 + k % 26)}" for k in range(1_000))])
    deep = [(100, f"http://h.org/{long}"), (101, f"http://h.org/{long}/x"), (102, f"http://h.org/{long}/y"), *((200 + k, f"http://h.org/{long[: 5 * k + 4]}") for k in range(20))]
    rules = (("block", "h.org/a/p"), ("allow", "h.org/b"))
    counts = []
    for pages in (flat, flat + deep):
        written.clear()
        got = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), rules=rules).collect()
        assert sorted(r["page_id"] for r in got) == sorted(p[0] for p in pages)
        counts.append(len(written))
    assert counts[1] <= counts[0] + 2
