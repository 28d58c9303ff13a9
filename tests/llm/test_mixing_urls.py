"""Budgets and URL templates: hand-made cases, and rows the queries' tables do not hold."""

import pytest
from pyspark.sql import functions as F

from harborlight.llm import mixing, queries, url_filter
from harborlight.llm.common import prepare


def plain_deal(total, kids):
    """kids: (name, room, weight). Fill up what is full, share the rest, until nothing changes."""
    got, left, still = {}, total, sorted(kids, key=lambda k: (k[1] / k[2], k[0]))
    while still:
        weight = sum(k[2] for k in still)
        if still[0][1] * weight <= left * still[0][2]:
            got[still[0][0]] = still[0][1]
            left -= still[0][1]
            still = still[1:]
            continue
        parts = [(k[0], left * k[2] // weight) for k in still]
        spare = left - sum(p for _, p in parts)
        got |= {n: p + (i < spare) for i, (n, p) in enumerate(parts)}
        break
    return got


@pytest.mark.parametrize("total", [0, 1, 7, 100, 1000, 5000])
def test_dealt(spark, total):
    kids = [("a", 10, 1), ("b", 500, 3), ("c", 40, 2), ("d", 0, 5), ("e", 900, 7), ("f", 40, 2)]
    given = min(total, sum(k[1] for k in kids))
    df = spark.createDataFrame([("p", given, *k) for k in kids], "up string, given long, name string, room long, weight long")
    found = {r["name"]: r.budget for r in mixing.dealt(df, ["up"]).collect()}
    assert found == plain_deal(given, kids)
    assert sum(found.values()) == given


def test_shortage_goes_to_siblings_first(spark):
    rows = [("d1", "x", "s1", 10), ("d1", "x", "s2", 1000), ("d1", "y", "s3", 1000), ("d2", "x", "s4", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, language string, source_name string, avail long")
    found = {r.source_name: r.budget for r in mixing.budgets(leaves, 800, 1, {}).collect()}
    assert found == {"s1": 10, "s2": 190, "s3": 200, "s4": 400}


def test_mixture_edges(spark):
    prepare(spark)
    rows = [(i, "w " * (i % 7), "en" if i % 2 else None, f"s{i % 3}", "clash", 9) for i in range(90)]
    rows += [(90, None, "en", None, "c", 9), (None, "w w", "en", "s1", "c", 9), (5, "w " * 5, "en", "s2", "c", 9), (91, "w " * 9000, "de", "s0", "c", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, cut string, budget int")
    for share, epochs in (((5, 10), 1), ((9, 10), 3), ((3, 1), 2)):
        found = mixing.mixed(df, F.lit("d"), share, epochs, {"source_name": {"s0": 5}}).collect()
        assert len(found) == len(rows)
        leaves = {}
        for r in found:
            leaves.setdefault((r.language, r.source_name), []).append(r)
        for rs in leaves.values():
            taken, avail, budget = sum(r.copies * r.tokens for r in rs), sum(r.tokens for r in rs), rs[0].budget
            assert budget <= avail * epochs and {r.budget for r in rs} == {budget}
            assert budget <= taken <= budget + 2 * max(r.tokens for r in rs)  # a repeated id comes whole
            assert max(r.copies for r in rs) - min(r.copies for r in rs) <= 1
        total = sum(r.tokens for r in found) * share[0] // share[1]
        assert sum(rs[0].budget for rs in leaves.values()) == min(total, epochs * sum(r.tokens for r in found))
    assert mixing.mixed(df.limit(0), F.lit("d"), (1, 2), 1, {}).count() == 0
    first = {(r.doc_id, r.copies) for r in mixing.mixed(df, F.lit("d"), (1, 50), 1, {}, seed=1).collect()}
    other = {(r.doc_id, r.copies) for r in mixing.mixed(df, F.lit("d"), (1, 50), 1, {}, seed=2).collect()}
    assert first != other


def test_rules_and_parts(spark):
    prepare(spark)
    urls = ["http://a.example.org/es/1?x=1", "http://EXAMPLE.org/en/12#t", "https://example.org/en/2", "ftp://x.com/fr/", "http://com/de/1",
            "http://xcom/de/1", "nothing", None, "http://", "http://a.org", "a://b.net//c://d?e", "http://b.net/x/y#?", "http://h.org?q=/es/"]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string")
    found = {r.page_id: r for r in url_filter.judged(df, queries.RULES).collect()}
    assert [(found[i].host, found[i].path, found[i].rule) for i in range(len(urls))] == [
        ("a.example.org", "/es/1", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("example.org", "/en/2", "org/"),
        ("x.com", "/fr/", "com/fr/"), ("com", "/de/1", "com/de/"), ("xcom", "/de/1", None), ("", "", None), ("", "", None), ("", "", None),
        ("a.org", "", None), ("b.net", "//c://d", None), ("b.net", "/x/y", None), ("h.org", "", None)]
    assert [found[i].verdict for i in range(5)] == ["block", "block", "allow", "allow", "block"]
    assert url_filter.judged(df.limit(0), queries.RULES).count() == 0
    alone = url_filter.judged(df, [("block", "nowhere/")]).collect()
    assert {(r.verdict, r.purity) for r in alone} == {("allow", 0.5)}


def test_templates(spark):
    """Ids become wildcards, alike branches merge, an odd one stays."""
    prepare(spark)
    rows = []
    for i in range(40):
        rows += [("h", f"/good/{i}", 0), ("h", f"/fine/{i}", 0), ("h", f"/bad/{i}", 1), ("h", f"/new/{i}", None), ("g", f"/x{i}y", None)]
    rows += [("h", "/" + "a/" * 12, None), ("h", "/", 0), ("h", "/good/3", 0)]
    df = spark.createDataFrame(rows, "host string, path string, bad int").withColumn("n", F.lit(1))
    found = {(r.host, r.path): r.template for r in url_filter.templates(df).collect()}
    assert found["h", "/bad/3"] == "/bad/*" and found["g", "/x3y"] == "/*" and found["h", "/"] == ""
    assert found["h", "/good/3"] in ("/~/*", "/good/*") and found["h", "/good/3"].endswith("/*")
    assert found["h", "/new/1"] == "/~/*"
    assert found["h", "/" + "a/" * 12].endswith("/**")


@pytest.mark.parametrize("sections", [64, 65, 300])
def test_sections_of_any_number_are_judged_alike(spark, sections):
    """Half of the sections are bad; each is told by its own labels."""
    prepare(spark)
    name = lambda k: "sec" + chr(97 + k // 26 % 26) + chr(97 + k % 26) + "x" * (k // 676)
    rows = [("h", f"/{name(k)}/{i}", k % 2, 1) for k in range(sections) for i in range(20)]
    df = spark.createDataFrame(rows, "host string, path string, bad int, n int")
    found = {r.path: (r.template, r.bad) for r in url_filter.templates(df).collect()}
    assert {t for t, _ in found.values()} == {f"/{name(k)}/*" for k in range(sections)}


def test_a_bad_branch_stays_out_of_a_wildcard(spark):
    """Values of a wildcard node with enough labels that differ have a template of their own; single odd pages do not."""
    prepare(spark)
    rows = [("h", f"/{i}/p", 0, 1) for i in range(200)] + [("h", f"/777/{c}", 1, 1) for c in "abcdefgh"] + [("h", "/999/q", 1, 1)]
    df = spark.createDataFrame(rows, "host string, path string, bad int, n int")
    found = {r.path: r.template for r in url_filter.templates(df).collect()}
    assert found["/777/a"].startswith("/777") and found["/3/p"].startswith("/*") and found["/999/q"].startswith("/*")


def test_labels_that_differ_below_depth_eight(spark):
    prepare(spark)
    deep = "/" + "/".join("abcdefghi")
    rows = [("h", f"{deep}/{side}/{c}", int(side == "bad"), 1) for side in ("good", "bad") for c in "klmnopqrst"]
    df = spark.createDataFrame(rows, "host string, path string, bad int, n int")
    found = {r.path: r.template for r in url_filter.templates(df).collect()}
    assert found[f"{deep}/good/k"] != found[f"{deep}/bad/k"]
    assert {t.endswith("/**") for t in found.values()} == {True}
