import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from proofline.llm import decontaminate as d
from proofline.llm import url_filter as u
from proofline.llm.components import components


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items):
    w, hit, which = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(13, len(b))
        for i in range(len(b) - n + 1) if n else ():
            for k in range(len(w) - n + 1):
                if w[k : k + n] == b[i : i + n]:
                    hit.update(range(k, k + n))
                    which.add(item)
    ids = sorted(str(x) for x in which if x is not None)
    sha = hashlib.sha256(",".join(ids).encode()).hexdigest()
    return len(w), len(hit), len(ids), sha, bool(hit) and 20 * len(hit) >= len(w)


def case(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "ß-x", "don't"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([1, 3, 12, 13, 20, 30]))) for i in range(25)]
    items += [(25, None), (26, ""), (27, "..."), (None, say(14)), (3, say(15))]
    texts = [say(rng.randint(0, 80)) for _ in range(60)]
    texts += [f"{say(5)} {items[k][1]} {say(200)}" for k in range(25)] + [None, "", "!!!", "W1 W2"]
    return items, texts


@pytest.mark.parametrize("block", [8_000_000, 300])
def test_contamination_matches_brute_force(spark, block):
    items, texts = case()
    docs = spark.createDataFrame([(i // 2 if i < 6 else i, t, 1) for i, t in enumerate(texts + texts[:1])], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(
        (r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
        for r in d.contamination(docs, bench, block_bytes=block).collect()
    )
    assert got == sorted((r.doc_id, *brute(r.text, items)) for r in docs.collect())
    kept = d.drop_contaminated(docs, bench, block_bytes=block)
    assert kept.columns == docs.columns
    want = sorted((r.doc_id, r.text or "") for r in docs.collect() if not brute(r.text, items)[-1])
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == want


def test_no_benchmark_and_no_documents(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in d.contamination(docs(), none).collect()} == {0}
    assert d.contamination(docs().where("false"), none).count() == 0


def test_shift_skips_most_positions():
    items = [(0, " ".join(f"x{i}" for i in range(40)))]
    table = d.Searcher(items).tables[0]
    assert table.length == 13 and (table.shift == 12).mean() > 0.9
    assert d.Searcher(items).hits(" ".join(f"x{i}" for i in range(5, 30)))[1] == [(0, 25)]


def test_components_of_paths_stars_and_loops(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(1000, 1200)]
    edges = path + star + [(5, 5), (7, 1), (None, 3), (3, None)] + path[:3]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100}
    assert {got[i] for i in [7, 1, *range(1000, 1200)]} == {1}
    assert got[5] == 5 and 3 not in got
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


RULES = [
    u.Rule("block", "net", "/"), u.Rule("allow", "example.net", "/en/"),
    u.Rule("block", "bad.com", "/"), u.Rule("allow", "good.com", "/"),
]


def test_verdicts_spread_over_aliases(spark):
    html = '<head><LINK rel="canonical" href="http://bad.com/x?a=1&amp;b=2"></head>'
    refresh = "<meta http-equiv=refresh content='0; url=https://alias.org/page'>"
    pages = [
        (1, "https://EXAMPLE.net/en/1", None),
        (2, "https://sub.example.net/de/1", None),
        (3, "https://alias.org/page", html),        # canonical is blocked
        (4, "http://www.alias.org/page/#top", None),  # same normal form as 3
        (5, "http://m.other.org/", refresh),          # goes to 3
        (6, "https://free.org/", None),
        (7, None, None), (8, "no scheme", None), (9, "https://mixed.org/", None), (9, "https://mixed.org/", None),
        (10, "https://net", None), (None, "https://notbad.com/", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("verdict", F.lit("x"))
    redirects = spark.createDataFrame(
        [("https://mixed.org/", "http://bad.com/"), ("http://good.com/a", "https://mixed.org/"), (None, "x")], "source string, target string"
    )
    got = [tuple(r) for r in u.url_verdicts(df, RULES, redirects=redirects).collect()]
    said = {}
    for page, host, path, rule, verdict in got:
        said.setdefault(page, []).append((host, path, rule, verdict))
    assert len(got) == len(pages)
    assert said[1] == [("example.net", "/en/1", "example.net/en/", "allow")]
    assert said[2] == [("sub.example.net", "/de/1", "net/", "block")]
    assert said[3] == [("alias.org", "/page", None, "block")]
    assert said[4] == [("www.alias.org", "/page/", None, "block")]
    assert said[5][0][3] == "block"
    assert said[6][0][3] == "allow"
    assert said[7] == [("", "", None, "allow")] and said[8] == [("", "", None, "allow")]
    assert [x[3] for x in said[9]] == ["allow", "allow"]  # an alias is allowed
    assert said[10] == [("net", "", None, "allow")]
    assert said[None] == [("notbad.com", "/", None, "allow")]
    assert u.url_verdicts(df.where("false"), RULES).count() == 0


def test_relative_links_are_resolved(spark):
    from urllib.parse import urljoin

    base = "https://free.org/a/b.html?q=1#top"
    links = ["/x", "//bad.com/x", "c.html", "./c", "../d/../e?f=/../g", "?p=2", "#end", "../..", "http://bad.com/x?y", "/a/./b/../c/", "../../../z"]
    df = spark.createDataFrame([(base, x) for x in links], "base string, link string")
    got = {r.link: r.v for r in df.select("link", u.resolved(F.col("base"), F.col("link")).alias("v")).collect()}
    assert got == {x: urljoin(base, x) for x in links}
    odd = spark.createDataFrame([(base, "mailto:a@b"), ("no scheme", "/x"), (None, "/x"), (base, "")], "base string, link string")
    assert {r.v for r in odd.select(u.resolved(F.col("base"), F.col("link")).alias("v")).collect()} == {None}


def test_a_block_spreads_over_relative_links(spark):
    pages = [
        (1, "https://free.org/1", '<link rel="canonical" href="//bad.com/x">'),
        (2, "https://two.org/a", "<meta http-equiv=refresh content='0; url=/b'>"),
        (3, "https://two.org/b", "<link rel=canonical href='http://bad.com/y'>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in u.url_verdicts(df, RULES).collect()} == dict.fromkeys((1, 2, 3), "block")


def test_a_path_of_a_thousand_redirects(spark):
    from proofline.llm.url_filter import Rule, url_verdicts

    at = lambda i: f"http://h{i}.info/p"
    hops = spark.createDataFrame([(at(i), at(i + 1)) for i in range(1000)] + [(at(3000), at(3001)), (None, at(1))], "source string, target string")
    pages = spark.createDataFrame(
        [(0, at(0)), (1, at(500)), (2, at(1000)), (3, at(3000)), (4, "https://www.h7.info/p/?utm_x=1#a"), (5, None), (6, at(3001) + "?" + "q" * 50_000)],
        "page_id long, url string",
    )
    rules = [Rule("block", "h1000.info", "/")]
    told = {r.page_id: r.verdict for r in url_verdicts(pages, rules, html=None, redirects=hops).collect()}
    assert told == {0: "block", 1: "block", 2: "block", 3: "allow", 4: "block", 5: "allow", 6: "allow"}
    rules.append(Rule("allow", "h999.info", "/"))  # an allowed alias wins, but for a rule of a url's own
    told = {r.page_id: r.verdict for r in url_verdicts(pages, rules, html=None, redirects=hops).collect()}
    assert told == {0: "allow", 1: "allow", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow"}


def test_no_links_make_no_rounds(spark, monkeypatch):
    from proofline.llm import url_filter as uf

    monkeypatch.setattr(uf, "components", lambda *_: pytest.fail("no link edges, no components"))
    pages = spark.createDataFrame(
        [(1, "http://x.net/a?ref=1", "<p>a</p>"), (2, "https://www.x.net/a", None), (3, "http://y.org/a", "<link rel=canonical href='https://y.org/a/'>")],
        "page_id long, url string, html string",
    )
    told = {r.page_id: r.verdict for r in uf.url_verdicts(pages, [uf.Rule("block", "x.net", "/")]).collect()}
    assert told == {1: "block", 2: "block", 3: "allow"}
