import base64
import hashlib
import io
from collections import Counter

import numpy as np
import pytest
import zstandard

from proofline.llm import html_extract as h
from proofline.llm import warc as w


def page_rows():
    rows = [(i, f"http://a.org/{i}", f"<p>page {i}</p>" * (1 + i % 7)) for i in range(60)]
    rows += [(100 + i, f"http://copy.org/{i}", "<p>copy</p>") for i in range(30)]
    rows += [(200, "u", "twice"), (200, "u", "twice"), (200, "v", "twice"), (199, None, "twice")]
    rows += [(300, None, None), (301, "x\r\ny: z", ""), (None, "n", "<b>no id</b>"), (302, "l", "long " * 200_000)]
    return rows


def expected(rows):
    groups = {}
    for i, _, t in rows:
        groups.setdefault(t or "", []).append(i)
    out, done = Counter(), set()
    for i, _, t in rows:
        raw = (t or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        last = max((x for x in groups[t or ""] if x is not None), default=None)
        first = i == last and (t or "") not in done
        if first:
            done.add(t or "")
        out[i, len(raw), digest, "response" if first else "revisit", None if first else last] += 1
    return out


def test_archives_give_back_what_was_written(spark, tmp_path):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    got = w.archive_and_read(pages, folder=str(tmp_path))
    assert Counter(tuple(r) for r in got.collect()) == expected(rows)
    assert w.archive_and_read(pages.where("false"), folder=str(tmp_path / "none")).count() == 0


def test_small_payloads_can_all_be_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y" * 50), (4, "d", "y" * 50)], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in w.archive_and_read(pages, min_bytes=10, folder=str(tmp_path)).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_archives_roll_and_only_listed_files_are_read(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", hashlib.sha256(str(i).encode()).hexdigest() * 200) for i in range(80)], "page_id long, url string, html string")
    manifest = w.write_archives(w.archive_rows(pages).coalesce(1), str(tmp_path), sample_bytes=50_000, roll_bytes=20_000)
    files = manifest.collect()
    assert len(files) > 1 and sum(r.records for r in files) == 80
    (tmp_path / "left-over.warc.zst").write_bytes(b"of a lost attempt")
    back = w.read_archives(manifest, str(tmp_path)).collect()
    assert {int(r.id): r.payload.decode() for r in back} == {r.page_id: r.html for r in pages.collect()}


def test_format_of_an_archive(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://u/{i}", "<p>some words of a page</p>" * 30 + str(i)) for i in range(300)], "page_id long, url string, html string")
    (r,) = w.write_archives(w.archive_rows(pages).coalesce(1), str(tmp_path)).collect()
    raw = open(r.path, "rb").read()
    assert raw[:4] == bytes.fromhex("5d2a4d18")
    size = int.from_bytes(raw[4:8], "little")
    dictionary = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
    assert dictionary.dict_id() != 0
    # Every record is a frame of its own.
    rest, frames = raw[8 + size :], 0
    while rest:
        one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        record = one.decompress(rest)
        assert record.startswith(w.VERSION) and record.endswith(b"\r\n\r\n")
        rest, frames = one.unused_data, frames + 1
    assert frames == 301
    with pytest.raises(ValueError):
        list(w.read_records(io.BytesIO(raw[8 + size :])))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head>
<body><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Big&nbsp;title &amp; more</h1><p><b>First   words,<br>
with &#233; and &eacute;.<p>Second one <a href="x>y">link</a>ed.</p><!-- gone --><div class="comments"><p>Me too</p></div></article>
<footer>&copy; all</footer></body>"""


def test_blocks_of_a_loose_page():
    blocks = h.parse(PAGE)
    holds = h.marked(blocks)
    assert h.runs(blocks, holds) == ["Big title & more", "First words, with é and é.", "Second one linked."]
    assert [b.tag for b in blocks if b.parent >= 0 and blocks[b.parent].tag == "ul"] == ["li", "li"]
    assert h.runs(h.parse("a<div>b</div>c<p>d"), [True] * 9) == ["a", "b", "c", "d"]
    for odd in (None, "", "<", "<a", "</", "<p", "<!--", "<script>x", "&amp", "<p class=>", "<div " * 50, "</div></p>"):
        h.runs(h.parse(odd), [True] * len(h.parse(odd)))
    deep = "<div>" * 20_000 + "x"
    assert h.runs(h.parse(deep), [True] * 20_001) == ["x"]


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(0)
    for _ in range(40):
        n = 9
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        odds, weight = rng.normal(size=n) * 3, rng.random(n) + 0.1
        best, choice = -1e9, None
        for bits in range(1 << n):
            keep = [bool(bits >> i & 1) for i in range(n)]
            if not keep[0] or any(keep[i] and not keep[parent[i]] for i in range(1, n)):
                continue
            score = sum((-np.logaddexp(0, -odds[i]) if keep[i] else -np.logaddexp(0, odds[i])) * weight[i] for i in range(1, n))
            if score > best:
                best, choice = score, keep
        assert h.decode(parent, odds, weight) == choice


@pytest.fixture(scope="module")
def site(spark):
    rng = np.random.default_rng(3)
    say = lambda k: " ".join(rng.choice(["amber", "boat", "of", "the", "cold", "days."], k)) + "."
    rows = []
    for i in range(120):
        paragraphs = [say(int(rng.integers(2, 60))) for _ in range(int(rng.integers(1, 9)))]
        links = "".join(f"<li><a href=/{k}>{say(1)}</a>" for k in range(6))
        html = (
            f"<html><body><nav><ul>{links}</ul></nav><div class=ad>{say(8)}</div><article><h1>{say(4)}</h1>"
            + "".join(f"<p>{t}</p>" for t in paragraphs) + f"</article><footer>&copy; {say(9)}</footer></body></html>"
        )
        rows.append((i, f"u{i}", html))
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_held_out_pages_and_other_layouts(spark, site):
    extractor = h.learn_extractor(site.where("page_id < 80"))
    right, relaid_right, blocks_seen = 0, 0, 0
    for r in site.where("page_id >= 80").collect():
        blocks = h.parse(r.html)
        holds = h.marked(blocks)
        right += extractor.texts([r.html]) == ["\n\n".join(h.runs(blocks, holds))]
        other, truth = h.relaid(blocks, holds, 999 + r.page_id)
        odds = extractor.trees.log_odds(h.features(other, extractor.lexicon, {}))
        kept = h.decode([b.parent for b in other], odds, np.ones(len(other)))
        with_text = [i for i, b in enumerate(other) if b.parts and isinstance(b.parts[0], str)]
        relaid_right += sum(kept[i] == truth[i] for i in with_text)
        blocks_seen += len(with_text)
    assert right >= 38
    assert relaid_right >= 0.9 * blocks_seen
    odd = spark.createDataFrame([(1, "u", None, "t"), (2, "v", "", "t"), (2, "v", "", "t"), (None, None, "<article><p>x " + "y" * 300_000, "t")],
                                "page_id long, url string, html string, text string")
    rows = h.extract_text(odd, extractor).collect()
    assert rows[0].asDict().keys() == {"page_id", "url", "text", "n_chars"} and len(rows) == 4
    assert all(r.n_chars == len(r.text) for r in rows) and sorted(len(r.text) for r in rows)[:3] == [0, 0, 0]
    assert h.extract_text(odd.where("false"), extractor).count() == 0


def test_nothing_to_learn_from(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>b")], "page_id long, url string, html string")
    extractor = h.learn_extractor(pages)
    assert [r.text for r in h.extract_text(pages, extractor).collect()] == ["a\n\nb"]
    assert h.learn_extractor(pages.where("false")).texts([None]) == [""]
