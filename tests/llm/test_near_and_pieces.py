import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline.llm import components as c
from proofline.llm import near_dedup as n
from proofline.llm import pieces as p
from proofline.llm.common import PIECE_MODEL
from tests.llm.test_search_and_urls import words


def shingle_set(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(rows):
    """Smallest id by union-find over all pairs; texts without words stay alone."""
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                group[find(a)] = find(b)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    return [(rows[i][0], min((x for x in members[find(i)] if x is not None), default=None), len(members[find(i)])) for i in range(len(rows))]


def near_rows(seed=2, n_base=12):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    common = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for _ in range(n_base):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 8, 40, 120]))] + common[: rng.choice([0, 12, 30])]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_classes_match_brute_force(spark):
    rows = near_rows() + [(500, None), (501, ""), (502, "?!"), (None, "V1 v2"), (503, "v1, V2"), (504, "v1 v2")]
    rows += [(505, "same words here"), (505, "same words here"), (505, "same words, here")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
    got = n.mark_near_copies(df).collect()
    assert Counter((r.doc_id, r.class_id, r.group_size) for r in got) == Counter(expected(rows))
    kept = n.drop_near_copies(df)
    assert kept.columns == df.columns
    assert kept.count() == sum(r.kept for r in got)
    with_words = [r for r in got if r.group_size > 1]
    assert Counter(r.class_id for r in with_words if r.kept) == Counter({r.class_id: 1 for r in with_words})


def expected(rows):
    # A null id is the smallest.
    out = []
    for (i, t), (_, c, s) in zip(rows, classes(rows)):
        same = [j for (j, u) in rows if words(u) == words(t)]
        out.append((i, None if None in same and words(t) else c, s))
    return out


def test_nothing_in_nothing_out(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert n.mark_near_copies(none).count() == 0 and n.drop_near_copies(none).count() == 0


def test_many_near_copies_are_one_class(spark):
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join(base[:50] + [f"x{i}"] + base[51:])) for i in range(600)]
    got = n.mark_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_shingles_are_those_of_the_words():
    texts = ["A b, c d e f", "a B c d E", None, "", "one", "  x-y ", "é a b c d e", "f a b c d e"]
    who, hashes, whole = n.shingles(texts)
    seen = {}
    for w, h in zip(who.tolist(), hashes.tolist()):
        seen.setdefault(w, []).append(h)
    for i, t in enumerate(texts):
        assert len(seen.get(i, [])) == len(shingle_set(t))
        assert (whole[i] != 0) == bool(words(t))
    assert seen[0][0] == seen[1][0] and seen[6][1] == seen[7][1] and seen[6][0] != seen[7][0]


def test_registers_agree_as_often_as_the_probability_similarity_says():
    rng = np.random.default_rng(1)
    shared, own = rng.integers(1, 2**63, (2, 300), np.uint64)
    a = np.concatenate([shared[:200], own[:60]])
    b = np.concatenate([shared[:200], own[60:90]])
    wa, wb = 1 + rng.integers(0, 4, len(a)).astype(float), np.ones(len(b))
    wb[:200] = wa[:200]
    who = np.repeat([0, 1], [len(a), len(b)])
    sig = n.signatures(who, np.concatenate([a, b]), np.concatenate([wa, wb]), 2, 4000)
    total = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
    keys = set(total[0]) | set(total[1])
    want = sum(
        1 / sum(max(total[0].get(k, 0) / total[0][d], total[1].get(k, 0) / total[1][d]) for k in keys)
        for d in keys if d in total[0] and d in total[1]
    )
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


@pytest.fixture(scope="module")
def model():
    return p.PieceModel(PIECE_MODEL)


ODD = [
    "a  b", "  a", "a ", " ", "", "a\nb\tc", "éè 日本 \U0001F600 x", "ﬁ ① ②", "a\x00b", "　x", "é", "x" * 5000, " " * 50,
    "a" + " " * 40 + "①", "   ①  ", "\n\n  \n", "<s> <unk> <0x0A>", "for(int i=0;i<n;++i){}", "aaaaaaa aaaa ababababa", "1234567 89",
]


def test_pieces_are_those_of_the_library(model):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=PIECE_MODEL)
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("abcdeéi nosthr\n") for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    got = p.encode_texts(model, texts + [None])
    assert got[-1] is None
    for t, ids in zip(texts, got):
        assert ids.tolist() == sp.encode(t), t
        assert p.decode_ids(model, ids) == t


def test_encode_and_decode_keep_rows(spark, docs, model):
    df = docs([(100 + i, t, "en", "a", 1) for i, t in enumerate(ODD)]).withColumn("pieces", F.lit("old"))
    both = p.decode(p.encode(df, model), model)
    assert both.columns == ["doc_id", "text", "lang", "source", "n_chars", "pieces", "decoded"]
    rows = both.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in df.collect())
    assert all(r.decoded == r.text for r in rows)
    assert all(r.pieces is None for r in rows if r.text is None) and [r.pieces for r in rows if r.text == ""] == [[], []]
    assert p.encode(df.where("false"), model).count() == 0


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        p.PieceModel(str(tmp_path / "none.model"))


def repeated_passage(seed, times=100):
    """Two texts with the same shingles; the second repeats a passage far more often."""
    rng = random.Random(seed)
    text = [f"w{rng.randrange(10**6)}" for _ in range(70)]
    passage = [f"p{rng.randrange(10**6)}" for _ in range(30)]
    return " ".join(text + passage * 2), " ".join(text + passage * times)


def test_copies_that_differ_in_how_often_a_passage_repeats_are_found(spark):
    # By the weighted bands alone these two pairs are missed.
    rows = [(i, t) for seed, i in ((98, 0), (109, 2)) for i, t in enumerate(repeated_passage(seed), i)]
    got = n.mark_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {0: 0, 1: 0, 2: 2, 3: 2}


def test_every_pair_has_bands_of_equal_weights():
    texts = [t for seed in range(20) for t in repeated_passage(seed)] + ["one two three four five six"]
    who, hashes, _ = n.shingles(texts)
    who, hashes, counts = n.weighed(who, hashes)
    bands = n.all_bands(who, hashes, counts, len(texts), 30, 5)
    assert all(len(set(a.tolist()) & set(b.tolist())) >= 30 for a, b in zip(bands[:-1:2], bands[1::2]))
    assert all(len(set(b.tolist())) == len(b) for b in bands) and len(bands[-1]) == 30


def test_one_pass_gives_pieces_and_the_text_again(spark, docs):
    from proofline.llm.common import PIECE_MODEL

    df = docs().withColumn("decoded", F.lit("old")).select("doc_id", "text", "decoded")
    model = p.PieceModel(PIECE_MODEL)
    both = p.encode(df, model, decoded="decoded")
    apart = p.decode(p.encode(df, model), model)
    assert both.columns == ["doc_id", "text", "pieces", "decoded"] and apart.columns == both.columns
    key = lambda r: (str(r.doc_id), r.text or "")
    assert sorted(map(tuple, both.collect()), key=str) == sorted(map(tuple, apart.collect()), key=str)
    assert all(r.decoded == r.text for r in sorted(both.collect(), key=key))


def crowd(copies=140, seed=5):
    """Texts each changed in a few places of one text, so that most are just below 0.8 to each other."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(copies):
        text = list(base)
        for _ in range(rng.choice([2, 3, 4, 5])):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**9)}"
        rows.append(text)
        if i % 12 == 0:  # one more with one place changed, and so linked to this one
            rows.append([*text[:75], f"y{i}", *text[76:]])
    return [(i, " ".join(t)) for i, t in enumerate(rows)]


def test_texts_just_below_the_threshold_are_not_compared_in_pairs(spark, monkeypatch):
    rows = crowd()
    compared, inner = [], n.verified

    def counted(pairs, texts, threshold):
        compared.append(pairs.count())
        return inner(pairs, texts, threshold)

    monkeypatch.setattr(n, "verified", counted)
    got = n.mark_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.group_size) for r in got) == sorted(classes(rows))
    assert 1 < len({r.class_id for r in got}) < len(rows)
    assert len(compared) == 2 and compared[1] < 4 * len(rows), compared


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_no_link_between_classes_is_lost(spark, threshold):
    rows = crowd(50, seed=8) + [(500 + i, t) for i, t in near_rows(seed=3, n_base=3)] + [(900, "b1 b2 b3")]
    texts = sorted({" ".join(words(t)): t for _, t in rows}.values())
    sets = [shingle_set(t) for t in texts]
    key = [i.to_bytes(4, "big") for i in range(len(texts))]
    similar = lambda a, b: len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9
    for hub in (0, 7, len(texts) - 1):
        # Those linked to the hub are in its class, all others alone.
        of = {i: hub if similar(i, hub) else i for i in range(len(texts)) if i != hub}
        members = [("k", key[i], key[hub], len(sets[i]), key[c]) for i, c in of.items()]
        open_ = spark.createDataFrame(members, "key string, words binary, hub binary, size int, class binary")
        nodes = spark.createDataFrame(list(zip(key, texts)), "words binary, text string")
        got = [(bytes(r.u), bytes(r.v)) for r in n._cross_pairs(open_, nodes, threshold).collect()]
        links = {(key[a], key[b]) for b in of for a in of if a < b and of[a] != of[b] and similar(a, b)}
        assert links and links <= set(got) and len(got) == len(set(got))


def test_differences_are_the_shingles_of_one_of_two(spark):
    texts = ["a b c d e f", "a b c d e g h", "one", "a b c d e f"]
    nodes = spark.createDataFrame([(bytes([i]), t) for i, t in enumerate(texts)], "words binary, text string")
    pairs = [(0, 1), (0, 2), (0, 3), (2, 1)]
    df = spark.createDataFrame([(bytes([a]), bytes([b]), a + b) for a, b in pairs], "u binary, v binary, more int")
    got = {(r.u[0], r.v[0]): (r.more, len(r.apart)) for r in n.differences(df, nodes).collect()}
    assert got == {(a, b): (a + b, len(shingle_set(texts[a]) ^ shingle_set(texts[b]))) for a, b in pairs}


def count_stored(monkeypatch):
    """The names of the tables that the steps write; each write is a round of tasks of its own."""
    names = []
    for module in (c, n):
        inner = module.stored
        monkeypatch.setattr(module, "stored", lambda df, name="llm", inner=inner: names.append(name) or inner(df, name))
    return names


def test_few_tables_are_written_on_the_way(spark, monkeypatch):
    names = count_stored(monkeypatch)
    rows = crowd(60, seed=3)
    got = n.mark_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.group_size) for r in got) == sorted(classes(rows))
    assert "rare" in names and len(names) <= 22, names


def test_stars_take_no_round_and_rounds_add_no_links(spark, monkeypatch):
    names = count_stored(monkeypatch)
    stars = [(5, 1), (6, 1), (6, 1), (9, 2)]
    got = c.components(spark.createDataFrame(stars, "u long, v long")).collect()
    assert sorted(got) == [(1, 1), (2, 2), (5, 1), (6, 1), (9, 2)] and len(names) == 2, names
    # 7 has two neighbours to link, and a link is there twice.
    links = spark.createDataFrame([(7, 3), (7, 4), (7, 4), (8, 4)], "u long, v long")
    assert not c._are_stars(links)
    for larger in (True, False):
        links = c._star(links, larger)
        assert links.count() == 4 and not links.where("u <= v").count()
    assert sorted(c.components(links).collect()) == [(3, 3), (4, 3), (7, 3), (8, 3)]
