"""The n-gram join against brute force over every pair: exact thresholds, hot shingles, large stars, chains."""

import random
import re

import pytest

pytest.importorskip("public_tokenizers")

from postlens.llm import ngram_join  # noqa: E402


def sets_of(texts):
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def links_of(sets):
    return {(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}


def components_of(n, links):
    part = list(range(n))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i, j in links:
        a, b = root(i), root(j)
        part[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(4))
    prose = lambda n: [word() for _ in range(n)]
    out = []
    hot = prose(12)  # a passage that most texts share
    for _ in range(60):
        out.append(prose(r.randint(5, 40)) + hot + prose(r.randint(0, 30)))
    # 75 % exactly, and one shingle less: sets of 7 with 6 in common of 8, and chains of shifted windows
    for n in (11, 18, 25, 32, 60):
        base = prose(n + 60)
        for shift in range(0, 12):
            out.append(base[shift : shift + n])
    base = prose(80)
    for i in range(70):  # a large star of near copies of one text, and some that differ in many places
        some = list(base)
        for _ in range(r.choice((1, 1, 2, 2, 3, 4))):
            some[r.randrange(80)] = word()
        out.append(some)
    for n in (1, 2, 3, 4, 5, 6):
        short = prose(n)
        out += [short, short, [*short[:-1], word()]]
    r.shuffle(out)
    return [" ".join(x) for x in out] + [None, "", " \n", out[0] and " ".join(out[0]).upper()]


def test_joined_is_brute_force(spark, texts, monkeypatch):
    """With tiny fragments and star blocks, so that every cut is crossed."""
    monkeypatch.setattr(ngram_join, "FRAGMENT", 300)
    monkeypatch.setattr(ngram_join, "MEMBERS", 7)
    sets = sets_of(texts)
    want = components_of(len(texts), links_of(sets))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.joined(docs).collect()}
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}
    assert len(set(want)) < len(want) - 60


def test_pairs_are_all_links(spark, texts):
    sets = sets_of(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = {bytes(r["class"]): r.doc_id for r in ngram_join.documents(docs).collect()}
    got = {frozenset((of[bytes(r.a)], of[bytes(r.b)])): r.common for r in ngram_join.pairs(docs).collect()}
    first = {s: i for i, s in enumerate(sets)}  # the last of equal sets, as in ``of``
    want = {frozenset((first[sets[i]], first[sets[j]])): len(sets[i] & sets[j]) for i, j in links_of(sets) if sets[i] != sets[j]}
    assert {frozenset(sets[i] for i in k): v for k, v in got.items()} == {frozenset(sets[i] for i in k): v for k, v in want.items()}


def test_bloom_that_is_full_changes_nothing(spark, texts, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOOM_BITS", 64)
    sets = sets_of(texts)
    want = components_of(len(texts), links_of(sets))
    got = {r.doc_id: r.component_id for r in ngram_join.joined(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_prefixes_share_what_is_promised():
    """Any two sets of the similarity share, in their prefixes, the least surplus of a partner."""
    import numpy as np

    r = random.Random(3)
    for _ in range(300):
        n = r.randint(1, 60)
        a = set(r.sample(range(10_000), n))
        b = set(r.sample(sorted(a), -(-75 * n // 100))) if r.random() < 0.5 else a | set(r.sample(range(10_000, 20_000), n // 3))
        if 100 * len(a & b) < 75 * len(a | b):
            continue
        cut = [set(ngram_join.prefix_of(np.array(sorted(x), np.uint64), np.array([0, len(x)]))[0].tolist()) for x in (a, b)]
        for x in (len(a), len(b)):
            assert len(cut[0] & cut[1]) >= max(1, -(-75 * x // 100) * ngram_join.SURPLUS // 100)


@pytest.fixture(scope="module")
def near_copies(spark):
    """A large group of near copies whose changes are shared by some, so each is in many stars, and as many texts that are like nothing."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(f"x{r.randrange(3)}" if r.random() < 0.02 else w for w in base) for _ in range(300)]
    texts += [" ".join(f"y{r.randrange(10_000)}" for _ in range(40)) for _ in range(300)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


def test_a_near_copy_is_counted_against_one_middle_of_its_stars(near_copies, monkeypatch):
    """Not against those of all stars that it is in, each in every fragment."""
    texts, docs = near_copies
    counted = []

    def spy(df, name):
        out = real(df, name)
        if out.columns == ["a", "b", "an", "bn"]:
            counted.append(out.count())
        return out

    real = ngram_join.written
    monkeypatch.setattr(ngram_join, "written", spy)
    got = {r.doc_id: r.component_id for r in ngram_join.joined(docs).collect()}
    sets = sets_of(texts)
    want = components_of(len(texts), links_of(sets))
    assert [got[i] for i in range(len(texts))] == want
    alike = len({s for s, w in zip(sets, want, strict=True) if want.count(w) > 1})
    assert alike > 200 and 0 < sum(counted) < 3 * alike


def test_tallies_are_a_row_for_each_fragment_and_bucket(near_copies, monkeypatch):
    """Not one for each class and fragment, of which there are more with every row."""
    texts, docs = near_copies
    total = sum(map(len, sets_of(texts)))
    monkeypatch.setattr(ngram_join, "FRAGMENT", 800)
    fragments, buckets = ngram_join.fragments_of(total // 2), ngram_join.fragments_of(total // 4)
    blocks = ngram_join.tallies(docs, total).collect()
    tallies = sum(len(ngram_join._unpacked(x.block, "u8", "u4")[0]) for x in blocks)
    assert fragments > buckets >= 16 and len(blocks) <= fragments * buckets and tallies > 4 * len(blocks)
