"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from postlens.llm import byte_bpe, code_search, license_scan, mixing, ngram_join, pii, quality_rules, shingles, suffix_dedup, toxicity, url_filter  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_words int, `class` string, m string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base, passage = prose(1, 120), prose(2, 40)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    far = " ".join([*words[:60], *prose(3, 60).split()])
    return [base, base.upper(), near, far, prose(4, 30) + " " + passage + " " + prose(5, 30), passage + "\n" + prose(6, 50), None, "", "one two", "One  TWO\n", "ü" * 120 + " x " + "ü" * 120, "spam spam spam spam " * 30, prose(7, 9000), base]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "src1", 1, "c", "m") for i, t in enumerate(texts)] + [(None, texts[0], None, None, None, None, None), (13, texts[0], "en", "src1", 1, "c", "m")], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_suffix_dedup(docs, none, texts):
    seen, want = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        covered = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        want[i] = (len(b), sum(covered), len(re.findall(b"\1+", bytes(covered))), hashlib.sha256(bytes(x for x, c in zip(b, covered) if not c)).hexdigest())
    got = by_id(suffix_dedup.digests(docs))
    assert {i: tuple(got[i])[1:] for i in want} == want
    assert suffix_dedup.digests(docs).count() == len(texts) + 2 and suffix_dedup.digests(none).count() == 0


def test_suffix_dedup_of_rows_posted_twice(spark):
    """Rows of equal id and text (null ids too) are one document: text that stands nowhere else stays in them."""
    own, other = prose(31, 60), prose(32, 60)
    got = suffix_dedup.digests(spark.createDataFrame([(1, own), (1, own), (None, other), (None, other)], "doc_id long, text string")).collect()
    assert len(got) == 4 and all(r.n_removed == 0 for r in got)


def test_loser_tree_is_a_merge():
    r = random.Random(5)
    runs = []
    for _ in range(5):
        keys = sorted(bytes(r.choice(b"ab") for _ in range(r.randint(1, 8))) for _ in range(r.randint(0, 40)))
        runs.append((keys, [0, *[len(re.match(b"(.*)", b"")[0]) or next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(keys, keys[1:])]][: len(keys)]))
    flat = [k for keys, _ in runs for k in keys]
    order, common = suffix_dedup.merged(runs)
    out = [flat[i] for i in order]
    assert out == sorted(flat)
    assert all(out[i][: common[i]] == out[i - 1][: common[i]] for i in range(1, len(out)))


@pytest.mark.parametrize("count", [3, 5])
def test_code_search(spark, monkeypatch, count):
    """All rounds, with few wide segments and many narrow ones: codes that differ in few bits, codes that differ in nearly all, more and fewer queries than values."""
    monkeypatch.setattr(code_search.Segments, "of", classmethod(lambda cls, _: cls(count)))
    rng = np.random.default_rng(3)
    near = rng.integers(0, 1 << 62, 700, dtype=np.uint64) & np.uint64(0x0F0FFF000FF0F0FF)
    codes = np.unique(np.concatenate([near, ~near[:9], np.array([0, (1 << 64) - 1], np.uint64)]))
    table = spark.createDataFrame([(int(i), int(c)) for i, c in enumerate(codes.view(np.int64))], "least long, code long")
    queries = codes[::20]
    got = {}
    for r in code_search.nearest(table, spark.createDataFrame([(int(q),) for q in queries.view(np.int64)], "q long"), 5).collect():
        got.setdefault(r.q, []).append((r.distance, r.least))
    for q in queries:
        true = sorted((int(d), i) for i, d in enumerate(np.bitwise_count(codes ^ q)))[:5]
        assert sorted(got[int(q.view(np.int64))]) == true


def test_code_search_edges(spark, none):
    empty = spark.createDataFrame([], "id long, code long")
    rows = spark.createDataFrame([(1, 5, "x"), (2, 7, "y"), (None, 5, "z")], "id long, code long, q string")
    assert code_search.top_k(empty, empty).count() == 0 and code_search.top_k(rows, empty).count() == 0
    assert [(r.query_id, r.id, r.distance) for r in code_search.top_k(rows, rows.where("id = 1"), 3).collect()] == [(1, 2, 1)]
    codes = spark.createDataFrame([(None,), ([],), ([1.0, None, float("nan"), 2.0],), ([-1.0] * 63 + [1.0],)], "v array<float>").select(code_search.sign_code(F.col("v")).alias("c"))
    assert [r.c for r in codes.collect()] == [0, 0, 9, -(1 << 63)]
    with pytest.raises(Exception, match="64 bits"):
        spark.createDataFrame([([1.0] * 65,)], "v array<float>").select(code_search.sign_code(F.col("v"))).collect()


def test_code_search_ties_and_repeats(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(40)] + [(None, 1), (7, 1)], "id long, code long")
    got = code_search.top_k(rows, rows.where("id % 20 = 0"), 3).collect()
    assert {(r.query_id, r.rank): (r.id, r.distance) for r in got} == {(0, 1): (3, 0), (0, 2): (6, 0), (0, 3): (9, 0), (20, 1): (2, 0), (20, 2): (5, 0), (20, 3): (8, 0)}


def test_byte_bpe(docs, none, texts, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    made = byte_bpe.codec(path)
    got = by_id(byte_bpe.digests(docs, path))
    for i, t in enumerate(texts):
        ids = made.encoding.encode_ordinary(t or "")
        assert tuple(got[i])[1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert byte_bpe.digests(none, path).count() == 0
    back = by_id(byte_bpe.decoded(byte_bpe.ids(docs, path), path))
    assert bytes(back[4].bytes).decode() == texts[4]


def test_stitching_at_every_seam():
    text = "a  b\n\n c's 12 " * 400 + "x" * 3000 + " end"
    cut = [(text[i * 100 : i * 100 + 100], byte_bpe.boundaries(text[i * 100 : i * 100 + 180], 0, 40), [b - 100 for b in byte_bpe.boundaries(text[i * 100 : i * 100 + 140], 100, 138)]) for i in range(-(-len(text) // 100))]
    parts = list(byte_bpe.stitched(cut))
    made = byte_bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken")).encoding
    assert "".join(parts) == text and len(parts) > 20
    assert [x for p in parts for x in made.encode_ordinary(p)] == made.encode_ordinary(text)


def test_url_filter(spark):
    urls = ["https://a.spam-farm.example.org/en/1", "http://x.example.com/en/2", "http://www.example.com/en/2?q", "https://m.b.net/fr/1#t", None, "no scheme", "HTTP://A.Adult-X.example.NET", "https://net/es/", "s://h?x/y"]
    rows = url_filter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows.collect()}
    assert got == {0: ("a.spam-farm.example.org", "/en/1", None, "block"), 1: ("x.example.com", "/en/2", "example.com/en/", "block"), 2: ("www.example.com", "/en/2", "www.example.com/en/", "allow"), 3: ("m.b.net", "/fr/1", "net/fr/", "block"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("a.adult-x.example.net", "", None, "block"), 7: ("net", "/es/", "net/es/", "block"), 8: ("h", "", None, "allow")}
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_cascade_is_exact(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 3000, 7).select(F.concat(F.lit("k"), "id").alias("key"))
    told = url_filter.keyed(keys.unionByName(keys), listed.unionByName(spark.createDataFrame([(None,), ("other",)], "key string")))
    levels = url_filter.cascade(told, 429, 2571)
    hashed = keys.select("key", *url_filter._hashed("key")).toPandas()
    got = url_filter.member(levels, hashed.h1.to_numpy().view(np.uint64), hashed.h2.to_numpy().view(np.uint64))
    assert len(levels) > 1 and got.tolist() == [int(k[1:]) % 7 == 0 for k in hashed.key]


def test_url_filter_in_shards(spark, monkeypatch):
    """A list too large for MAX_BYTES is split by itself and gives the same verdicts; rows may repeat, and extra columns clash."""
    rows = [(i, f"https://a.h{i % 400}.org/x", "h", True) for i in range(800)] + [(3, "https://a.h3.org/x", "h", False), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, __listed boolean")
    names = spark.createDataFrame([(f"h{i}.org",) for i in range(0, 400, 3)], "key string")
    whole = sorted(map(tuple, url_filter.judged(pages, names).collect()), key=str)
    monkeypatch.setattr(url_filter, "MAX_BYTES", 64)
    assert url_filter.shards_for(134, 400) > 2
    assert sorted(map(tuple, url_filter.judged(pages, names).collect()), key=str) == whole
    assert {r[0] for r in whole if r[4] == "block"} == {i for i in range(800) if i % 400 % 3 == 0}


def test_license_scan(spark):
    rows = ["Released under the MIT license. mit License mit license", "no words of that kind", None, "under the GNU General Public License, version 2", "SPDX-License-Identifier: Apache-2.0", "mitlicense mit\u00e9 license"]
    got = by_id(license_scan.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")))
    assert tuple(got[0])[1:6] == (9, 3, 3, 7, "mit")
    assert (got[1].n_base, got[1].labels, got[2].n_words, got[2].first_word) == (0, "", 0, None)
    assert got[3].base_labels == "gpl" and "gpl-2.0" in got[3].labels and got[4].labels == "apache-2.0" and got[5].n_base == 0
    assert 300 <= len(license_scan.rules())


def test_license_of_academic_use():
    for text in (b"for academic use only", b"for academic purposes only", b"for research use only", b"for research purposes only"):
        assert license_scan.scanned(text)[5] == "academic-only"


def test_quality_counts(docs, none, texts):
    got = by_id(quality_rules.measures(docs, [F.col("doc_id")]))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        many = {g for g in grams if grams.count(g) > 1} if len(grams) < 500 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
        repeated = {k + x for k, g in enumerate(grams) if g in many for x in range(3)}
        m = got[i].m
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (m.n_words, m.word_chars, m.n_repeat_words) == (len(w), sum(map(len, w)), len(repeated)), i
        assert (m.n_symbols, m.lines.again) == (len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines))), i
    assert quality_rules.measures(none, [F.col("doc_id")]).count() == 0


def test_binomial_bound(spark):
    rows = spark.createDataFrame([(k, n) for n in (10, 200, 5000) for k in (0, 1, n // 50, n // 20)], "k long, n long")
    for r in rows.withColumn("p", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.05)).collect():
        true = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.05) + (r.n - i) * math.log(0.95)) for i in range(r.k + 1))
        assert r.p == 1.0 if r.k >= r.n * 0.05 else abs(r.p - true) < 1e-9


def test_cutoffs_are_brute_force(spark):
    """Strictest cutoffs whose exact binomial bound holds, by stratum; copies and repeated labels are one trial; strata without labels get none."""
    r = random.Random(13)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(5000)]
    rows = []
    for i in range(1500):
        bad = i % 5 == 0
        w = [r.choice(words) for _ in range(60)]
        rows.append((i, " ".join((x + " #") if bad and r.random() < 0.4 else x for x in w), ("en", "de", None)[i % 3] if i % 7 else "xx"))
    rows += [(5000 + i, rows[0][1], "en") for i in range(300)]  # copies of a bad one, all labelled good
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0 or i >= 5000), 0) for i, _, la in rows if la != "xx"] * 2, "doc_id long, quality int, toxic int")
    measured = quality_rules.measures(docs, [F.col("doc_id"), F.col("lang").alias("stratum")])
    got = {(x.stratum, x.rule): x.cutoff for x in quality_rules.cutoffs(measured, labels, alpha=0.5).collect()}
    alpha, tests = 0.5 / len(quality_rules.RULES), 3 * sum(map(len, quality_rules.RULES.values()))
    tail = lambda k, n: sum(math.comb(n, j) * alpha**j * (1 - alpha) ** (n - j) for j in range(k + 1))
    want = {}
    for stratum in ("en", "de", None):
        good = {t for i, t, la in rows if la == stratum and (i % 5 != 0 or i >= 5000)}
        symbols = [len(re.findall(r"[#*$%&|<>]", t)) / len(t.split()) for t in good]
        for cut in quality_rules.RULES["symbols_per_word"]:
            if tail(sum(x > cut for x in symbols), len(good)) <= 0.05 / tests:
                want[stratum, "symbols_per_word"] = cut
                break
    assert {k: v for k, v in got.items() if k[1] == "symbols_per_word"} == want and want
    out = by_id(quality_rules.judge(docs, labels, alpha=0.5))
    assert not any(out[i].kept for i, t, la in rows if la == "en" and t.count("#") / 60 > 0.3 and t.count("#") / len(t.split()) > want.get(("en", "symbols_per_word"), 9)) and all(out[i].kept for i, t, la in rows if la == "xx")
    assert quality_rules.judge(docs.where("false"), labels).count() == 0 and quality_rules.judge(docs, labels.where("false")).where("kept").count() == docs.count()


def test_quality_keeps_all_columns(spark, docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(14)], "doc_id long, quality int, toxic int")
    out = quality_rules.passed(docs, labels)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} >= {0, 2, 3, 4, 5}


def test_maximal_segments(monkeypatch):
    monkeypatch.setattr(toxicity, "DRIFT", 0.9)
    r = random.Random(1)
    for _ in range(300):
        n = r.randint(1, 14)
        scores = {i: r.uniform(-2.5, 3.5) for i in range(n) if r.random() < 0.7}
        full = [scores.get(i, 0.0) - 0.9 for i in range(n)]
        total = lambda a, b: sum(full[a:b])

        def split(low, high):
            """The best segment (leftmost, shortest), then those of what is left on both sides."""
            found = max(((total(a, b), -a, -b) for a, b in combinations(range(low, high + 1), 2)), default=(0, 0, 0))
            if found[0] <= 1e-9:
                return []
            a, b = -found[1], -found[2]
            return [*split(low, a), (a, b, found[0]), *split(b, high)]

        got = toxicity.maximal_segments(sorted(scores.items()))
        assert [(a, b, round(s, 6)) for a, b, s in got] == [(a, b, round(s, 6)) for a, b, s in split(0, n)]


def test_segments_of_long_texts_in_linear_time():
    """Hits too far apart to be merged, the worst case of a search without links."""
    import time

    took = []
    for n in (50_000, 200_000):
        scores = [(i * 1000, 1.0 + i % 7 / 10) for i in range(n)]
        start = time.perf_counter()
        assert len(toxicity.maximal_segments(scores)) == n
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * took[0]


def test_toxicity(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("the of and to in a is that".split()) for _ in range(80)) + (" you vile fool vile fool" if i % 4 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame([*rows, (9999, None), (9998, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = by_id(toxicity.scored(docs, toxicity.fit(docs, labels)))
    assert all((got[i].score >= 0.7) == (i % 4 == 0) for i, _ in rows) and got[9999].score == got[9998].score < 0.5
    assert toxicity.fit(docs, labels.where("toxic = 0")) == toxicity.Model()


def test_toxicity_of_rare_words(spark):
    """Words of 6 toxic texts and no other among 300 are evidence, words of as many texts of both kinds aren't."""
    rows = [(i, prose(100 + i, 40) + (f" insult{i // 10 % 5}" if i % 10 == 0 else "") + (f" usual{i // 50}" if i % 7 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))
    weights = toxicity.fit(docs, labels).weights
    learnt = {i for i, _ in rows if i % 10 == 0}
    held = {r.doc_id for r in docs.where(toxicity.held_out()).collect()}
    counts = {f"insult{k}": sum(i // 10 % 5 == k for i in learnt - held) for k in range(5)}
    strong = {w for w, n in counts.items() if n >= 4}
    assert strong and strong <= set(weights) and not any(w.startswith("usual") and weights[w] > 1 for w in weights)


def test_pii(spark):
    rows = ["+1 (743) 555-3824 and 4111 1111 1111 1111!", "4111111111111111 or 4111111111111112", "a@b.example.com 10.0.0.256 10.0.0.25 2024-02-30 2024-02-29", None, "", "GB82 WEST 1234 5698 7654 32", "078-05-1120 666-05-1120", "a@b.example.com"]
    got = by_id(pii.found(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")))
    assert got[0].kinds == ["phone", "card"] and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} and (\d{4} ){3}\d{4}!", got[0].text)
    card = got[0].text[-20:-1].replace(" ", "")
    assert got[1].text == f"{card} or 4111111111111112" and card != "4111111111111111"
    assert got[2].kinds == ["email", "ip", "date"] and "10.0.0.256" in got[2].text and "2024-02-30" in got[2].text
    assert got[3].text is None and got[4].text == "" and got[5].kinds == ["iban"] and got[6].kinds == ["ssn"] and got[6].text.endswith("666-05-1120")
    assert got[7].text == got[2].text.split()[0]


def test_pii_beside_other_tokens(spark):
    """What stands before or after a card or an IBAN neither hides it nor changes."""
    card, iban = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"
    rows = [f"{card}", f"{iban}", f"{card} 12/27", f"{card} 123", f"2 {card}", f"1234 {card} 5678", f"{card}-12345", f"{card} 12 {card} 35", f"{iban} EUR", f"{iban} PLEASE PAY NOW", f"pay {iban} {card} 99 now", f"12345 078-05-1120 and {card} 2024-02-29", "9999 9999 9999 9999 1 2", "7 " * 5000]
    got = by_id(pii.found(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")))
    c, i = got[0].text, got[1].text
    assert c != card and i != iban and got[0].kinds == ["card"] and got[1].kinds == ["iban"]
    for n in (2, 3, 4, 5, 6, 7, 8, 9, 10):
        assert got[n].text == rows[n].replace(card, c).replace(iban, i)
    assert got[7].kinds == ["card", "card"] and got[10].kinds == ["iban", "card"] and got[11].kinds == ["ssn", "card", "date"]


def luhn(d):
    return sum((2 * int(x) - 9 if int(x) > 4 else 2 * int(x)) if i % 2 else int(x) for i, x in enumerate(d[::-1])) % 10 == 0


def test_pii_leaves_numbers(spark):
    """Tables of numbers, years and counts stay; cards among other tokens are found wherever they stand."""
    r = random.Random(21)
    numbers = lambda n, low, high, sep=" ": sep.join(str(r.randint(low, high)) for _ in range(n))
    plain = ["years " + " ".join(map(str, range(1990, 2020))), " ".join(map(str, range(1, 26))), numbers(1000, 10, 99), numbers(1000, 1000, 9999), numbers(1000, 1000, 9999, "-"), numbers(500, 0, 999_999), numbers(200, 1_600_000_000_000, 1_799_999_999_999)]
    plain += [numbers(n, 10, 99) for n in range(7, 40)] + [numbers(n, 1, 9) for n in range(13, 60)] + [numbers(4, 1900, 1999) for _ in range(60)] + [numbers(n, 100, 999) for n in range(5, 30)]
    got = by_id(pii.found(spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string")))
    assert all(got[i].text == t and not got[i].kinds for i, t in enumerate(plain))

    def card():
        while True:
            d = r.choice(("4", "51", "55", "2300", "6011", "65")) + "".join(r.choice("0123456789") for _ in range(16))
            if luhn(d[:16]):
                return r.choice((d[:16], " ".join(d[k : k + 4] for k in range(0, 16, 4)), "-".join(d[k : k + 4] for k in range(0, 16, 4))))

    amex = "3782 822463 10005"
    among = [[numbers(r.randint(0, 3), 0, 999), c, numbers(r.randint(0, 3), 0, 99)] for c in [amex, *(card() for _ in range(150))]]
    got = by_id(pii.found(spark.createDataFrame([(i, " ".join(x for x in a if x)) for i, a in enumerate(among)] + [(1000 + i, a[1]) for i, a in enumerate(among)], "doc_id long, text string")))
    many = [" ".join(a[1] for a in among[k : k + 5]) for k in range(1, 100, 5)]
    lists = by_id(pii.found(spark.createDataFrame(list(enumerate(many)), "doc_id long, text string")))
    assert all(lists[k].kinds == ["card"] * 5 and lists[k].text == " ".join(got[1000 + i].text for i in range(1 + 5 * k, 6 + 5 * k)) for k in range(len(many)))
    for i, a in enumerate(among):
        assert got[i].kinds == ["card"] and got[i].text == " ".join(x for x in [a[0], got[1000 + i].text, a[2]] if x), a


def test_pii_is_linear_in_numbers(spark):
    import time

    def took(n):
        df = spark.createDataFrame([(1, "12 " * n + "4111 1111 1111 1111 " + "34 " * n)], "doc_id long, text string")
        start = time.time()
        assert pii.found(df).first().kinds == ["card"]
        return time.time() - start

    fixed = min(took(10), took(10))
    assert took(32_000) < 2 * fixed + 2


def test_pii_phones_stay_linked(spark):
    """One number in any spelling has one pseudonym, with its country code; other numbers have others."""
    same = [["+491701234567", "+49 170 1234567", "+49-170-123-4567", "+49 (170) 1234567"], ["+1 743 555 3824", "(743) 555-3824", "743-555-3824", "743.555.3824", "+17435553824"], ["+351 912 345 678", "+351912345678"], ["+491701234568"], ["+7 495 123 45 67"]]
    rows = [(i, f"call {x} now") for i, x in enumerate(x for g in same for x in g)]
    got = by_id(pii.found(spark.createDataFrame(rows, "doc_id long, text string")))
    digits, at = [], 0
    for group in same:
        mine = {re.sub("[^0-9]", "", got[at + i].text)[-(len(re.sub("[^0-9]", "", min(group, key=len)))):] for i in range(len(group))}
        assert all(got[at + i].kinds == ["phone"] and re.sub("[0-9]", "0", got[at + i].text) == re.sub("[0-9]", "0", rows[at + i][1]) for i in range(len(group)))
        digits.append({x[-10:] if group[0].startswith("+1 ") else x for x in mine})
        at += len(group)
    assert all(len(d) == 1 for d in digits) and len({x for d in digits for x in d}) == len(same)
    assert [min(d)[:n] for d, n in zip(digits, (2, 0, 3, 2, 1))] == ["49", "", "351", "49", "7"]


def test_pii_edges(spark, docs, none):
    assert pii.found(none).count() == 0 and pii.pseudonymised(docs).columns == docs.columns
    left = {(r.doc_id, r.text) for r in docs.collect()}
    assert {(r.doc_id, r.text) for r in pii.pseudonymised(docs).collect()} == left
    rows = [(1, "born 1990-02-28"), (1, "born 1990-02-28"), (None, "https://a.org/2024-02-28/x?d=2024-02-28"), (3, ("x " * 40_000) + "born 1990-02-28")]
    got = pii.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.kinds for r in got] == [["date"], ["date"], [], ["date"]] and got[0].text == got[1].text and got[3].text.endswith(got[0].text)
    spark.conf.set(pii.KEY_SETTING, "another")
    try:
        assert pii.found(spark.createDataFrame(rows[:1], "doc_id long, text string")).first().text != got[0].text
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_pii_is_brute_force(spark):
    """Every valid value among random ones is found at its place, and nothing else changes."""
    r = random.Random(12)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    values = []
    for _ in range(120):
        d = digits(16)
        odd = d[::-1][1:]
        total = sum((2 * int(x) - 9 if int(x) > 4 else 2 * int(x)) if i % 2 == 0 else int(x) for i, x in enumerate(odd)) + int(d[-1])
        values.append((d, "card" if total % 10 == 0 else None))
        o = [r.randint(0, 300) for _ in range(4)]
        values.append((".".join(map(str, o)), "ip" if max(o) < 256 else None))
        y, m, day = r.randint(1900, 2100), r.randint(0, 13), r.randint(0, 32)
        try:
            __import__("datetime").date(y, m, day)
            values.append((f"{y}-{m:02}-{day:02}", "date"))
        except ValueError:
            values.append((f"{y}-{m:02}-{day:02}", None))
        s = (digits(3), digits(2), digits(4))
        values.append(("-".join(s), "ssn" if 0 < int(s[0]) < 900 and s[0] != "666" and int(s[1]) and int(s[2]) else None))
    got = by_id(pii.found(spark.createDataFrame([(i, f"see {v}, end") for i, (v, _) in enumerate(values)], "doc_id long, text string")))
    for i, (v, kind) in enumerate(values):
        assert got[i].kinds == ([kind] if kind else []), v
        assert got[i].text.startswith("see ") and got[i].text.endswith(", end") and (kind or got[i].text == f"see {v}, end")
    for kind in ("card", "ip", "date", "ssn"):
        pairs = {(v, got[i].text) for i, (v, k) in enumerate(values) if k == kind}
        assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)


def test_feistel_is_a_permutation(spark):
    pairs = spark.range(13 * 7).select(pii.feistel(F.floor(F.col("id") / 7), F.col("id") % 7, F.lit(13), F.lit(7), F.lit("t"), "k").alias("p")).collect()
    assert len({(r.p.a, r.p.b) for r in pairs}) == 13 * 7 and all(r.p.a < 13 and r.p.b < 7 for r in pairs)


def test_budgets_stay_with_siblings_first(spark):
    leaves = spark.createDataFrame([("web", "en", "a", 10), ("web", "en", "b", 1000), ("web", "de", "c", 1000), ("books", "en", "d", 1000)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.budget for r in mixing.source_budgets(leaves, 400, mixing.Weights(domain={"web": 1.0, "books": 1.0}), 1).collect()}
    # the web's half is split by language; a's shortage goes to b, its sibling, and not to c or d
    assert got == {"a": 10, "b": 90, "c": 100, "d": 200}


def test_source_budgets_are_shares(spark):
    """The rounds over sums give each source what the list of siblings gives."""
    r = random.Random(9)
    rows = [("web", "en", f"s{i}", r.choice((0, 1, 5, 50, 900, 20_000))) for i in range(60)] + [("web", None, None, 70), ("web", "en", None, 33)]
    weights = mixing.Weights(source={f"s{i}": r.choice((0.0, 0.5, 3.0, 10.0)) for i in range(0, 60, 3)})
    for budget in (0, 1, 500, 30_000, 10**9):
        got = {(x.lang, x.source): x.budget for x in mixing.source_budgets(spark.createDataFrame(rows, "domain string, lang string, source string, tokens long"), budget, weights, 2).collect()}
        of = lambda name: weights.source.get(name, 1.0) if name else 1.0
        groups = {la: [x for x in rows if x[1] == la] for la in ("en", None)}
        top = mixing.split_by_language([("web", la, float(2 * sum(x[3] for x in g if of(x[2]) > 0))) for la, g in groups.items()], budget, weights)
        for la, g in groups.items():
            want = mixing.shares([(of(x[2]), 2.0 * x[3]) for x in g], top["web", la])
            assert all(abs(got[la, x[2]] - w) <= 1 for x, w in zip(g, want))


def test_mixing_prefix_is_brute_force(spark, monkeypatch):
    """Each leaf takes whole epochs and then documents in the order of their points while they fit, whatever the slots."""
    monkeypatch.setattr(mixing, "SLOT_ROWS", 7)
    r = random.Random(10)
    rows = [(i, " ".join(["w"] * r.choice((0, 1, 2, 9, 40))) if i % 17 else None, r.choice(("en", "de", None)), r.choice(("src0", "src1", None))) for i in range(400)] + [(5, "w w", "en", "src0")] * 2 + [(None, "w", "en", "src0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.selected(docs, budget_share=0.7, max_epochs=2)
    counts = docs.select("doc_id", mixing.domain_of(F.col("source")).alias("domain"), "lang", "source", mixing.tokens_of(F.col("text")).alias("tokens"), mixing._text_key().alias("key"))
    plan = {(p.domain, p.lang, p.source): p for p in mixing.planned(counts, 0.7, mixing.WEIGHTS, 2).collect()}
    points = counts.join(mixing.planned(counts, 0.7, mixing.WEIGHTS, 2).select(*[F.col(c).alias(f"p_{c}") for c in mixing.LEAF], "epochs"), F.expr(" AND ".join(f"{c} <=> p_{c}" for c in mixing.LEAF))).withColumn("point", mixing._point(11, F.col("epochs"), F.col("doc_id"), F.col("key"))).collect()
    want = []
    for leaf, p in plan.items():
        mine, run = sorted((x for x in points if (x.domain, x.lang, x.source) == leaf), key=lambda x: x.point), 0
        for at in sorted({x.point for x in mine}):
            some = [x for x in mine if x.point == at]
            run += sum(x.tokens for x in some)
            want += [(x.doc_id, x.tokens, p.epochs + (1 if p.rest > 0 and run <= p.rest else 0)) for x in some]
    key = lambda x: (x[0] is None, x)
    assert sorted(((x.doc_id, x.tokens, x.copies) for x in got.collect()), key=str) == sorted(want, key=str)


def test_mixing(spark, none):
    rows = [(i, "w " * (1 + i % 5), "en", f"src{i % 2}", 1, "c", "m") for i in range(300)] + [(500, None, None, None, 1, "c", "m")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.selected(docs, budget_share=0.5, max_epochs=1)
    sums = got.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("copies"))).first()
    assert 0.45 * sums[0] <= sums[1] <= 0.5 * sums[0] and got.count() == 301
    assert mixing.mixed(docs, budget_share=0.5, max_epochs=1).columns == docs.columns
    assert mixing.selected(none).count() == 0


def test_shingles(texts):
    values, bounds = shingles.shingle_sets([(t or "").encode() for t in texts])
    for i, t in enumerate(texts):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        want = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        assert bounds[i + 1] - bounds[i] == len(want)


def test_ngram_join(docs, none, texts):
    got = by_id(ngram_join.joined(docs.where("doc_id IS NOT NULL")))
    assert [got[i].component_id for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 13)] == [0, 0, 0, 3, 4, 5, 6, 7, 8, 8, 0]
    assert (got[6].n_shingles, got[8].n_shingles, got[9].n_shingles) == (0, 1, 1)
    assert ngram_join.joined(none).count() == 0
    left = ngram_join.one_of_each(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [0, 3, 4, 5, 6, 7, 8, 10, 11, 12]


def test_license_scan_is_brute_force():
    """Every rule run on every text without a gate, containment by comparing all pairs, places by stepping through the words."""
    made, _ = license_scan._compiled()
    r = random.Random(6)
    pieces = ["MIT License", "licensed under the Apache License, Version 2.0", "GNU General Public License v3", "any later version", "CC BY-NC-SA 4.0", "all rights reserved", "SPDX-License-Identifier: MIT", "mit", "license", "general public", "é", "the BSD 3-Clause license", "https://opensource.org/licenses/MIT", "not for commercial use", "x" * 50]
    texts = [" ".join(r.choice(pieces) for _ in range(r.randint(0, 12))) for _ in range(150)] + ["", "MIT License " * 3000]
    for text in texts:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = sorted((i, label) for phrase, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        low = b" ".join(text.encode().lower().split()).decode()
        hits = sorted((-p, m.start() - m.end(), n, m.start(), m.end()) for n, (_, p, rx) in enumerate(made) for m in rx.finditer(low))
        kept = []
        for p, _, n, a, b in hits if len(hits) < 2000 else []:
            if not any(x <= a and b <= y for x, y, *_ in kept):
                kept.append((a, b, made[n][0], -p))
        got = license_scan.scanned(text.encode())
        assert got[:4] == (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None)
        assert got[4] == ",".join(sorted({label for _, label in places}))
        if len(hits) < 2000:
            assert license_scan.detections(low) == sorted(kept)
            assert got[5] == ",".join(sorted({k[2] for k in kept} | {label for _, label in places}))


def test_license_rules():
    """Hundreds of patterns, more than two hundred of them one by one, each behind a keyword that every match holds."""
    from postlens.llm import license_rules

    found = license_scan.rules()
    assert len(found) > 500 and len(license_rules._rows(license_rules.TEXTS)) > 200 and all(k for _, _, k, _ in found)
    assert license_rules.required(r"(?:gnu )?(?:gpl|general public licen[sc]e),? ?2") == {"gpl", "general public license", "general public licence"}


def test_license_scan_edges(spark, docs, none):
    assert license_scan.scan(none).count() == 0
    rows = license_scan.scan(docs).collect()
    assert len(rows) == docs.count() and {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}


def test_nothing_quadratic_in_long_texts():
    import time

    took = []
    for n in (20_000, 80_000):
        text = "mit license apache license " * n
        start = time.perf_counter()
        license_scan.scanned(text.encode())
        took.append(time.perf_counter() - start)
    assert took[1] < 10 * took[0]


def test_isotonic_steps_rise():
    r = random.Random(20)
    x = [r.random() * 5 for _ in range(2000)]
    y = [int(r.random() < (0.02 if v < 2 else 0.3 if v < 3 else 0.98)) for v in x]
    steps = toxicity.isotonic(x, y)
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(steps, steps[1:]))
    model = toxicity.Model(steps=steps)
    scores = [model.score(math.expm1(v / 10)) for v in range(80)]
    assert scores == sorted(scores) and 0 < scores[0] < 0.05 and 0.9 < scores[45] < scores[-1] < 1
    assert abs(model.score(math.expm1(2.5)) - 0.3) < 0.1
    assert toxicity.isotonic([0.0] * 50, [1] * 10 + [0] * 40)[0][0] == 0.0
