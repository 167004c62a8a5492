"""Every operator and stage on the same awkward tables: nulls in any column, empty and very long texts, ties, repeated rows, no rows, clashing columns."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from postlens.llm import byte_bpe, license_scan, mixing, ngram_join, pii, quality_rules, suffix_dedup, toxicity  # noqa: E402

#: Names that the operators use inside.
CLASHING = "n int, m int, id string, label string, key string, class string, raw string, h string, doc string, part string, places string, stratum string, tokens string, copies string, kinds string, toxic string, fragment string, block string, h1 string, count string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = [(1, prose(1, 80), "en", "src1"), (2, prose(1, 80), "en", "src1"), (3, "", "de", None), (4, None, None, "src2"), (None, prose(2, 70), "en", "src1"), (None, None, None, None), (5, prose(3, 60_000), "fr", "src3"), (6, "nul \0 byte " + prose(4, 60), "en", "src1"), (7, "\n\t  ", "en", "src1"), (8, "é" * 5000, "es", "src4"), (1, prose(1, 80), "en", "src1"), (9, "x" * 300_000, "en", "src1")]
    width = len(CLASHING.split(", "))
    return [(*r, None if i % 2 else 7, *([None] * width if i % 3 else [1, 1] + ["c"] * (width - 2))) for i, r in enumerate(base)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "x"), (1, 1, 0, "x"), (2, 0, 1, None), (None, None, None, None), (5, None, 1, "x"), (6, 1, None, "x")], "doc_id long, quality int, toxic int, text string")


OPERATORS = {
    "suffix_dedup": lambda d, la: suffix_dedup.digests(d),
    "byte_bpe": lambda d, la: byte_bpe.digests(d, PATH),
    "license_scan": lambda d, la: license_scan.scan(d),
    "quality_rules": lambda d, la: quality_rules.judge(d, la),
    "toxicity": lambda d, la: toxicity.scored(d, toxicity.fit(d, la)),
    "pii": lambda d, la: pii.found(d),
    "mixing": lambda d, la: mixing.selected(d),
    "ngram_join": lambda d, la: ngram_join.joined(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(docs, labels, rows, name):
    got = OPERATORS[name](docs, labels).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((r[0] for r in rows), key=str)
    # equal rows have equal results
    once = [tuple(str(v) for v in r) for r in got if r.doc_id == 1]
    assert len(once) == 2 and once[0] == once[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(docs, labels, name):
    assert OPERATORS[name](docs.where("false"), labels).count() == 0
    assert OPERATORS[name](docs.where("false"), labels.where("false")).count() == 0


@pytest.mark.parametrize("stage", ["quality_rules", "ngram_join", "pii", "mixing", "byte_bpe"])
def test_stages(docs, labels, rows, tmp_path, stage):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(docs.sparkSession, docs, str(tmp_path))
    if stage != "byte_bpe":
        assert out.columns == docs.columns and out.schema == docs.schema
    got = sorted((r.doc_id for r in out.collect()), key=str)
    every = sorted((r[0] for r in rows), key=str)
    if stage in ("pii", "byte_bpe"):
        assert got == every
    elif stage == "ngram_join":
        # 2 is a copy of 1, and 1 stands there twice; rows without words all stay
        assert got == sorted([1, 3, 4, None, None, 5, 6, 7, 8, 9], key=str)
    elif stage == "quality_rules":
        assert {3, 4, 7, 8, 9}.isdisjoint(got) and {1, 2, 6}.issubset(got)
    else:
        assert set(got) <= set(every)
    empty = run(docs.sparkSession, docs.where("false"), str(tmp_path))
    assert empty.count() == 0 and (stage == "byte_bpe" or empty.columns == docs.columns)


def test_hot_passage(spark, monkeypatch):
    """A passage in every document, over many runs and fragments, is kept once, at its first place; so is what few share."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 50)
    monkeypatch.setattr(suffix_dedup, "RUN", 40)
    hot, warm = prose(50, 40), prose(51, 30)
    texts = [f"{prose(100 + i, 20)} {hot} {prose(300 + i, 10)}" + (f" {warm}" if i % 9 == 0 else "") for i in range(120)] + [hot, hot + " end", warm * 3]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        want[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, c in zip(b, gone) if not c)).hexdigest())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digests(docs).collect()} == want
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.deduplicated(docs).collect()}
    assert all(hashlib.sha256(kept[i]).hexdigest() == w[3] for i, w in want.items())


def test_tables_need_a_shared_folder():
    from postlens.llm import storage

    class Fake:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(Fake)


def test_toxicity_of_long_and_repeated_texts(spark):
    r = random.Random(2)
    clean = lambda n: " ".join(r.choice("the of and to in a is that was for on with".split()) for _ in range(n))
    rows = [(i, clean(80) + (" you vile fool vile fool" if i % 5 == 0 else "")) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    long = clean(50_000)
    more = spark.createDataFrame([(1, long), (2, long + " you vile fool vile fool"), (2, long + " you vile fool vile fool"), (3, " ".join(["vile fool"] * 20_000))], "doc_id long, text string")
    got = [(x.doc_id, x.score >= 0.7, x.n_passages) for x in toxicity.scored(more, model).orderBy("doc_id").collect()]
    assert got[0] == (1, False, 0) and got[1] == got[2] and got[1][2] == 1 and got[3][1:] == (True, 1)
