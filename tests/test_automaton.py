import random

from pyspark.sql import functions as F

from postlens import catalog
from postlens.operators import automaton, matching

TERMS = [("C++", "c++", False), ("C#", "c#", False), ("Go", "Go", True), ("R", "R", True), ("R&D", "r&d", False), ("AWS", "aws", False), ("AWS", "amazon web services", False), ("Python", "python", False), ("Manage", "management", False), ("Accounts", "muhasebe", False),
         ("Four", "natural language processing toolkit", False), ("Five", "one two three four five", True), ("İşe", "işe alım", False), ("Node", "node.js", False), ("Learn", "machine learning", False), ("Learning", "learning", False), ("Sigma", "σίσυφος", False), ("Short", "a b", False), ("Plus", "++", False), ("Under", "snake_case", False), ("Empty", "", False), ("Blank", "  \t", False), ("Accent", "café", False)]


def same(spark, texts, terms):
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    table = spark.createDataFrame(terms, "canonical string, term string, case_sensitive boolean")
    real = [t for t in terms if t[1].strip()]
    exact = {(r.id, r.canonical) for r in matching.pattern_matches(docs, ["id"], "text", real).collect()}
    rows = automaton.token_matches(docs, ["id"], "text", table).collect()
    assert len(rows) == len({tuple(r) for r in rows}) and {tuple(r) for r in rows} == exact
    assert {(r.id, x) for r in docs.select("id", automaton.matched(F.col("text"), terms).alias("m")).collect() for x in r.m} == exact
    return exact


def test_inflected_and_long_terms(spark):
    texts = ["Managements of machine learnings", "managementsystems", "managementsystem x", "Natural  Language\nProcessing Toolkits", "one two three\u00a0four five", "one two three four fives", "one two three four", "Go, go GO", "pythonic python3 _python python-", "c++ c+++ c# C#7 r&d R&D2", "İŞE ALIMI ve ışe alım", "node.js nodexjs node.jsx", "ΣΊΣΥΦΟΣ", "a b abc a  b++", "snake_cases xsnake_case", "café CAFÉ", None, "", "+ ++ +++", "R. R R2 RR +R"]
    found = same(spark, texts, TERMS)
    assert {(0, "Manage"), (0, "Learn"), (0, "Learning"), (3, "Four"), (4, "Five"), (5, "Five")} <= found
    assert (1, "Manage") not in found and (2, "Manage") in found and (6, "Five") not in found


def test_random_texts(spark):
    r = random.Random(4)
    pieces = ["c", "++", "+", "#", "&", "go", "Go", "r", "R", "d", "aws", "amazon", "web", "services", "python", "PYTHON", "management", "s", "ing", "ings", "abcdefg", " ", "  ", "\n", " ", " ", "_", "-", "1", "é", "é", "İ", "ı", "ş", "a", "b", "learning", "machine", "ſ", "‍", "½", "²", "σ", "ς", "."]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 25))) for _ in range(1500)]
    assert len(same(spark, texts, [*TERMS, ("Services", "services", False), ("Is", "is", False), ("S", "s", False)])) > 500


def test_catalogue_terms(spark):
    r = random.Random(5)
    known = [(name, term, cs) for _, name, some, cs in catalog.SKILLS for term in some]
    texts = [" ".join(r.choice([lambda t: t, str.upper, lambda t: t + "s", lambda t: t + "ler", lambda t: "x" + t, lambda t: t.replace(" ", "\t")])(r.choice(known)[1]) for _ in range(12)) for _ in range(200)]
    assert len(same(spark, texts, known)) > 1000


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(automaton, "MAX_TERMS", 4)
    docs = spark.createDataFrame([(1, "python and c++ and machine learning, snake_case")], "id int, text string")
    table = spark.createDataFrame(TERMS, "canonical string, term string, case_sensitive boolean")
    assert sorted(x.canonical for x in automaton.token_matches(docs, ["id"], "text", table).collect()) == ["C++", "Learn", "Learning", "Python", "Under"]
    assert automaton.token_matches(docs, ["id"], "text", table.where("false")).count() == 0 and automaton.token_matches(docs.where("false"), ["id"], "text", table).count() == 0
