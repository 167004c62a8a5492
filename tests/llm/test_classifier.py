"""The quality classifier: held-out accuracy, plain updates in Python, defined cases."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm import quality_classifier as op

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = op.scored(docs, op.fit(docs, labels)).withColumn("held", op.held_out()).where("held").join(labels, "doc_id").collect()
    good, bad = [[r.score for r in got if r.quality == q] for q in (1, 0)]
    auc = sum((a > b) + (a == b) / 2 for a in good for b in bad) / len(good) / len(bad)
    assert auc > 0.97 and sum((r.score >= 0.5) == r.quality for r in got) / len(got) > 0.95


def plain(texts, epochs):
    """The updates in dictionaries and loops; texts are (features, label) in order."""
    z, n = {}, {}
    weigh = lambda i: 0.0 if abs(z.get(i, 0.0)) <= op.L1 else (math.copysign(op.L1, z[i]) - z[i]) / ((op.BETA + math.sqrt(n[i])) / op.ALPHA + op.L2)
    for _ in range(epochs):
        for found, y in texts:
            w = {i: weigh(i) for i in found}
            p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in found.items())))
            for i, x in found.items():
                g = (p - y) * x
                step = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / op.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - step * w[i], n.get(i, 0.0) + g * g
    return {i: weigh(i) for i in z}


def test_against_plain_updates(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["ab", "CD", "ef!", "gh", "***"]) for _ in range(r.randint(0, 30)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int("***" not in t)) for i, t in rows] + [(5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    order = op.sample(docs, labels).orderBy("h", "y").collect()
    found = [(dict(zip(*(x.tolist() for x in op.features(t.text, op._Hashes())), strict=True)), t.y) for t in order]
    # sample features travel as 32-bit values
    found = [({i: float(np.float32(x)) for i, x in f.items()}, y) for f, y in found]
    model, want = op.fit(docs, labels), plain(found, op.EPOCHS)
    assert all(abs(model[i] - w) < 1e-4 for i, w in want.items()) and set(np.flatnonzero(model)) <= set(want)


def test_features():
    at = lambda t: dict(zip(*(x.tolist() for x in op.features(t, op._Hashes())), strict=True))
    one = at("Word")
    assert set(at("word")) == set(one) and len(one) == 2 and one[0] == 1.0
    assert len(at("")) == 1 and len(at(" \n")) == 1
    loud, again = at("WORD"), at("word word")
    assert set(one) < set(loud) and len(loud) == 3 and len(again) == 4
    # all but the bias have length 1 together
    assert all(math.isclose(sum(x * x for i, x in at(t).items() if i), 1.0) for t in ("a b c", "A_b!! c c c", "ü ß"))


def test_defined_cases(spark):
    schema = "doc_id long, text string, score int, h int, places int"
    docs = spark.createDataFrame([(1, "good words here", 1, 1, 1), (1, "good words here", 1, 1, 1), (2, None, None, None, None), (3, "", 1, 1, 1), (None, "x" * 200_000, 1, 1, 1), (4, "bad *** " * 50_000, 1, 1, 1)], schema)
    labels = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (2, 0, None), (4, 0, "b"), (None, None, None), (3, None, "c")], "doc_id long, quality int, text string")
    model = op.fit(docs, labels)
    got = sorted(((r.doc_id, r.score) for r in op.scored(docs, model).collect()), key=str)
    by = dict(got)
    assert len(got) == 6 and got[0] == got[1] and by[2] == by[3] and all(0 <= s <= 1 for _, s in got)
    for d, la in ((docs.where("false"), labels), (docs, labels.where("false")), (docs.where("false"), labels.where("false"))):
        empty = op.fit(d, la)
        assert not empty.any()
        assert all(r.score == 0.5 for r in op.scored(docs, empty).select(F.col("score")).collect())
    assert op.scored(docs.where("false"), model).count() == 0
