"""Faults that a review found on larger tables."""

import time

import numpy as np
from pyspark.sql import functions as F

from postlens.functions import text as tx
from postlens.operators import automaton, cv, embedding, score, shortlist
from postlens.plans import ranking, standin


def test_many_entities_in_one_text_are_found_in_one_search(spark):
    escaped = "&lt;b&#62;x&#x41;&#1114112;" * 20_000
    start = time.monotonic()
    (row,) = spark.createDataFrame([(escaped,)], "t string").select(tx.entities_resolved(F.col("t")).alias("t")).collect()
    assert row["t"] == "<b>xA&#1114112;" * 20_000
    assert time.monotonic() - start < 20  # one search for each entity took minutes


def test_a_half_that_a_product_misses_by_its_last_bit_is_rounded_up(spark):
    rows = spark.createDataFrame([(36.0, 0.5, 1.0), (84.0, 0.5, 1.0), (37.0, 0.0, 0.0), (44.0, 0.5, None)], "total double, risk double, fit double")
    got = rows.select(score.tenths(score.unrounded(F.col("total"), F.col("risk"), F.col("fit"))).alias("x")).collect()
    assert [r.x for r in got] == [26.6, 62.0, 37.0, 27.5]


def test_the_model_of_the_fit_has_every_token(spark):
    """More tokens than a broadcast model may have, and a text of the rarest ones."""
    n = embedding.MOST // 10 + 1
    docs = spark.range(2 * n).select(F.col("id").alias("seq"), F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") % n * 10 + i).cast("string")) for i in range(10)]).alias("text"))
    model = embedding.learnt(docs, "seq", "text")
    assert model.count() == 10 * n > embedding.MOST
    texts = spark.createDataFrame([("a", f"w{10 * n - 1} w9"), ("b", f"W{10 * n - 2}, w8"), ("c", "unknown"), ("d", "w1")], "hash string, text string")
    got = {r.hash: r.vector for r in embedding.vectors(texts, model).collect()}
    assert np.allclose(got["a"], got["b"]) and abs(np.linalg.norm(got["a"]) - 1) < 1e-9 and not any(got["c"])
    one = embedding.loader(model.where("token IN ('w1', 'w9') OR token = 'w%d'" % (10 * n - 1)))()
    assert np.allclose(one(f"w{10 * n - 1} w9"), got["a"]) and np.allclose(one("w1"), got["d"])


def test_rows_that_multiply_are_dealt_to_more_tasks_as_there_are_more(spark):
    rows = spark.range(0, 10_000, 1, 1)
    for n, fan in ((10_000, 1), (10_000, 25), (100, 25), (0, 25)):
        dealt = shortlist.spread(rows.where(F.col("id") < n), fan, 5000)
        sizes = [len(x) for x in dealt.rdd.glom().collect()]
        assert sum(sizes) == n and max(sizes) * fan <= 5000 + fan


def test_cvs_of_one_file_are_dealt_to_tasks_before_their_lines_are_made(spark):
    text = "Experience\nEngineer    Jan 2009 – Present\nno period here\nIntern    June - July 2004\nTrainee Summer 2001"
    docs = spark.range(0, 64, 1, 1).select("id", F.lit(text).alias("text"))
    lines = cv.lines(docs, "id", "text", F.to_date(F.lit("2012-01-01")))
    assert lines.select("id", F.spark_partition_id().alias("p")).distinct().select("p").distinct().count() > 1
    got = [(r.line_no, r.start, r.end) for r in lines.where("id = 7").orderBy("line_no").collect()]
    assert got == [(0, None, None), (1, 2009.0, 2012.0), (2, None, None), (3, 2004 + 5 / 12, 2004 + 7 / 12), (4, 2001 + 5 / 12, 2001 + 7 / 12)]


def test_texts_meet_the_dictionary_once_and_only_those_that_the_fold_leaves(spark):
    docs = spark.range(0, 400).select(F.col("id").alias("doc_id"), F.lit("Java, SQL and Docker").alias("text"), F.lit("acme").alias("source"))
    rows = ranking.facts(ranking.variants_folded(standin.postings(docs)), F.to_timestamp(F.lit(standin.AS_OF)))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(rows).count("ArrowEvalPython") == 1  # one worker of a task for all texts of a row
    # explode's own filter was tried on all postings, below the join with the fold's winners, and the texts were walked again above it
    told = plan(ranking.rarity(rows))
    assert told.count("ArrowEvalPython") == 1 and told.index("ArrowEvalPython") < told.index("winner")
    (row,) = ranking.rarity(rows).collect()
    assert {"Java", "SQL", "Docker"} <= set(row.idf)


def test_batches_of_texts_are_bounded_by_bytes_unless_the_session_says_otherwise(spark):
    docs = spark.createDataFrame([(1, "Java and C++", "c++"), (2, None, "sql"), (3, "", None)], "id int, a string, b string")
    terms, key = [("Java", "java", False), ("C++", "c++", False), ("SQL", "sql", False)], "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        found = automaton.with_matched(docs, {"x": F.col("a"), "y": F.col("b")}, terms)
        assert found.columns == ["id", "a", "b", "x", "y"] and spark.conf.get(key) == str(automaton.BATCH_BYTES)
        assert [(r.x, r.y) for r in found.orderBy("id").collect()] == [(["C++", "Java"], ["C++"]), ([], ["SQL"]), ([], [])]
        spark.conf.set(key, "1m")
        automaton.with_matched(docs, {"x": F.col("a")}, terms)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
