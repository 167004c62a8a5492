from pyspark.sql import functions as F

from postlens import catalog
from postlens.functions import text as tx
from postlens.operators import dedup, geo, intervals, matching, score, shortlist


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_text(spark):
    assert one(spark, tx.title_key(F.lit("acme"), F.lit("Senior Dev (Remote) [m/f]"))) == "acme|senior dev"
    assert one(spark, tx.mojibake_repaired(F.lit("TÃ¼rkiye"))) == "Türkiye" and one(spark, tx.mojibake_repaired(F.lit("Türkiye"))) == "Türkiye"
    assert one(spark, tx.nfc(F.lit("u\u0308"))) == "ü" and one(spark, tx.relative_days(F.lit("2 hafta"))) == 14
    assert one(spark, tx.slug(F.lit("Çağrı Merkezi!"))) == "cagri+merkezi"
    assert one(spark, tx.spaced_heading(F.lit("S K I L L S"))) == "SKILLS"
    assert one(spark, tx.html_text(F.lit("<ul><li>a</li><li>b</li></ul><script>x</script>"))) == "- a\n- b"


def test_fold_is_not_an_argmax(spark):
    rows = spark.createDataFrame([("k", 1, 100, 5, 1), ("k", 2, 110, 9, 1), ("k", 3, 125, 1, 1)], "k string, seq long, len int, fresh int, places int")
    got = dedup.fold(rows, ["k"], "seq", "len", "fresh", "places").first()
    assert (got.winner, got.rank, got.size) == (2, 1, 3)


def test_location_decision(spark):
    places = catalog.places(spark)
    rows = spark.createDataFrame([(1, ["Remote - Germany"], True), (2, ["Tel Aviv-Yafo"], False), (3, ["Mars"], True), (4, ["United States & Canada"], False)], "id int, locations array<string>, remote boolean")
    found = rows.join(geo.countries(rows, "id", "locations", places), "id", "left")
    permits = F.array(F.lit("israel"), F.lit("canada"))
    out = {r.id: (r.d.ok, r.d.status) for r in found.select("id", geo.decision(F.col("locations"), F.lit(""), F.lit(""), F.col("remote"), F.col("countries"), permits).alias("d")).collect()}
    assert [out[i][0] for i in (1, 2, 3, 4)] == [False, True, False, True] and "Germany" in out[1][1]


def test_years_and_seniority(spark):
    years = lambda s: one(spark, score.required_years(F.lit(s)))
    assert years("You must have at least 5 years of experience") == 5 and years("We have 15 years of experience in logistics") is None
    level = lambda t: one(spark, score.seniority(F.lit(t), F.lit("")))
    assert [level(t) for t in ("Senior Dev", "Junior/Mid Dev", "Dev", "Head of Data")] == ["senior", "junior", "mid", "staff"]


def test_exact_terms_and_tokens_agree(spark):
    docs = spark.createDataFrame([(1, "We use C++ and Go, not Python"), (2, "go there with spark"), (3, "")], "id int, text string")
    tokens = {(r.id, r.canonical) for r in matching.token_matches(docs, ["id"], "text", catalog.skills(spark)).collect()}
    exact = {(r.id, r.canonical) for r in matching.pattern_matches(docs, ["id"], "text", [(n, t, cs) for _, n, ts, cs in catalog.SKILLS for t in ts]).collect()}
    assert tokens == exact == {(1, "C++"), (1, "Go"), (1, "Python"), (2, "Spark")}
    known = [(n, t, cs) for _, n, ts, cs in catalog.SKILLS for t in ts]
    assert {(r.id, x) for r in docs.select("id", matching.matched(F.col("text"), known).alias("m")).collect() for x in r.m} == tokens
    assert one(spark, matching.matched(F.lit("We run Node.js and PL/SQL, with CI/CD"), known)) == ["CI/CD", "Node.js", "Oracle", "SQL"]


def test_interval_union_and_dhondt(spark):
    rows = spark.createDataFrame([("a", 0, 10), ("a", 5, 12), ("a", 20, 25)], "k string, s int, e int")
    assert tuple(intervals.union_length(rows, ["k"], "s", "e").first())[1:] == (17, 2)
    seats = shortlist.dhondt(spark.createDataFrame([("x", 0, 3.0), ("y", 1, 2.0)], "f string, o int, w double"), "f", "w", "o", 6)
    assert {r.f: r.seats for r in seats.collect()} == {"x": 5, "y": 1}


def test_fold_is_brute_force(spark):
    """Groups of all sizes, also such that go over several batches, against the rule applied row by row."""
    import random

    r = random.Random(4)
    rows = [(r.choice("abcdefgh") if i % 3 else "big", i, r.choice((10, 11, 13, 20, 40)), r.randint(0, 3), r.randint(0, 2)) for i in range(3000)] + [(None, 9000, 5, 1, 1), ("once", 9001, 5, 1, 1)]
    want = {}
    for k, *row in rows:
        held = want.get(k)
        if held is None:
            want[k] = [row, row[0], 1]
            continue
        (_, a, f, p), (_, b, g, q) = held[0], row
        if b > 1.2 * a or (a <= 1.2 * b and (g, q) > (f, p)):
            held[0] = row
        held[2] += 1
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        r.shuffle(rows)
        got = dedup.fold(spark.createDataFrame(rows, "k string, seq long, len int, fresh int, places int"), ["k"], "seq", "len", "fresh", "places").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {x.k: (x.winner, x.rank, x.size) for x in got} == {k: (v[0][0], v[1], v[2]) for k, v in want.items()}
    assert dedup.fold(spark.createDataFrame([], "k string, seq long, len int, fresh int, places int"), ["k"], "seq", "len", "fresh", "places").count() == 0


def test_query_slots():
    owners = [("data", 1.0, False, ["a", "b", "c", "d"]), ("senior", 0.2, True, ["s", "t"]), ("cloud", 0.9, False, ["a", "x", "y"])]
    assert shortlist.query_slots(owners, 6) == ["s", "a", "x", "b", "y", "c"]
    assert shortlist.query_slots(owners[:1], 9) == ["a", "b", "c", "d"] and shortlist.query_slots([], 6) == []


def test_rolling_count_looks_back_over_buckets(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate((0, 5, 9, 10, 11, 19, 20, 21, 35))], "i int, s long").withColumn("at", F.timestamp_seconds("s")).withColumn("k", F.lit("x"))
    got = {r.s: r.used for r in intervals.rolling_count(rows, ["k"], "at", 10, "used").collect()}
    assert got == {s: sum(s - 10 <= t <= s for t in got) for s in got}
