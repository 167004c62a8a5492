import random

from pyspark.sql import functions as F

from postlens.operators import matching, paths, shortlist
from postlens.plans import profiles

KIND = "id int, first array<string>, owners array<struct<weight:double,queries:array<string>>>"


def by_loop(first, owners, seats):
    """Greatest quotients one after another."""
    taken = list(dict.fromkeys(first))[:seats]
    at, held = [0] * len(owners), [0] * len(owners)
    while len(taken) < seats:
        open_ = [(w**3 / (held[i] + 1), -i) for i, (w, q) in enumerate(owners) if at[i] < len(q)]
        if not open_:
            break
        i = -max(open_)[1]
        item = owners[i][1][at[i]]
        at[i] += 1
        if item not in taken:
            taken.append(item)
            held[i] += 1
    return taken


def test_slots_of_every_row(spark):
    """Random lists that share queries, equal weights, empty lists, level queries of any number: as the loop gives them."""
    draw = random.Random(5)
    rows = []
    for n in range(200):
        owners = [(draw.choice((0.4, 0.6, 0.95, 1.0)), [draw.choice("abcdefgh") for _ in range(draw.randrange(6))]) for _ in range(draw.randrange(5))]
        rows.append((n, [draw.choice("stuv") for _ in range(draw.randrange(9) if n % 3 == 0 else 0)], owners))
    df = spark.createDataFrame(rows, KIND)
    for seats in (1, 4, 6):
        got = {r.id: r.x for r in df.select("id", shortlist.slots(F.col("first"), F.col("owners"), seats).alias("x")).collect()}
        assert got == {n: by_loop(first, owners, seats) for n, first, owners in rows}
    assert "Exchange" not in df.select(shortlist.slots(F.col("first"), F.col("owners"), 6))._jdf.queryExecution().toString()


def test_slots_of_nothing(spark):
    rows = spark.createDataFrame([(1, None, None), (2, None, [(None, ["a"]), (1.0, None), (0.5, [None, "b", "b"])]), (3, ["x", None, "x"], [])], KIND)
    assert {r.id: r.x for r in rows.select("id", shortlist.slots(F.col("first"), F.col("owners"), 6).alias("x")).collect()} == {1: [], 2: ["b", "a"], 3: ["x"]}


def test_searches_of_profiles(spark):
    """Old families go first, then those of little weight beside what is left; a family named after a level gives its titles before all."""
    titles = {"data": ["data engineer", "analyst"], "cloud": ["devops engineer", "analyst", "sre"], "sales": ["seller"], "technician": ["electrician", "fitter"]}
    rows = [(1, [("data", 1.0, 0.4), ("cloud", 0.8, 0.9), ("sales", 0.3, None)]), (2, [("data", 1.0, 0.4), ("cloud", 0.8, 0.1)]), (3, [("cloud", 1.0, None), ("technician", 0.2, 0.1)]), (4, None), (5, [("unknown", 1.0, None)])]
    df = spark.createDataFrame(rows, "id int, families array<struct<name:string,weight:double,recency:double>>")
    got = {r.id: r.queries for r in profiles.searches(df, titles, ("technician",), 4).collect()}
    assert got == {1: ["devops engineer", "analyst", "sre"], 2: ["data engineer", "devops engineer", "analyst", "sre"], 3: ["electrician", "fitter", "devops engineer", "analyst"], 4: [], 5: []}


def test_threshold_join_makes_few_pairs(spark):
    """The same choice as from all pairs; a word that every path has joins next to none of them."""
    draw = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    q = [(f"q{i}", "c1", sorted({*draw.sample(words, 4), "every"})) for i in range(40)]
    p = [(f"p{i}", draw.choice((None, "c1", "c2")), sorted({*draw.sample(words, draw.randrange(1, 5)), "every", "jobs"})) for i in range(600)]
    p += [(f"x{i}", None, [*tokens, "jobs"]) for i, (_, _, tokens) in enumerate(q[:30])]
    queries, some = spark.createDataFrame(q, "q string, wanted_city string, tokens array<string>"), spark.createDataFrame(p, "p string, city string, tokens array<string>")
    order = lambda df: sorted(map(tuple, df.select("q", "rank", "p", "score").collect()))
    for share in (0.72, 0.95):
        assert order(paths.chosen(paths.scored(queries, some, ("jobs",), share=share), share)) == order(paths.chosen(paths.scored(queries, some, ("jobs",)), share))
    every = matching.overlap(queries, some, "q", "p", ("jobs",)).count()
    assert every == len(q) * len(p)
    near = matching.near_overlap(queries, some, "q", "p", ("jobs",), 0.72)
    best = matching.overlap(queries, some, "q", "p", ("jobs",))
    assert set(map(tuple, shortlist.near_best(best, ["q"], "score", 0.72).drop("best").collect())) == set(map(tuple, shortlist.near_best(near, ["q"], "score", 0.72).drop("best").collect()))
    assert matching.near_candidates(queries, some, "q", "p", ("jobs",), 0.72).count() < every / 10


def test_threshold_join_of_low_scores(spark):
    """A query whose best score is below nothing has no near path; one without any common word gives no row."""
    queries = spark.createDataFrame([("q1", ["a", "b", "c"]), ("q2", ["z"]), ("q3", [])], "q string, tokens array<string>")
    some = spark.createDataFrame([("p1", ["a", *(f"y{i}" for i in range(20))]), ("p2", None)], "p string, tokens array<string>")
    assert [tuple(r) for r in matching.near_overlap(queries, some, "q", "p", (), 0.72).collect()] == [tuple(r) for r in matching.overlap(queries, some, "q", "p").collect()]
    assert matching.near_overlap(queries.limit(0), some, "q", "p", (), 0.72).count() == 0
