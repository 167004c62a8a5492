import hashlib

import numpy as np
from pyspark.sql import functions as F

from postlens.operators import embedding, fit
from postlens.plans import ranking


def corpus(spark):
    rows = [(i, ["nurse ward patient", "nurse patient care", "ward care clinic"][i % 3] if i % 2 else ["spark kafka pipeline", "kafka stream pipeline", "spark stream data"][i % 3]) for i in range(60)]
    return spark.createDataFrame([*rows, (100, None), (101, "")], "seq long, text string")


def test_learnt_vectors(spark):
    """Words of the same texts are near each other; the sums are those of a plain loop."""
    docs = corpus(spark)
    rows = {r.token: r for r in embedding.learnt(docs, "seq", "text").collect()}
    texts = docs.collect()
    signs = {t.seq: [2 * int(b) - 1 for b in f"{int(hashlib.md5(str(t.seq).encode()).hexdigest()[:16], 16):064b}"] for t in texts}
    for token, r in rows.items():
        mine = [signs[t.seq] for t in texts if t.text and token in t.text.split()]
        assert r.sums == [sum(x) for x in zip(*mine)] and abs(r.weight - np.log(1 + len(texts) / len(mine))) < 1e-12
    one = embedding.loader(embedding.learnt(docs, "seq", "text"))()
    near = lambda a, b: float(one(a) @ one(b))
    assert near("nurse", "patient") > 0.4 > near("nurse", "kafka") and abs(np.linalg.norm(one("Nurse, WARD")) - 1) < 1e-9
    assert not one("unknown words").any() and not one("").any()
    assert embedding.learnt(docs, "seq", "text", most=3).count() == 3 and embedding.learnt(docs.where("false"), "seq", "text").count() == 0


def kept_rows(spark):
    rows = [("p", i, f"title {i}", f"text {i // 2} spark", ["data"], {"Spark": 1.0}) for i in range(6)] + [("q", 2, "title 2", "text 1 spark", ["health"], {"Care": 1.0})]
    return spark.createDataFrame(rows, "profile_id string, seq long, title string, description string, families array<string>, weights map<string,double>")


def sentences():
    return F.concat(F.lit("own "), F.col("profile_id")), fit.other_sentence(F.col("families"))


def test_the_cap_comes_before_the_model(spark):
    """Texts beyond the cap never reach the model, and what the cache has isn't scored again."""

    def refuses(words):
        def load():
            one = fit.token_vectors()

            def told(text):
                assert not any(w in text for w in words), text
                return one(text)

            return told

        return fit.text_to_vector(load, np.float64)

    own, other = sentences()
    told, found = embedding.fits(kept_rows(spark), refuses(["title 3", "title 4", "title 5"]), own, other, cap=3)
    got = {(r.profile_id, r.seq): r.fit for r in told.collect()}
    assert set(got) == {("p", 0), ("p", 1), ("p", 2), ("q", 2)}
    # an own and an other sentence each, three titles and three texts with titles
    assert found.count() == 4 + 6
    cache = spark.createDataFrame(found.collect(), found.schema)
    again, more = embedding.fits(kept_rows(spark), refuses(["own", "title 0", "title 1", "title 2", "title 4"]), own, other, cap=4, cache=cache)
    new = {(r.profile_id, r.seq): r.fit for r in again.collect()}
    assert {k: new[k] for k in got} == got and ("p", 3) in new
    assert embedding.next_cache(more, cache).count() == cache.count() + 2
    plan = told._jdf.queryExecution().executedPlan().toString()
    # the limit of rows by profile lies below the model in the plan
    assert "row_number" in plan[plan.index("ArrowEvalPython") :]


def test_fit_moves_the_final_score(spark, tmp_path):
    rows = kept_rows(spark).select("*", F.lit("kept").alias("verdict"), F.lit(50.0).alias("total"), F.lit(0.2).alias("risk"), F.transform("families", lambda f: F.struct(f.alias("name"), F.lit(1.0).alias("weight"))).alias("fam"))
    rows = rows.drop("families").withColumnRenamed("fam", "families")
    out = ranking.with_fit(rows, rows.select("seq", "title", "description"), str(tmp_path), cap=4).collect()
    assert len(out) == 7 and sum(r.fit is None for r in out) == 2
    for r in out:
        scale = 1.0 if r.fit is None else min(1.18, max(0.82, 1 + 4.5 * r.fit))
        assert abs(r.final - 50 * 0.85 * scale) <= 0.05 + 1e-9
