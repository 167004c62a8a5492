from pyspark.sql import functions as F

from postlens import panel
from postlens.plans import profiles, standin

CV = """Jane Doe
Data Engineer
Experience
Data Engineer, Acme  Jan 2018 - Present
- Spark, Kafka and SQL, spoken German
Skills
Python, Airflow"""


def test_panel_from_cv_to_report(spark, tmp_path):
    docs = spark.createDataFrame([(1, CV), (1, CV), (2, ""), (3, None)], "id int, text string")
    p = panel.Panel(spark, str(tmp_path))
    rows = {r.profile_id: r for r in p.import_cvs(docs, "id", "text", "2024-01-01", ["germany", "turkey", "canada", "usa", "israel"]).collect()}
    assert set(rows) == {"1", "2", "3"} and rows["1"].families[0].name == "data" and rows["1"].max_level == "staff" and "german" in rows["1"].languages and rows["1"].max_years == 8
    assert rows["2"].families == [] and rows["3"].weights == {}
    assert p.stale() == [] and {s["profile_id"] for s in p.summaries()} == {"1", "2", "3"}
    p.edit("1", families=["data"], permits=["germany", "turkey", "usa", "canada", "israel", "remote_emea"])
    assert "remote_emea" in p.profiles().where("profile_id = '1'").first().permits
    texts = spark.createDataFrame([(i, "text " * 100, "en", f"firm{i % 7}", 500) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    told = []
    header = p.scan(standin.postings(texts), "2024-06-01 00:00:00", lambda stage, n: told.append((stage, n)))
    assert [s for s, _ in told] == ["scored", "ranked", "idle"] and header["pairs"] == told[0][1] and p.status["stage"] == "idle"
    mine = p.results("1").orderBy("rank").collect()
    assert mine and [r["rank"] for r in mine] == list(range(1, len(mine) + 1)) and p.report("1").startswith("# Shortlist of 1") and p.report("nobody") is None
    assert panel.health()["ok"] and {"tag": "germany", "name": "Germany", "region": "emea"} in panel.countries()


def test_search_queries():
    profile = {"families": [{"name": "data", "weight": 1.0, "recency": 0.4}, {"name": "cloud", "weight": 0.8, "recency": 0.9}, {"name": "sales", "weight": 0.3}]}
    titles = {"data": ["data engineer", "analyst"], "cloud": ["devops engineer", "analyst", "sre"], "sales": ["seller"]}
    assert profiles.search_queries(profile, titles) == ["devops engineer", "analyst", "sre"]
    profile["families"][1]["recency"] = 0.1
    assert profiles.search_queries(profile, titles, 3) == ["data engineer", "devops engineer", "analyst"]
