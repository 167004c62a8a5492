from pyspark.sql import functions as F

from postlens import catalog
from postlens.functions.text import token_set
from postlens.operators import paths
from postlens.sources import cv_files


def test_paths(spark):
    q = spark.createDataFrame([("data engineer", "izmir")], "q string, wanted_city string").withColumn("tokens", token_set(F.col("q")))
    p = spark.createDataFrame([("data engineer jobs", None), ("izmir data engineer jobs", "izmir"), ("nurse jobs", None)], "p string, city string").withColumn("tokens", token_set(F.col("p")))
    got = paths.chosen(paths.scored(q, p, ("jobs",)), 0.5).orderBy("rank").collect()
    assert [r.p for r in got] == ["data engineer jobs", "izmir data engineer jobs"]
    share = paths.coverage(spark.createDataFrame([("Data Engineer", 3.0), ("Beekeeper", 1.0)], "name string, weight double"), [p for _, _, patterns, *_ in catalog.FAMILIES for p in patterns]).first()
    assert (share.simple, share.weighted) == (0.5, 0.75)


def test_cv_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "b.tex").write_text("\\documentclass{x}\\begin{document}\\textbf{Jane} % note\n\\item Spark\\end{document}")
    got = {r.path[-5:]: r.text for r in cv_files.read(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == "plain" and got["b.tex"].split() == ["Jane", "Spark"]
