import random

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    prose = lambda: " ".join(r.choice(words) for _ in range(90))
    first = prose()
    texts = [first, first + " tail", "too short", None, prose() + " card 4111111111111111", *[prose() for _ in range(40)]]
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, m string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(45)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {x.doc_id: x for x in docs.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert set(kept["quality_rules"]) == {i for i in range(45) if i not in (2, 3)}
    assert set(kept["ngram_join"]) == set(kept["quality_rules"]) - {1} and set(kept["pii"]) == set(kept["ngram_join"])
    assert "4111111111111111" not in kept["pii"][4].text and kept["pii"][0].text == first
    assert 0 < len(kept["mixing"]) < len(kept["pii"]) and set(kept["byte_bpe"]) == set(kept["mixing"])
    assert all(x.n_tokens > 0 for x in kept["byte_bpe"].values())


def test_run_is_brute_force(spark, tmp_path):
    """All stages at once against a plain version: base rules, every pair of sets, the order of points, direct encoding."""
    import hashlib
    import re

    import public_tokenizers
    from pyspark.sql import functions as F

    from postlens.llm import byte_bpe, mixing, pii

    r = random.Random(14)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    texts = []
    for i in range(160):
        w = [r.choice(words) for _ in range(r.choice((30, 60, 90, 150)))]
        texts.append(" ".join(w))
        if i % 8 == 0:
            for _ in range(2):
                near = list(w)
                near[r.randrange(len(near))] = "other"
                texts.append(" ".join(near))
        if i % 20 == 0:
            texts += [" ".join(w), "again and again and " * 30, f"{' '.join(w[:50])} born 1990-02-28 and {' '.join(r.choice(words) for _ in range(60))}"]
    r.shuffle(texts)
    rows = [(i, t, r.choice(("en", "de")), f"src{r.randrange(6)}", len(t)) for i, t in enumerate(texts)]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    def passes(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        again = {k + x for k, g in enumerate(grams) if grams.count(g) > 1 for x in range(3)}
        return len(w) >= 50 and 100 * len(again) <= 50 * len(w)

    # so few labels prove no cutoff
    left = [x for x in rows if passes(x[1])]
    sets = {x[0]: frozenset(tuple(x[1].lower().split()[k : k + 5]) for k in range(len(x[1].split()) - 4)) for x in left}
    part = {i: i for i in sets}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                part[max(a, b)] = min(a, b)
    left = [x for x in left if root(x[0]) == x[0]]
    assert len(left) < len(sets)
    clean = pii.pseudonymised(spark.createDataFrame(left, shape))
    dates = {x.doc_id for x in clean.collect() if x.text != rows[x.doc_id][1]}
    assert dates == {x[0] for x in left if "1990-02-28" in x[1]}
    counts = clean.select("doc_id", "text", mixing.domain_of(F.col("source")).alias("domain"), "lang", "source", F.size(F.split("text", " ")).cast("long").alias("tokens"), mixing._text_key().alias("key"))
    plan = mixing.planned(counts, corpus_pipeline.BUDGET_SHARE, mixing.WEIGHTS, corpus_pipeline.MAX_EPOCHS)
    points = counts.join(plan, list(mixing.LEAF)).withColumn("point", mixing._point(11, F.col("epochs"), F.col("doc_id"), F.col("key"))).collect()
    made, want = byte_bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken")).encoding, {}
    for leaf in {tuple(x[c] for c in mixing.LEAF) for x in points}:
        run = 0
        for x in sorted((x for x in points if tuple(x[c] for c in mixing.LEAF) == leaf), key=lambda x: x.point):
            run += x.tokens
            if x.epochs or (x.rest and run <= x.rest):
                ids = made.encode_ordinary(x.text)
                want[x.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(x.text.encode()).hexdigest())
    assert got == want and 0 < len(want) < len(left)
