import json
import os

import pytest

from postlens.sources import fetch


def pages_there(token):
    return len(os.listdir(token))


def page_of(token, at):
    with open(f"{token}/{at}") as f:
        return f.read(), pages_there(token)


def page_at_offset(token, offset):
    return page_of(token, offset // 100)


def polled(spark, tokens, at, fail=False, **more):
    """One run of the stream until nothing is left; each batch replaces its own rows."""
    spark.dataSource.register(fetch.FeedSource)
    given = {"plan": json.dumps([(str(t), t.name) for t in tokens]), "fetcher": "tests.test_feed_stream.page_of", "counter": "tests.test_feed_stream.pages_there", "pages": "2"} | more
    stream = spark.readStream.format("feed").options(**given).load()

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")
        if fail:
            raise RuntimeError("lost in between")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sorted((r.company, r.page, r.payload) for r in spark.read.parquet(f"{at}/out").collect())


def added(folder, *names):
    folder.mkdir(exist_ok=True)
    for n in names:
        (folder / str(n)).write_text(f"{folder.name}{n}")


def want(**counts):
    return sorted((c, n, f"{c}{n}") for c, most in counts.items() for n in range(most))


def test_polling_resumes(spark, tmp_path):
    """A stream that is started again, also after a failure in a batch and with a token more, neither repeats nor loses a page."""
    a, b, c = tmp_path / "a", tmp_path / "b", tmp_path / "c"
    added(a, *range(5))
    added(b, 0)
    at = str(tmp_path / "run")
    assert polled(spark, [a, b], at) == want(a=5, b=1)
    assert polled(spark, [a, b], at) == want(a=5, b=1)
    added(a, 5)
    added(b, 1, 2)
    with pytest.raises(Exception, match="lost in between"):
        polled(spark, [a, b], at, fail=True)
    added(b, 3)
    added(c, 0, 1, 2)
    # availableNow is one batch for this source: the run after a failure does the lost batch, with the pages it had, and the next run goes on
    assert polled(spark, [a, b, c], at) == want(a=6, b=3)
    assert polled(spark, [a, b, c], at) == want(a=6, b=4, c=3)


def test_parts_of_a_backlog_and_offsets(spark, tmp_path):
    a = tmp_path / "a"
    added(a, *range(5))
    reader = fetch.FeedStreamReader({"plan": json.dumps([("a", "A"), ("z", "Z")]), "fetcher": "x.y", "counter": "x.y", "pages": "2"})
    assert [p.value for p in reader.partitions({"a": 1}, {"a": 6, "z": 0})] == [("a", "A", 1, 3), ("a", "A", 3, 5), ("a", "A", 5, 6)]
    assert reader.partitions({"a": 6}, {"a": 4}) == [] and reader.initialOffset() == {"a": 0, "z": 0}
    assert polled(spark, [a], str(tmp_path / "run"), paging="offset", fullpage="100", fetcher="tests.test_feed_stream.page_at_offset") == want(a=5)
    with pytest.raises(ValueError, match="polled"):
        fetch.FeedStreamReader({"plan": "[]", "fetcher": "x.y", "counter": "x.y", "paging": "cursor"})
