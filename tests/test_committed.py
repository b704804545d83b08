"""Record files with a commit, and the paged feed as a stream over restarts."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noticeflow.sources import feeds, record_files


def names(root):
    return sorted(p.relative_to(root).as_posix() for p in root.rglob("*") if p.is_file())


def test_all_files_or_none(spark, tmp_path):
    spark.dataSource.register(record_files.RecordFiles)
    root = tmp_path / "root"
    root.mkdir()
    rows = [(f"2026-01-0{i % 3 + 1}/站/t{i}.json", f'{{"i": {i}}}') for i in range(40)]
    df = spark.createDataFrame(rows, "path string, content string").repartition(5)
    save = lambda df, **o: df.write.format("record_files").options(path=root.as_uri(), **o).mode("append").save()
    # a task that fails leaves nothing, whatever the others have written
    late = df.withColumn("content", F.when(F.col("path").contains("t17"), F.raise_error(F.lit("no"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no"):
        save(late)
    assert names(root) == []
    save(df)
    assert names(root) == sorted(p for p, _ in rows) and (root / rows[5][0]).read_text() == rows[5][1]
    # names that an earlier run has taken: nothing is written, not even the new ones
    again = spark.createDataFrame([(rows[0][0], "other"), ("2026-01-09/站/new.json", "x")], df.schema)
    with pytest.raises(Exception, match="there already"):
        save(again)
    assert names(root) == sorted(p for p, _ in rows) and (root / rows[0][0]).read_text() == rows[0][1]
    save(again, existing="replace")
    assert (root / rows[0][0]).read_text() == "other" and len(names(root)) == 41
    with pytest.raises(Exception, match="below the root"):
        save(spark.createDataFrame([("../x.json", "y")], df.schema))
    save(df.limit(0))
    assert len(names(root)) == 41 and names(tmp_path) == [f"root/{n}" for n in names(root)]


def test_attempts_that_do_not_count(tmp_path):
    """Of two attempts of a task only the one whose message comes is moved."""
    writer = record_files.StreamWriter({"path": tmp_path.as_uri()})
    batch = lambda text: iter([pa.RecordBatch.from_pydict({"path": ["d/a.json"], "content": [text]})])
    writer.write(batch("lost"))
    message = writer.write(batch("kept"))
    writer.commit([message, None], 0)
    assert names(tmp_path) == ["d/a.json"] and (tmp_path / "d/a.json").read_text() == "kept"
    writer.commit([writer.write(batch("kept"))], 0)  # the same batch once more
    writer.abort([writer.write(batch("gone"))], 1)
    assert names(tmp_path) == ["d/a.json"] and (tmp_path / "d/a.json").read_text() == "kept"


@pytest.fixture
def feed():
    asked, most = [], {"n": 3}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
            n = int(q.get("next", 0))
            asked.append((q["q"], n))
            self.send_response(500 if q["q"] == "bad" else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"n": n, "page": {"next": str(n + 1) if n < most["n"] else None}}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/feed", asked
    server.shutdown()


def test_feed_resumes_from_its_checkpoint(spark, tmp_path, feed):
    url, asked = feed
    spark.dataSource.register(feeds.PagedFeed)
    got = []

    def run(until):
        stream = spark.readStream.format("paged_feed").options(url=url, queries='[{"q":"a"},{"q":"bad"},{"q":"b"}]', next_field="page.next").load()
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, _: got.extend((r.query, r.page, json.loads(r.body)["n"]) for r in df.collect())).trigger(processingTime="0 seconds").start()
        try:
            for _ in range(300):
                if len(got) >= until or query.exception():
                    break
                threading.Event().wait(0.1)
            query.processAllAvailable()
        finally:
            query.stop()

    run(5)
    run(9)
    assert sorted(got) == sorted([(0, i, i) for i in range(4)] + [(1, 0, 0)] + [(2, i, i) for i in range(4)])
    assert sorted(asked) == sorted([("a", i) for i in range(4)] + [("bad", 0)] + [("b", i) for i in range(4)])  # each page once


def test_a_batch_is_asked_for_again(feed):
    url, asked = feed
    reader = feeds.FeedStream({"url": url, "queries": '[{"q":"a"}]', "next_field": "page.next"})
    start = reader.initialOffset()
    rows, middle = reader.read(start)
    first = list(rows)
    rows, end = reader.read(middle)
    assert list(reader.readBetweenOffsets(start, end)) == first + list(rows) and reader.read(end)[1] != end
    assert len(json.dumps(end)) < 100
