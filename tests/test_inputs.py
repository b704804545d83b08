"""Page scans, stage inputs, feeds, typed records, alerts, heartbeats."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noticeflow import catalog
from noticeflow.functions import answers, money, pieces, scan, sections
from noticeflow.functions.html import Node
from noticeflow.plans import inputs as stage_inputs
from noticeflow.sources import feeds, inputs, sinks
from noticeflow.streaming import events as ev

TEXT = "正文内容" * 40


def test_selectors():
    x = Node("div", {"class": "article white", "id": "page-title", "role": "main"})
    assert [s for s in ("div", ".article", ".article.white", ".articles", "#page-title", "[id*='title']", "[class*='whi']", "[role='main']", "[role='mai']", "main") if scan.selects(s, x)] == ["div", ".article", ".article.white", "#page-title", "[id*='title']", "[class*='whi']", "[role='main']"]


def test_boxes_hold_places_and_counts():
    root = scan.parse("<div> a  <b>b</b><ul><li><a href='/x'>c</a></li><li><a href='#'>d</a></li></ul><p hidden>no</p><button role='button'>k</button></div>")
    page = scan.Boxes(root)
    assert page.text.split() == ["a", "b", "c", "d", "k"] and [x.name for x in page.nodes] == ["div", "b", "ul", "li", "a", "li", "a", "button"]
    assert page.counts(0) == {"link": 1, "item": 2, "table": 0, "control": 2} and page.counts(2) == {"link": 1, "item": 2, "table": 0, "control": 0}
    assert [page.text[slice(*page.span(i))] for i in (1, 3, 4)] == ["b", "c", "c"]
    # As counted one by one below each box.
    for i, x in enumerate(page.nodes):
        below = [y for y in x.elements() if "hidden" not in y.attrs]
        assert page.counts(i)["item"] == sum(y.name == "li" for y in below) and page.last[i] - i - 1 == len(below)


def test_scan():
    head = "<div class='notice-title'>某项目招标公告 发布日期：2026-01-01 项目编号：A1 采购单位：甲</div>"
    found = scan.scan(f"<div class='nav'>{'m' * 300}</div>{head}<div class='detail'>{TEXT}</div>")
    assert (found["main"], found["relation"]) == (f'<div class="detail">{TEXT}</div>', "disjoint") and "A1" in found["header"]
    assert scan.page_content(f"{head}<div class='detail'>{TEXT}</div>").startswith("<div><div>某项目")
    # The header is not repeated where the main part holds it, with or without a box of its own.
    assert scan.page_content(f"<div class='detail'>{head}{TEXT}</div>").count("A1") == 1
    assert scan.joined("<p>a b</p>", "<b>a</b>", "disjoint") == "<p>a b</p>" and scan.joined("<p>a</p>", "<b>a c</b>", "disjoint") == "<b>a c</b>"
    assert scan.joined("", "h", "") == "h" and scan.joined("m", "", "") == "m"
    # Of the boxes without a selector those of most text are asked; hidden ones never.
    assert scan.scan(f"<div hidden class='detail'>{TEXT}{TEXT}</div><section>{TEXT}</section>")["main"] == f"<section>{TEXT}</section>"
    many = "".join(f"<div>{'x' * (100 + i)}</div>" for i in range(400))
    assert scan.scan(many)["main"] == f"<div>{'x' * 499}</div>"
    for empty in ("", None, "<script>x</script>", "<!-- x -->"):
        assert scan.page_content(empty) == ""
    assert scan.page_content("<div class='detail-content'><p>短</p></div>") == "<div><p>短</p></div>"
    assert len(scan.page_content("<div>" * 3000 + TEXT)) > len(TEXT)


def test_scores_of_header_blocks():
    page = scan.Boxes(scan.parse("<p>发布日期：2026-01-01 联系人：甲，电话号码一二三四五</p><p>没有标签的一段文字，长度超过二十个字符的说明</p><p>项目名称 采购单位 而没有冒号的一段文字在这里的说明</p>"))
    assert scan.block_score(page, 0) >= scan.BLOCK["wanted"] and scan.block_score(page, 1) == scan.block_score(page, 2) == float("-inf")


def test_stage_text_and_sections(spark):
    rows = spark.createDataFrame([(1, "# 标题\n\n# 正文\nb\n# 标题二\nz"), (2, None), (3, "no headings"), (4, "# 正文\n\n# x\ny")], "doc_id int, source_text string")
    out = {r.doc_id: (r.primary, r.secondary, r.input_truncated) for r in stage_inputs.from_sources(rows).collect()}
    assert out == {1: ("【正文】\nb", "# 标题二\nz", False), 2: ("", "", False), 3: ("no headings", "", False), 4: ("# 正文\n\n# x\ny", "", False)}
    long = spark.createDataFrame([(1, "# 正文\n" + "x" * 60_000)], "doc_id int, source_text string")
    assert [(len(r.primary), r.input_truncated) for r in stage_inputs.from_sources(long).collect()] == [(50_000, True)]
    assert [(r.pos, r.heading, r.content) for r in sections.rows(rows.filter("doc_id = 4"), "doc_id", "source_text").collect()] == [(0, "正文", ""), (1, "x", "y")]
    pages = spark.createDataFrame([(1, "<p>a</p>"), (2, None)], "page_id int, html string")
    asked = stage_inputs.asked(stage_inputs.from_pages(pages), "P", lambda s: s.upper(), "meta", "page_id").collect()
    assert [tuple(r) for r in asked] == [(1, "meta", 1, "P\n\n<P>A</P>", False)]


@pytest.fixture(scope="module")
def feed():
    class Handler(BaseHTTPRequestHandler):
        def answer(self, asked):
            last = asked.get("next", [""])[0]
            n = int(last or 0)
            who = asked.get("q", ["-"])[0]
            following = {"loop": "1", "bad": None}.get(who, str(n + 1) if n < 2 else None)
            self.send_response(404 if who == "bad" else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"q": who, "n": n, "via": self.command, "page": {"next": following}}).encode())

        def do_GET(self):
            self.answer(parse_qs(urlsplit(self.path).query))

        def do_POST(self):
            self.answer(parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode()))

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/feed"
    server.shutdown()


def test_paged_feed(spark, feed):
    spark.dataSource.register(feeds.PagedFeed)
    ask = lambda **o: spark.read.format("paged_feed").options(url=feed, **o).load()
    rows = ask(queries='[{"q":"a"},{"q":"标"},{"q":"bad"}]', next_field="page.next").collect()
    got = sorted((r.query, r.page, r.status, json.loads(r.body)["q"], json.loads(r.body)["n"]) for r in rows)
    assert got == [(0, 0, 200, "a", 0), (0, 1, 200, "a", 1), (0, 2, 200, "a", 2), (1, 0, 200, "标", 0), (1, 1, 200, "标", 1), (1, 2, 200, "标", 2), (2, 0, 404, "bad", 0)]
    assert [json.loads(r.body)["via"] for r in ask(method="post", queries='[{"q":"a","x":null}]').collect()] == ["POST"]
    with pytest.raises(Exception, match="twice"):
        ask(queries='[{"q":"loop"}]', next_field="page.next").collect()
    with pytest.raises(ValueError, match="web address"):
        feeds.FeedReader({"url": "ftp://x"})


def test_prompts(spark, tmp_path):
    (tmp_path / "ALL.txt").write_text("all\n{day}")
    (tmp_path / "other.md").write_text("x")
    found = inputs.prompts(spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == [("ALL", "all\n{day}")] and inputs.prompt(found, "ALL") == "all\n{day}"
    with pytest.raises(KeyError):
        inputs.prompt(found, "none")
    said = catalog.stage_prompt("contacts", {"agency": "代理机构"})
    assert "1. buyerName (string, \"\" if absent) required" in said and "agency - 代理机构" in said
    with pytest.raises(ValueError):
        catalog.stage_prompt("none")


def test_typed_records(spark):
    kinds = sinks.record_kinds()
    out = sinks.typed_record('{"budgetAmount":"1,200","winnerAmount":"x","isEquipment":"是","lotProducts":[{"unitPrices":" 1.50 "},3],"projectName":null,"extra":1}', kinds)
    assert list(out) == [f.key for f in catalog.FIELDS] and (out["budgetAmount"], out["winnerAmount"], out["isEquipment"], out["projectName"], out["lotCandidates"]) == (1200, None, True, "", [])
    assert len(out["lotProducts"]) == 1 and out["lotProducts"][0]["unitPrices"] == 1.5 and out["lotProducts"][0]["lotName"] == ""
    rows = spark.createDataFrame([('"a": "1: \\"x\\"\\n标"',), ("[1]",), (None,), ("no",), ('{"data":[1],"a":"y"}',)], "raw string")
    assert [r[0] for r in rows.select(sinks.typed_yaml(F.col("raw"), {"a": "string", "b": "number"})).collect()] == ['a: "1: \\"x\\"\\n标"\nb: null\n', None, None, None, 'a: "y"\nb: null\n']
    texts = ["1,000", "-007", "-0", "1.", ".5", "1e3", "1.5e3", "", None, "1.2.3", "12345678901234567890123"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(money.script_number(F.col("t"))).collect()]
    assert got == ["1000", "-7", "0", "1.0", "0.5", None, "1500.0", None, None, None, "12345678901234567890123"]


def test_alerts(spark):
    sent = []
    rows = spark.createDataFrame([("a",), ("b",)], "text string").coalesce(1)
    sinks.alerting(sent.append, "s", lambda: 7.5)(rows, 0)
    sinks.alerting(sent.append)(rows.limit(0), 1)
    assert [m["content"]["text"] for m in sent] == ["a", "b"] and sent[0]["sign"] == answers.webhook_signature("s", 7) and sent[0]["timestamp"] == "7"


def test_heartbeats(spark, tmp_path):
    rows = spark.createDataFrame([("s", "started"), ("s", "item"), ("t", "done")], "session string, event_type string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ev.with_heartbeats(ev.read_events(spark, str(tmp_path / "in"), rows.schema), "session", seconds=2)
    seen = []
    run = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").foreachBatch(lambda df, _: seen.extend(tuple(r) for r in df.collect())).start()
    try:
        for _ in range(30):
            if seen.count(("s", "heartbeat")) >= 2 or run.awaitTermination(1):
                break
    finally:
        run.stop()
    assert seen.count(("s", "heartbeat")) >= 2 and ("t", "heartbeat") not in seen
    assert sorted(set(seen)) == [("s", "heartbeat"), ("s", "item"), ("s", "started"), ("t", "done")]


def test_typed_yaml_asks_the_library_for_odd_fields_alone(monkeypatch):
    kinds = {"s": "string", "n": "number", "b": "boolean", "yes": "string", "a b": "string", "l": "array", "rows": {"id": "string", "n": "number", "off": "boolean"}, "none": {}}
    texts = ["", " x  y ", "é标\xa0", 'q"\\', "\n\r\t\0", "\x7f\x85\u2028\ufeff\U0001f600", "null", "1", "- a: b # c", "x" * 300 + " " + "y" * 300]
    numbers = [0, -1, 10**30, 1.5, 1e30, -1e-9, 1e17, 1.25e-7, True, None, "1,000", "1.", "1e5", float("inf"), float("nan"), "x"]
    write = sinks._yaml_writer(kinds)
    for i in range(160):
        t, n = texts[i % len(texts)], numbers[i % len(numbers)]
        raw = json.dumps({"s": t, "n": n, "b": i % 3, "yes": t, "a b": n, "l": [[1, {"k": t}], [], t][i % 3], "rows": [{"id": t, "n": n, "off": 0}, {"id": i}] * (i % 3), "none": [{}] * (i % 2)})
        record = sinks.typed_record(raw, kinds)
        assert write(record) == sinks._dumped(record)
    write = sinks._yaml_writer({"s": "string", "rows": {"id": "string", "n": "number"}})
    monkeypatch.setattr(sinks, "_dumped", None)
    assert write({"s": "a", "rows": [{"id": "1", "n": 1.5}]}) == 's: "a"\nrows:\n- id: "1"\n  n: 1.5\n'


def test_many_small_files_are_few_tasks(spark, tmp_path):
    files = spark.range(1200).selectExpr("concat(id div 100, '/', id, '.txt') as path", "concat('t', id) as content")
    assert sinks.write_files(files.repartition(4), str(tmp_path / "f")) == 1200
    read = inputs.text_files(spark, str(tmp_path / "f"))
    assert read.rdd.getNumPartitions() <= inputs.TASKS_A_CORE * spark.sparkContext.defaultParallelism
    assert sorted(r.source_text for r in read.collect()) == sorted(f"t{i}" for i in range(1200))


def test_pages_are_read_in_pieces_of_bounded_bytes(spark):
    batch = pa.record_batch({"k": list(range(7)), "t": ["x" * 10, None, "é" * 5, "x" * 50, "", "y", "z" * 20]})
    parts = list(pieces.pieces(batch, "t", 20))
    assert [p.column("k").to_pylist() for p in parts] == [[0, 1, 2], [3], [4, 5], [6]] and not list(pieces.pieces(batch.slice(0, 0), "t"))
    assert "PandasUDF" not in str(stage_inputs.from_pages(spark.createDataFrame([(1, "<p>x</p>")], "page_id int, html string"))._jdf.queryExecution().toString())
    rows = spark.createDataFrame([(1, "a", "x" * 700_000), (2, None, None), (3, "c", "y" * 700_000)], "k int, o string, t string").coalesce(1)
    got = pieces.reading(rows, "t", lambda x: (x and x[:2], x is None), "head string, none boolean").orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "a", "xx", False), (2, None, None, True), (3, "c", "yy", False)]
