"""The normalise and crawl plans on recorded answers; streams against batches."""

import json
import random
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from noticeflow import catalog
from noticeflow.functions import category
from noticeflow.operators.dedupe import unique_names
from noticeflow.plans import answers, budget
from noticeflow.plans import normalize as plan
from noticeflow.sources import sinks
from noticeflow.streaming import events as ev

TERMS = "挖机、推土机\n装载机,叉车"
HTML = "<div class='detail-content'><p>采购推土机两套，共计两百万元，资金已落实，现公开招标，欢迎投标。</p></div>"


def say(doc, stage, attempt=1, cut=False, **payload):
    return (doc, stage, attempt, payload.get("text") or json.dumps(payload, ensure_ascii=False), cut)


@pytest.fixture(scope="module")
def responses(spark):
    rows = [
        say(1, "title", projectName="某工程"),
        say(1, "meta", cut=True, projectName="旧名", announcementDate="2026年2月6日", bidOpenDate="2026-02-30", budgetAmount="200万元", winnerAmount="1~2", announcementType="招标公告", isEquipment="未知"),
        say(1, "contacts", buyerName="甲方", agency="无"),
        say(1, "address_detail", buyerAddressDetail="浙江省杭州市西湖区1号"),
        say(1, "lots", lotProducts=[{"lotNumber": "1", "subjects": "推 土机", "quantities": "2套", "models": "D6"}], lotCandidates=[{"lotName": "第2包:叉车", "candidates": "乙方", "candidatePrices": "9万"}]),
        say(1, "address_admin", 1, buyerCountry="中国", buyerProvince="浙江", buyerCity="杭州市", buyerDistrict="西湖区"),
        say(1, "address_admin", 2, buyerCountry="中国", buyerProvince="浙江省", buyerCity="杭州市", buyerDistrict="西湖区"),
        say(1, "estimated_amount", 1, text="about"),
        say(1, "estimated_amount", 2, text="80000~90000"),
        say(2, "meta", announcementType="不明"),
        say(2, "type_repair", 1, announcementType="还是不明"),
        say(2, "type_repair", 2, announcementType="中标结果"),
        say(3, "meta", announcementType="不明", projectName="x"),
        say(4, "machinery", isMachinery="false"),
        say(4, "meta", announcementType="招标", projectName="办公用品"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, stage string, attempt int, payload string, input_truncated boolean")


def test_normalize(spark, responses):
    sources = spark.createDataFrame([(i, f"### 标题\n标题{i}\n### 正文\n<p>a<span>b</span></p>\n") for i in (1, 2, 3)], "doc_id bigint, source_text string")
    terms = category.product_terms(spark, TERMS)
    out = plan.normalize(sources, responses, terms)
    assert out.columns == [*catalog.item_schema().names, "doc_id", "outcome_code"] or set(out.columns) == {*catalog.item_schema().names, "doc_id", "outcome_code"}
    by = {r.doc_id: r for r in out.collect()}
    a = by[1]
    assert (a.projectName, a.announcementName, a.announcementContent, a.announcementDate, a.bidOpenDate) == ("某工程", "标题1", "<p>ab</p>", "2026-02-06", None)
    assert (a.budgetAmount, a.winnerAmount, a.announcementType, a.isEquipment, a.isOverseasProject, a.agency, a.inputTruncated) == (2e6, None, "招标", True, False, "", True)
    assert [(p.lotNumber, p.subjects, p.productCategory, p.quantities, p.quantityUnit) for p in a.lotProducts] == [("标段一", "推 土机", "推土机", "2", "套"), ("标段二", "叉车", "叉车", "", "")]
    assert a.estimatedAmount == "80000~90000" and a.buyerProvince == "浙江省" and (a.projectCountry, a.projectCity) == ("中国", "")
    assert (by[2].announcementType, by[2].outcome_code, by[3].outcome_code) == ("中标", "success", "skipped_invalid_announcement_type")
    assert len({r.dataId for r in by.values()}) == 3 and all(len(r.dataId) == 64 for r in by.values())
    assert by[2].estimatedAmount == "" and by[2].lotProducts == []
    with pytest.raises(PySparkException):
        plan.normalize(sources, responses, terms, strict=True).collect()


def test_crawl_outcomes(spark, responses):
    rows = [
        (1, "http://a.b/d/1", "http://a.b/l", "t", "2026/2/16", HTML, 1),
        (2, "http://a.b/d/1", "http://a.b/l", "t", "2026-2-16", HTML, 2),
        (3, "http://a.b/d/3", "http://a.b/l", "t", None, HTML, 3),
        (4, "http://a.b/d/4", "http://a.b/l", "t", None, HTML, 4),
        (5, "http://a.b/l/", "http://a.b/l", "t", None, HTML, 5),
        (6, "unknown", "http://a.b/l", "u", "2026-1-1", HTML, 6),
        (7, "", "http://a.b/l", "u", "2026-1-1", HTML, 7),
        (8, "http://a.b/d/8", "http://a.b/l", "t", None, "<script>x</script>", 8),
        (9, "http://a.b/d/9", "http://a.b/l", "t", None, HTML, 9),
    ]
    pages = spark.createDataFrame(rows, "doc_id bigint, url string, list_url string, title string, list_date string, html string, arrival bigint")
    ledger = spark.createDataFrame([("http://a.b/d/9",)], "detail_key string")
    terms = category.product_terms(spark, TERMS)
    out = {r.doc_id: r for r in plan.crawl(pages, responses, terms, ledger, machinery_only=True).collect()}
    assert len(out) == len(rows)
    assert {i: r.outcome_code for i, r in out.items()} == {1: "success", 2: "skipped_duplicate", 3: "skipped_invalid_announcement_type", 4: "skipped_non_gongchengjixie", 5: "not_on_detail_page", 6: "skipped_invalid_announcement_type", 7: "skipped_duplicate", 8: "extract_content_empty", 9: "skipped_duplicate"}
    assert out[6].detail_key == "u|2026-01-01" and out[6].announcementDate == "2026-01-01"
    assert "推土机" in out[1].announcementContent
    kept = plan.crawl(pages, responses, terms, ledger).filter("doc_id = 4").first()
    assert kept.outcome_code == "success"
    # Later stages of rejected pages are gone before anything reads them; all others' are there.
    more = responses.unionByName(spark.createDataFrame([(i, "contacts", 1, '{"buyerName": "b"}') for i in (1, 4)], "doc_id bigint, stage string, attempt int, payload string"), allowMissingColumns=True)
    left = plan._without_rejected(more, "doc_id")
    assert {(r.doc_id, r.stage) for r in more.collect()} - {(r.doc_id, r.stage) for r in left.collect()} == {(r.doc_id, r.stage) for r in more.collect() if r.doc_id == 4 and r.stage not in ("meta", "machinery")} != set()
    routed = {r.doc_id: r for r in plan.crawl(pages, more, terms, ledger, machinery_only=True).filter("doc_id in (1, 4)").collect()}
    assert routed[4].buyerName == "" and routed[4].projectName != "" and routed[1].buyerName == "b"
    # A key whose first page arrives empty is free for the next one.
    again = spark.createDataFrame([(20 + i, "http://a.b/d/20", "http://a.b/l", "t", None, h, i) for i, h in enumerate(["<script>x</script>", "<style>y</style>", HTML, "<script>z</script>", HTML])], pages.schema)
    out = {r.doc_id: r.outcome_code for r in plan.crawl(again, responses.withColumn("doc_id", F.when(F.col("doc_id") == 1, 22).otherwise(0).cast("bigint")), terms, ledger).collect()}
    assert out == {20: "extract_content_empty", 21: "extract_content_empty", 22: "success", 23: "skipped_duplicate", 24: "skipped_duplicate"}
    assert [r.detail_key for r in plan.ledger_of(plan.crawl(again.limit(2), responses, terms, ledger)).collect()] == []


def test_content_to_markdown_and_parents(spark):
    said = spark.createDataFrame([("a", "markdown", 1, "```\n# x\\n\n```"), ("o", "parent", 1, '{"parentOrgName":"","confidence":true,"sourceUrls":[]}'), ("p", "parent", 1, '{"parentOrgName":"P","confidence":1,"sourceUrls":[]}')], "k string, stage string, attempt int, payload string")
    contents = spark.createDataFrame([("a", "x"), ("b", " "), ("c", "y")], "k string, content string")
    assert {r.k: r.markdown for r in answers.content_to_markdown(contents, said, "k").collect()} == {"a": "# x\n", "b": "", "c": None}
    hits = spark.createDataFrame([], "k string, pos int, url string, title string")
    out = {r.k: r for r in answers.parents(spark.createDataFrame([("o",), ("p",)], "k string"), said, hits, "k").collect()}
    assert out["o"].parent is None and (out["p"].affiliate, out["p"].parent, out["p"].confidence) == ("p", "P", 1.0)
    assert [tuple(s) for s in out["p"].sources] == [(answers.NO_SOURCE, answers.NO_SOURCE)]


def test_a_file_for_each_notice(spark, tmp_path):
    items = spark.createDataFrame([("2026-01-01", "站", f"t{i}_d.json", i, None) for i in range(5)], "day string, site string, file_name string, id bigint, x double").repartition(3)
    files = sinks.record_files(items, ["id", "x"])
    for _ in range(2):  # once more gives the same files
        assert sinks.write_files(files, tmp_path.as_uri()) == 5
    assert sorted(p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*.json")) == [f"2026-01-01/站/t{i}_d.json" for i in range(5)]
    assert (tmp_path / "2026-01-01/站/t3_d.json").read_text() == '{\n  "id": 3,\n  "x": null\n}'
    assert sinks.write_files(files.limit(0), tmp_path.as_uri()) == 0


def test_running_spend_like_one_by_one(spark):
    rnd = random.Random(4)
    costs = [None, 0.25, 0.5, 1.0, 2.0, -1.0]
    rows = [(i, datetime(2026, 1, rnd.randint(1, 3), rnd.randint(0, 23), rnd.randint(0, 59), rnd.randint(0, 3)), rnd.choice(costs)) for i in range(600)]
    rows += [(600 + i, datetime(2026, 1, 2, 12, 0, i % 2), rnd.choice(costs)) for i in range(100)] + [(700, None, 1.0), (701, None, None)]
    got = {r.k: (r.running, r.stopped) for r in budget.running_spend(spark.createDataFrame(rows, "k int, ts timestamp_ntz, v double"), "ts", "v", "k", 20.0, "UTC").collect()}
    want, sums, most = {}, {}, {}
    for k, ts, v in sorted(rows, key=lambda r: (r[1] or datetime.min, r[0])):
        day = ts and ts.date()
        if v is not None:
            sums[day] = sums.get(day, 0.0) + v
        if sums.get(day) is not None:
            most[day] = max(most.get(day, sums[day]), sums[day])
        want[k] = (sums.get(day), None if day not in most else most[day] >= 20)
    assert got == want and {s for _, s in got.values()} >= {True, False}


def test_delivered_like_one_by_one(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["a", "b", None]), rnd.choice(["item", "item", "control"]), rnd.choice([None, *range(30)])) for i in range(400)] + [(400, "c", "item", 1), (401, "d", "control", 1), (402, "a", None, 5)]
    out = ev.delivered(spark.createDataFrame(rows, "id int, batch string, kind string, t int"), ["t", "id"], "kind", 20)
    assert out.columns == ["id", "batch", "kind", "t", "dropped"]
    want, n = {}, {}
    for i, batch, kind, _ in sorted(rows, key=lambda r: (r[3] is not None, r[3] or 0, r[0])):
        n[batch] = n.get(batch, 0) + (kind == "item")
        want[i] = kind == "item" and n[batch] > 20
    assert {r.id: r.dropped for r in out.collect()} == want and any(want.values())


def test_budget_days_are_those_of_the_zone(spark):
    rows = spark.createDataFrame([("2026-01-01 15:59:59", 1.0, 1), ("2026-01-01 16:00:00", 2.0, 2)], "t string, v double, k int").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    old = spark.conf.get("spark.sql.session.timeZone")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert {str(r.day): r.spent_usd for r in budget.daily_budget(rows, F.col("ts"), F.col("v"), 9.0).collect()} == {"2026-01-01": 1.0, "2026-01-02": 2.0}
    spark.conf.set("spark.sql.session.timeZone", old)
    assert {str(r.day) for r in budget.running_spend(rows, "ts", "v", "k", 9.0, "UTC").collect()} == {"2026-01-01"}


def test_names_after_existing(spark):
    rows = spark.createDataFrame([(1, "t", "d"), (2, "t", "d"), (3, "u", "d")], "k int, t string, d string")
    existing = spark.createDataFrame([("t", "d", 1)], "title string, date string, taken int")
    got = {r.k: r.file_name for r in unique_names(rows, F.col("t"), F.col("d"), ["k"], existing).collect()}
    assert got == {1: "t_d_2.json", 2: "t_d_3.json", 3: "u_d.json"}


def test_streams_like_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    seen, spent = [], {}
    stream = ev.read_events(spark, str(tmp_path / "in"), events.schema)
    ev.run_available(ev.first_seen_stream(stream, ["user_id", "event_type"], "ts", "1000 days"), str(tmp_path / "c1"), lambda df, _: seen.extend((r.user_id, r.event_type) for r in df.collect())).awaitTermination(60)
    assert sorted(seen) == sorted({(r.user_id, r.event_type) for r in events.collect()})
    ev.run_available(ev.daily_spend_stream(stream, "ts", "value", "1000 days"), str(tmp_path / "c2"), lambda df, _: spent.update({r.day: r.spent for r in df.collect()}), "update").awaitTermination(60)
    want = {r.day: r.s for r in events.groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("s")).collect()}
    assert {k: round(v, 6) for k, v in spent.items()} == {k: round(v, 6) for k, v in want.items()}


def test_search_rounds(spark):
    """Answers that come in round 3, and in the last one, which may not search any more."""
    search, other, nothing = [("web_search", "q")], [("browse", "q")], [("web_search", " ")]
    answer = lambda url: '{"parentOrgName": "P", "confidence": 0.9, "sourceUrls": ["%s"]}' % url
    rows = [("late", i, search, None) for i in range(3)] + [("late", 3, None, answer("u2")), ("late", 4, [], answer("no"))]
    rows += [("last", i, search, None) for i in range(answers.MAX_ROUNDS)] + [("last", answers.MAX_ROUNDS, search, answer("u9")), ("last", answers.MAX_ROUNDS + 1, [], answer("no"))]
    rows += [("never", 0, [], answer("u0")), ("open", 0, search, None), ("open", 1, search, None)]
    rows += [("other", 0, search, None), ("other", 1, search + other, None), ("other", 2, [], answer("u0")), ("blank", 0, nothing + other, None)]
    rounds = spark.createDataFrame(rows, "org string, round int, tools array<struct<name: string, query: string>>, payload string")
    got = {r.org: (r.outcome, r.round) for r in answers.search_rounds(rounds).collect()}
    assert got == {"late": ("answered", 3), "last": ("answered", 10), "never": ("no_search", 0), "open": ("no_answer", None), "other": ("unsupported_tool", 1), "blank": ("empty_query", 0)}
    hits = [("late", 2, 0, "u2", "second"), ("late", 1, 5, "u2", "first"), ("late", 3, 0, "no", "after"), ("last", 9, 1, "u9", "ninth"), ("last", 10, 0, "u9", "after")]
    hits = spark.createDataFrame(hits, "org string, round int, pos int, url string, title string")
    said = spark.createDataFrame([("late", "parent", 1, answer("x")), ("late", "affiliate", 1, '{"affiliateOrgName": "A"}')], "org string, stage string, attempt int, payload string")
    orgs = rounds.select("org").distinct()
    out = {r.org: r for r in answers.searched_parents(orgs, rounds, said, hits).collect()}
    assert len(out) == 6 and (out["late"].affiliate, out["late"].parent) == ("A", "P")
    assert [tuple(s) for s in out["late"].sources] == [("first", "u2")] and [tuple(s) for s in out["last"].sources] == [("ninth", "u9")]
    assert all(out[k].parent is None for k in ("never", "open", "other", "blank"))
