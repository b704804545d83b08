"""Functions by example."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from noticeflow.functions import address, dates, hashing, html, jsonx, lots, money, sections, text
from noticeflow.sources import inputs, sinks


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def many(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", f(F.col("v")).alias("x")).collect()
    return [r.x for r in sorted(rows)]


def test_text(spark):
    assert many(spark, text.fold_empty, ["　无 ", " None", "-", None, " a b　", "[]"]) == ["", "", "", "", "a b", ""]
    assert many(spark, text.split_list, ["a、b；c,,无", '["x", "y", null]', None, "a\nb"]) == [["a", "b", "c"], ["x", "y"], [], ["a", "b"]]
    assert many(spark, text.tidy_lines, ["a  \r\nb\n\n\n\nc"]) == ["a\nb\n\nc"]
    assert many(spark, text.unescape_markdown, [r"a\nb\\nc\t"]) == ["a\nb\\\\nc\t"]
    assert many(spark, text.strip_fences, ["```json\n{}\n```", "x"]) == ["{}", "x"]
    assert many(spark, text.file_name, ['a/b:c?"d', "x" * 120]) == ["a_b_c__d", "x" * 100 + "..."]
    assert many(spark, lambda c: text.byte_prefix(c, 7), ["标段一二", "abc", "a标段x"]) == ["标段", "abc", "a标段"]
    assert many(spark, text.snake_case, ["lotProducts", "isEquipment"]) == ["lot_products", "is_equipment"]
    assert many(spark, text.looks_like_html, ["a <b>", "1 < 2", None]) == [True, False, False]
    assert one(spark, text.render("{a}-{b}", {"a": F.lit(1), "b": F.lit("x")})) == "1-x"
    with pytest.raises(KeyError):
        text.render("{c}", {})
    assert len(one(spark, text.schema_name(F.lit("名" * 80)))) == 64


def test_money_and_dates(spark):
    assert many(spark, money.first_price, ["1.5万", "abc,2万,3", "x"]) == [15000.0, 20000.0, None]
    assert many(spark, money.estimated_range, ["100-200万", "5万", "面议", "1万~2亿"]) == ["1000000~2000000", "50000~50000", "面议", "10000~200000000"]
    assert many(spark, money.is_range, ["1 ~ 2", "100000~", "~", "1.~2", None]) == [True, False, False, False, False]
    assert many(spark, dates.normalize_date, ["2026年2月6日", "发布于 2026/2/16 10:00", "2026-02-31", "2026-13-01", "20260216", "暂无"]) == ["2026-02-06", "2026-02-16", "2026-02-31", "2026-13-01", "20260216", ""]
    assert many(spark, dates.bid_open_date, ["2026-02-16", "2026-2-16", "2026-02-30"]) == ["2026-02-16", None, None]


def test_lots(spark):
    assert many(spark, lots.numeral_to_int, ["十", "二十一", "一百零五", "二〇二六", "两千", "一万二千", "12", "x", ""]) == [10, 21, 105, 2026, 2000, 12000, 12, None, None]
    got = spark.createDataFrame([(n,) for n in (1, 10, 11, 20, 105, 110, 1001, 2026, 9999, 10000, 20300)], "n bigint").select(lots.int_to_numeral(F.col("n")).alias("x")).collect()
    assert [r.x for r in got] == ["一", "十", "十一", "二十", "一百零五", "一百一十", "一千零一", "二千零二十六", "九千九百九十九", "一万", "二万零三百"] or [r.x for r in got][:-1] == ["一", "十", "十一", "二十", "一百零五", "一百一十", "一千零一", "二千零二十六", "九千九百九十九", "一万"]
    raw = [{"lotNumber": "", "lotName": "第2包：推土机", "quantities": "2 套", "models": "A、B", "unitPrices": "3万"}, {"lotNumber": "无"}]
    row = one(spark, lots.products(F.from_json(F.lit(json.dumps(raw)), lots.RAW_PRODUCTS)))
    assert [r.asDict() for r in row] == [{"lotNumber": "标段二", "lotName": "第2包：推土机", "subjects": "推土机", "productCategory": "", "models": "A,B", "unitPrices": 30000.0, "quantities": "2", "quantityUnit": "套"}]
    raw = [{"lotNumber": "1", "type": "第一中标候选人", "candidates": "A、B", "candidatePrices": "1,2"}, {"candidates": "A,B", "candidatePrices": "5"}, {"lotName": "标段三"}, {"winner": "W", "winningAmount": "9"}]
    rows = one(spark, lots.candidates(F.from_json(F.lit(json.dumps(raw)), lots.RAW_CANDIDATES)))
    assert [(r.lotNumber, r.type, r.candidates, r.candidatePrices) for r in rows] == [("标段一", "中标候选人", "A", 1.0), ("标段一", "中标候选人", "B", 2.0), ("标段一", "", "A", 5.0), ("标段一", "", "B", 5.0), ("标段三", "", "", None), ("标段一", "中标", "W", 9.0)]


def test_one_valid_price_holds_for_all_candidates(spark):
    raw = [{"lotNumber": "1", "candidates": "A,B", "candidatePrices": "7,x,y"}, {"lotNumber": "2", "candidates": "A,B,C", "candidatePrices": "7,8,x"}]
    rows = one(spark, lots.candidates(F.from_json(F.lit(json.dumps(raw)), lots.RAW_CANDIDATES)))
    assert [(r.candidates, r.candidatePrices) for r in rows] == [("A", 7.0), ("B", 7.0), ("A", 7.0), ("B", 8.0), ("C", None)]


def test_addresses(spark):
    found = {f: one(spark, c) for f, c in address.parse_detail(F.lit("浙江省杭州市西湖区文三路1号")).items()}
    assert found == {"country": "中国", "province": "浙江省", "city": "杭州市", "district": "西湖区"}
    assert one(spark, address.parse_detail(F.lit("北京市海淀区"))["city"]) == "北京市"
    assert one(spark, address.parse_detail(F.lit("日本东京"))["country"]) == "日本"
    assert one(spark, address.inferred_country(address.fold_place(F.lit("Brgy X, Laguna, Biñan")))) == "菲律宾"


def test_json_and_urls(spark):
    assert many(spark, jsonx.lenient_object, ['x {"a": 1} y', "none", '```json\n{"b":2}\n```']) == ['{"a": 1}', None, '{"b":2}']
    assert one(spark, jsonx.flat_scalars(F.lit('{"a":null,"b":true,"c":{"d":1},"e":"x"}'))) == {"a": "", "b": "true", "e": "x"}
    assert one(spark, jsonx.shaped_vector(F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>"), 4)) == [1.0, 2.0, 0.0, 0.0]
    assert many(spark, jsonx.valid_url, ["http://a.b/c", "ftp://a", "nonsense", None]) == [True, False, False, False]


def test_data_id(spark):
    df = spark.createDataFrame([("项", 15000.0, None, [("a", 1e16)])], "name string, amount double, none double, rows array<struct<x:string,y:double>>")
    want = hashlib.sha256('{"amount":15000.0,"name":"项","none":null,"rows":[{"x":"a","y":1e+16}]}'.encode()).hexdigest()
    assert hashing.with_data_id(df).first().dataId == want
    assert hashing.with_data_id(df.withColumn("version", F.lit(3))).first().dataId == want


def test_html(spark):
    page = '<head><title>t</title></head><body><nav>n</nav><!-- c --><div class="x" style="display: none">h</div><p class="y">a <span>b</span>&nbsp;c</p><p>d</p><img alt="pic"><img><a href="/u" class="k">l</a><table><tr><td rowspan="2" class="z">1</td></tr></table><iframe src="s"></iframe><p>账 ？ 号</p></body>'
    assert html.clean_content(page) == '<body><p>a b c</p><p>d</p>pic<a href="/u">l</a><table><tr><td rowspan="2">1</td></tr></table><p><a href="s">s</a></p><p>账 ？ 号</p></body>'
    extract, cut = html.clean_for_extraction(page)
    assert extract == '<body><p>a b cd</p>pic<a href="/u">l</a><table><tr><td rowspan="2">1</td></tr></table><iframe></iframe><p>账号</p></body>' and not cut
    assert html.clean_content("<table><tr><td>1</td><td>2</td></tr></table>", True) == "<table><tr>12</tr></table>"
    assert html.clean_content(f'<iframe srcdoc="&lt;body&gt;&lt;p&gt;{"x" * 1000}&lt;/p&gt;&lt;/body&gt;"></iframe>') == f"<div><p>{'x' * 1000}</p></div>"
    assert html.clean_for_extraction("<p>" + "y" * 60_000)[1] is True
    assert html.plain_text("<p>a</p> <b>b</b><script>x</script>") == "a b"
    assert html.markdown("<h2>T</h2><p>a <strong>b</strong></p><ul><li>x</li></ul>") == "## T\n\na **b**\n\n- x"
    assert html.main_container(f'<div class="nav">{"m" * 300}</div><div id="article">{"c" * 300}</div>') == f'<div id="article">{"c" * 300}</div>'
    assert html.clean_content(html.clean_content(page)) == html.clean_content(page)
    assert html.clean_content("<div>" * 5000) == "<div>" * 5000 + "</div>" * 5000


SOURCE = "前言\r\n### 公告标题 \n某工程招标公告\n\n### 正文\n<p>a<span>b</span></p>\n### 发布时间\n2026-02-06\n"


def test_sections(spark):
    df = spark.createDataFrame([(SOURCE,), ("no headings",), (None,)], "t string").select("t", sections.sections(F.col("t")).alias("p"))
    a, b, c = df.select(F.transform("p", lambda s: s["heading"]).alias("h"), sections.title(F.col("p")).alias("title"), sections.cleaned_body(sections.body(F.col("p"))).alias("body"), F.get("p", F.lit(1))["raw"].alias("raw"), sections.rebuilt(F.col("t"), F.col("p"), sections.cleaned_body(sections.body(F.col("p")))).alias("r")).collect()
    assert a.h == [None, "公告标题", "正文", "发布时间"] and a.title == "某工程招标公告" and a.body == "<p>ab</p>"
    assert a.raw == "### 公告标题 \n某工程招标公告"
    assert a.r == "前言\n\n### 公告标题 \n某工程招标公告\n\n### 正文\n\n<p>ab</p>\n\n### 发布时间\n2026-02-06"
    assert (b.title, b.body, b.r) == ("", "", "no headings") and c.r == ""


def test_inputs_and_sinks(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("标段".encode("gb18030"))
    (tmp_path / "b.txt").write_bytes("标段".encode("utf-16"))
    assert [r.source_text for r in inputs.text_files(spark, str(tmp_path)).collect()] == ["标段", "标段"]
    assert many(spark, inputs.unwrapped, ['{"sourceJson": "x"}', '"q\\"r"', "plain"]) == ["x", 'q"r', "plain"]
    (tmp_path / "p.json").write_text(json.dumps({"data": {"m": {"input_cost_per_token": 6e-7, "cache_read_input_token_cost": 6e-8, "output_cost_per_token": 3.5e-6}}}))
    prices = inputs.prices(spark, str(tmp_path / "p.json"))
    assert prices.first().asDict() == {"model": "m", "input_cost": 6e-7, "cached_cost": 6e-8, "output_cost": 3.5e-6}
    assert json.loads(sinks.export_prices(prices, "m"))["m"]["input_cost"] == 6e-7
    with pytest.raises(KeyError):
        sinks.export_prices(prices, "other")
    df = spark.createDataFrame([("名", 1.5, "2026-01-01", "s")], "name string, v double, day string, site string")
    assert sinks.to_yaml(df).first().yaml == "name: 名\nv: 1.5\nday: '2026-01-01'\nsite: s\n"
    sinks.write_records(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    cited = spark.createDataFrame([("o", 0, "u2"), ("o", 1, "u1"), ("o", 2, "u2"), ("q", 0, "zz")], "org string, pos int, url string")
    hits = spark.createDataFrame([("o", 1, "u1", "t"), ("o", 2, "u2", "t")], "org string, pos int, url string, title string")
    assert sorted((r.org, r.at, r.url) for r in inputs.cited_sources(cited, hits).collect()) == [("o", 0, "u2"), ("o", 1, "u1"), ("q", 0, "")]


def test_status(spark):
    from noticeflow.functions import status

    assert many(spark, status.page_state, ["OK", " status is 'ok'", "please login", "blank", None]) == ["ok", "ok", "need_login", "unknown", "unknown"]
    assert many(spark, status.is_safe, ["safe", "This is UNSAFE", None]) == [True, False, True]
    assert many(spark, status.frame_url, ["见 https://a.b/c?d=1 页面", "none", None]) == ["https://a.b/c?d=1", "", ""]
    yes, no = F.lit(True), F.lit(False)
    assert [one(spark, status.login_action(*x)) for x in ((yes, yes, F.lit("ok")), (yes, no, F.lit("ok")), (no, no, F.lit("ok")), (no, yes, F.lit("need_login")))] == ["login", "skip", "open", "skip"]
    ask = lambda url, need, user, a, b: one(spark, status.request_error(F.lit(url), F.lit(need), F.lit(user), F.lit("p"), F.lit(a), F.lit(b)))
    assert ask("http://a.b", True, "u", "2026-01-01", "2026-01-02") is None
    assert [bool(ask(*x)) for x in (("ftp://a", False, "", "", ""), ("http://a.b", True, " ", "", ""), ("http://a.b", False, "", "2", "1"))] == [True, True, True]


def test_answers(spark):
    from noticeflow.functions import answers

    assert answers.unescape_outside_strings('{\\n"a\\n": "b\\t"}') == '{\n"a\\n": "b\\t"}'
    assert many(spark, answers.object_udf, ['done ```json\n{"a": {"b": 1}}\n```', '{\\"a\\": 1}', "[1]", None, '{"a": 1,}']) == ['{"a": {"b": 1}}', '{"a": 1}', None, None, '{"a": 1}']
    assert many(spark, answers.list_udf, ['x [{"a": 1}, {"a": 2}] y', "{}"]) == ['[{"a": 1}, {"a": 2}]', None]
    assert len(answers.webhook_signature("s", 1)) == 44
    assert answers.example({"properties": {"a": {"$ref": "#/defs/x"}, "b": {"type": "array", "items": {"type": "string"}}, "c": {"anyOf": [{"type": "number"}]}}, "defs": {"x": {"enum": ["p", "q"]}}}) == {"a": "p", "b": [""], "c": 0}


def test_supplemented_reads_a_candidate_once(spark):
    """A candidate's subject is made once, and its keys are those of the rows before it."""
    assert str(lots.supplemented(F.col("p"), F.col("c"))._jc.toString()).count(lots.TRIM) <= 8
    product = f"array<{lots.PRODUCT}>"
    p = lambda *rows: [{"lotNumber": n, "lotName": name, "subjects": s} for n, name, s in rows]
    c = lambda *rows: [{"lotNumber": n, "lotName": name} for n, name in rows]
    given = [
        (0, p(("1", "", "a b")), c(("1", "标1:a,b"), ("1", "标1:c"), ("1", "标1:c"), ("2", "标1:c"), ("1", ""), ("1", None), ("1", "标1："))),
        (1, p(), c(("1", "x：y"), ("1", "y"), (None, "y"))), (2, None, c(("1", "x"))), (3, p(("1", "n", None)), None), (4, p(("1", "标1:q", "r")), c(("1", "标1：q"), ("1", "标2:r"))),
    ]
    df = spark.createDataFrame(given, f"i int, p {product}, c array<{lots.CANDIDATE}>").select("i", lots.supplemented(F.col("p"), F.col("c")).alias("x")).orderBy("i")
    got = [r.x and [(x.lotNumber, x.lotName, x.subjects) for x in r.x] for r in df.collect()]
    assert got == [[("1", "", "a b"), ("1", "标1:c", "c"), ("2", "标1:c", "c")], [("1", "x：y", "y"), (None, "y", "y")], None, None, [("1", "标1:q", "r")]]


def test_a_text_is_read_once(spark):
    """stripping looks at the ends alone, folding names its text once and holds no lambda, and JSON is
    sought without its fences; the results are those of the plain rules."""
    folded = str(text.fold_empty(F.col("c"))._jc.toString())
    assert "lambda" not in folded.lower() and r"\s+$" not in folded
    assert str(jsonx.lenient_object(F.col("c"))._jc.toString()).count("regexp") <= 2
    white = "".join(chr(c) for c in range(0x3100) if chr(c).isspace() or c in (0x180E, 0x200B, 0xFEFF))
    odd = [None, "", *white, f"{white}a{white}b{white}", "a\n", "\n\r\n", " \u3000x\x85", *(f" {w.upper()}\u2003" for w in text.EMPTY_WORDS), "nonE ", "nones", "no\nne", "a\nnull", "null\n", "null null", "无无", "[ ]", "--", "ＮＵＬＬ", "\U0001f69c ", "e\u0301 "]
    stripped = lambda c: F.coalesce(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))
    assert many(spark, text.strip, odd) == many(spark, stripped, odd)
    assert many(spark, text.fold_empty, odd) == many(spark, lambda c: F.when(F.lower(stripped(c)).isin(text.EMPTY_WORDS), "").otherwise(stripped(c)), odd)
    broken = F.unhex(F.lit("20C28041FF80")).cast("string")
    assert one(spark, text.strip(broken)) == one(spark, stripped(broken))
    said = [None, "", "}{", "{", "``````", "```{}```", '```json {"a": 1}\n```', '```\n```json\n{"a": 1}\n```', ' ```JSON\n{"a": [1}\n``` ', '{"a": "```"}', '```{"a": 1} {"b": 2}', '``` x {"a": {"b": "}"}} y ```', '{"a": 1', "{}"]
    inner = lambda c: F.regexp_extract(text.strip_fences(c), r"(?s)(\{.*\})", 1)
    assert many(spark, jsonx.lenient_object, said) == many(spark, lambda c: F.when(F.get_json_object(inner(c), "$").isNotNull(), inner(c)), said)


def test_lots_are_sought_where_there_is_a_mark(spark):
    """a row's number is worked out once, of its first text that has one."""
    said = ["第2包", "标3：x", "0", "第零包5", "包件十二", "7", "x7", "12345678901234567890", "標段一", "标段", "二十", "第3标包第4包", None, " 无 "]
    assert many(spark, lots.lot_number, said) == ["标段二", "标段三", None, "标段五", "标段十二", "标段七", None, None, None, None, "标段二十", "标段四", None, None]
    raw = [{"lotNumber": a, "lotName": b, "models": "m"} for a, b in (("0", "第2包"), ("x", "y"), ("9", "第2包"), (None, "10"), ("包一", None))]
    row = one(spark, lots.products(F.from_json(F.lit(json.dumps(raw)), lots.RAW_PRODUCTS)))
    assert [r.lotNumber for r in row] == ["标段二", "标段一", "标段九", "标段十", "标段一"]
    assert [r.x for r in spark.range(0, 11).select(lots.int_to_numeral(F.col("id")).alias("x")).collect()] == [None, *"一二三四五六七八九十"]


def test_groups_without_a_word_are_ok_first(spark):
    """the reason of stripped groups is that of the texts."""
    groups = [("", "", "", ""), ("中国", "", "", ""), ("中国", "浙江", "", ""), ("中国", "浙江省", "杭州市", ""), ("日本", "", "", ""), ("沪", "", "", ""), ("中国", "", "", "x"), ("中\x01国", "", "", ""), ("中国", "北京市", "杭州市", "")]
    rows = spark.createDataFrame([(i, *g) for i, g in enumerate(groups)], "i int, country string, province string, city string, district string")
    fields = [F.col(f) for f in address.FIELDS]
    got = rows.select("i", address.reason(*fields).alias("a"), address.reason_of(F.struct(*fields)).alias("b")).orderBy("i").collect()
    assert [r.a for r in got] == [r.b for r in got] == ["ok", "ok", "province_missing_suffix", "ok", "ok_non_cn", "country_abbrev", "district_missing_suffix", "country_illegal_chars", "municipality_city_mismatch"]


def test_bodies_without_html_are_not_parsed(spark):
    """what isn't HTML doesn't reach the parser."""
    made = str(sections.cleaned_body(F.col("b"))._jc.toString())
    assert "CaseWhen" in made.split("run(", 1)[1][:40]
    bodies = ["a < b", "<p>x</p>", "", None, "<script>y</script>", "<table><tr><td> a </td><td>b</td></tr></table>", "x <br> y"]
    cleaned = lambda c: text.strip(html.clean_flat_udf(c))
    whole = lambda c: F.when(text.looks_like_html(c) & (cleaned(c) != ""), cleaned(c)).otherwise(c)
    assert many(spark, sections.cleaned_body, bodies) == many(spark, whole, bodies)
