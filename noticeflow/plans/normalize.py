"""From source documents and recorded answers to records: the normalise and crawl plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeflow import catalog
from noticeflow.functions import address, category, dates, hashing, jsonx, lots, scan, sections, text, types
from noticeflow.functions.pieces import reading
from noticeflow.operators import attempts

STAGES = ("meta", "contacts", "address_detail", "lots")
# How a notice can end, in the order in which it is decided.
OUTCOMES = ["not_on_detail_page", "skipped_duplicate", "extract_content_empty", "skipped_non_gongchengjixie", "skipped_invalid_announcement_type", "success"]


def _gathered(responses: DataFrame, key: str, stages: tuple[str, ...], besides: tuple[str, ...] = (), repairs: tuple[str, ...] = ()) -> DataFrame:
    """All answers that count, in one aggregation: a row a key with _<stage>, the first answer's payload,
    of each of stages and besides; _said_<stage>, the payloads of attempts 1 to the stage's last in order, of
    each of repairs; and _cut, whether an input of stages was cut. Equal attempts are settled by the
    smaller payload. State is of fixed size, but for answers by position (product_category), which
    are as many as a notice has rows."""
    stage, attempt, payload = F.col("stage"), F.col("attempt"), F.coalesce("payload", F.lit(""))
    first = lambda s: F.min(F.when(stage == s, F.struct(attempt, payload.alias("payload"))))["payload"].alias(f"_{s}")
    firsts = tuple(dict.fromkeys((*stages, *besides)))
    aggs = [first(s) for s in firsts]
    for s in repairs:
        if s == "product_category":
            aggs.append(F.array_sort(F.collect_set(F.when(stage == s, F.struct(attempt.cast("int").alias("pos"), payload.alias("payload"))))).alias(f"_said_{s}"))
        else:
            each = (F.min(F.when((stage == s) & (attempt == i), payload)) for i in range(1, attempts.MAX_ATTEMPTS[s] + 1))
            aggs.append(F.array_compact(F.array(*each)).alias(f"_said_{s}"))
    if "input_truncated" in responses.columns:
        aggs.append(F.max(F.when(stage.isin(*stages), F.col("input_truncated"))).alias("_cut"))
    return responses.filter(stage.isin(*firsts, *repairs) & attempt.isNotNull()).groupBy(key).agg(*aggs)


def staged(docs: DataFrame, responses: DataFrame, key: str = "doc_id", own: list[catalog.Field] | None = None, besides: tuple[str, ...] = (), repairs: tuple[str, ...] = ()) -> DataFrame:
    """JON9, PRJ4: documents with the raw fields of every stage, from each stage's first answer in
    one aggregation; missing answers leave nulls. Flags of cut inputs are ORed (AGG2). own: another
    catalog, whose stages are its own. besides, repairs: other stages, whose answers stay as they are
    in _<stage> and _said_<stage> for the steps that follow."""
    stages = STAGES if own is None else tuple(dict.fromkeys(f.stage for f in own))
    joined = docs.join(_gathered(responses, key, stages, besides, repairs), key, "left")
    cut = F.coalesce(F.col("_cut"), F.lit(False)) if "_cut" in joined.columns else F.lit(False)
    read = joined.withColumns({f"_{s}": F.from_json(jsonx.lenient_object(F.col(f"_{s}")), catalog.raw_schema(s, own)) for s in stages})
    fields = [catalog.coerced(f, F.col(f"_{f.stage}.{f.key}")).alias(f.key) for f in catalog.fields(own=own) if f.stage in stages]
    return read.select(*docs.columns, cut.alias("inputTruncated"), *fields, *(f"_{s}" for s in besides), *(f"_said_{s}" for s in repairs))


def with_categories(items: DataFrame, terms: DataFrame, key: str = "doc_id", lookup_bytes: int = category.AUTOMATON_BYTES) -> DataFrame:
    """CAT2-4: the category of each product: the table's exact term, else the recorded answer of its
    place. Rows stay arrays of their notice, with the terms sent along; a table of more than
    lookup_bytes is joined instead."""
    look = category.lookup(terms, lookup_bytes)
    if look is None:
        return _joined_categories(items, terms, key)
    said, subjects = F.col("_said_product_category"), F.transform("lotProducts", lambda p: category.folded(p["subjects"]))
    found = items.withColumn("_c", look(subjects, said["pos"], said["payload"]))

    def row(p: Column, i: Column) -> Column:
        at = lambda name: F.get(F.col(f"_c.{name}"), i)
        return p.withField("productCategory", category.settled(at("term"), at("answer"), at("known")))

    return found.withColumn("lotProducts", F.coalesce(F.transform("lotProducts", row), F.array().cast(f"array<{lots.PRODUCT}>"))).drop("_c", "_said_product_category")


def _joined_categories(items: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    rows = items.select(key, F.posexplode_outer("lotProducts").alias("pos", "p")).withColumn("subject", F.col("p.subjects"))
    first = items.select(key, F.explode("_said_product_category").alias("a")).groupBy(key, F.col("a.pos").alias("pos")).agg(F.min("a.payload").alias("payload"))
    found = category.exact_term(rows, terms).join(first.select(key, "pos", F.get_json_object("payload", "$.productCategory").alias("answer")), [key, "pos"], "left")
    found = found.join(terms.select(F.col("term").alias("answer"), F.lit(True).alias("known")).distinct(), "answer", "left")
    chosen = category.settled(F.col("matched_term"), F.col("answer"), F.coalesce("known", F.lit(False)))
    merged = found.filter("pos is not null").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("p").withField("productCategory", chosen).alias("p")))).alias("_rows"))
    done = items.drop("_said_product_category").join(merged, key, "left")
    return done.withColumn("lotProducts", F.coalesce(F.transform("_rows", lambda r: r["p"]), F.array().cast(f"array<{lots.PRODUCT}>"))).drop("_rows")


def with_type(items: DataFrame) -> DataFrame:
    """EXT6: a type that isn't one of the known is repaired by the first recorded answer that is."""
    answers = F.transform("_said_type_repair", lambda p: types.announcement_type(F.get_json_object(p, "$.announcementType")))
    repaired = F.coalesce(F.get(F.array_compact(answers), F.lit(0)), F.lit(""))
    return items.withColumn("announcementType", F.when(F.col("announcementType") != "", F.col("announcementType")).otherwise(repaired)).drop("_said_type_repair")


def with_amount(items: DataFrame) -> DataFrame:
    """EXT7, A.10: the estimated range, of the first answer that is one, else the first one."""
    said = F.col("_said_estimated_amount")
    answer = F.coalesce(F.get(F.filter(said, attempts.is_range), F.lit(0)), F.get(said, F.lit(0)))
    clue = attempts.price_clue(F.col("winnerAmount"), F.col("lotCandidates"))
    current = F.col("estimatedAmount") if "estimatedAmount" in items.columns else F.lit("")
    value = attempts.settled_range(current, clue, F.col("budgetAmount"), F.size(lots.effective(F.col("lotProducts"))), answer)
    return items.withColumn("estimatedAmount", value).drop("_said_estimated_amount")


def with_divisions(items: DataFrame) -> DataFrame:
    """EXT4, AGG6, A.7: divisions of the three addresses: the first attempt of which all groups are
    valid, else the last one's fields where they are valid; China alone where there is no address.
    A notice's attempts and groups are arrays (_tries: attempts of groups), so nothing is shuffled."""
    groups = ("buyer", "project", "delivery")
    name = lambda g, f: f"{g}{f.capitalize()}"
    schema = ", ".join(f"{name(g, f)} string" for g in groups for f in address.FIELDS)
    group = lambda s: F.struct(*(s[f].alias(f) for f in address.FIELDS))
    detail = lambda j: F.get(F.col("_details"), j)
    at_home = F.struct(*(F.lit(address.CHINA if f == "country" else "").alias(f) for f in address.FIELDS))

    def read(payload: Column) -> Column:
        raw = F.from_json(jsonx.lenient_object(payload), schema)
        return text.let(raw, lambda r: F.array(*(F.struct(*(r[name(g, f)].alias(f) for f in address.FIELDS)) for g in groups)))

    def defaulted(s: Column, j: Column) -> Column:
        said = F.struct(*(text.strip(s[f]).alias(f) for f in address.FIELDS))
        return F.when(text.strip(detail(j)) == "", at_home).otherwise(said)  # ADR5, asked once for the four

    out = items.withColumns({"_details": F.array(*(F.col(f"{g}AddressDetail") for g in groups)), "_tries": F.transform("_said_address_admin", read)})
    out = out.withColumn("_tries", F.transform("_tries", lambda t: F.transform(t, defaulted)))
    places = F.transform("_tries", lambda t: F.transform(t, lambda s, j: F.concat_ws(" ", detail(j), s["province"], s["city"], s["district"])))
    out = out.withColumn("_places", address.fold_places(F.flatten(places)))

    def hinted(t: Column, a: Column) -> Column:
        def one(s: Column, j: Column) -> Column:
            hint = address.inferred_country(F.get(F.col("_places"), a * len(groups) + j))
            country = F.when(s["country"].isin("", address.CHINA) & (hint != ""), hint).otherwise(s["country"])
            return F.struct(country.alias("country"), *(s[f].alias(f) for f in address.FIELDS[1:]))

        return F.transform(t, one)

    out = out.withColumn("_tries", F.transform("_tries", hinted))
    valid = lambda s: F.startswith(address.reason_of(s), F.lit("ok"))
    first = F.get(F.filter("_tries", lambda t: F.forall(t, valid)), F.lit(0))
    out = out.withColumns({"_first": first, "_last": F.get(F.col("_tries"), F.size("_tries") - 1)})
    empty = F.struct(*(F.lit("").alias(f) for f in address.FIELDS))
    blank = lambda s: F.struct(*(F.coalesce(s[f], F.lit("")).alias(f) for f in address.FIELDS))

    def place(d: Column, j: Column) -> Column:
        backed = text.let(address.settled(empty, blank(F.get(F.col("_last"), j))), lambda b: F.struct(*(c.alias(f) for f, c in address.or_default(d, {f: b[f] for f in address.FIELDS}).items())))
        return F.coalesce(F.get(F.col("_first"), j), group(backed))

    out = out.withColumn("_placed", F.transform("_details", place))
    settled = {name(g, f): F.coalesce(F.get(F.col("_placed"), F.lit(j))[f], F.lit("")) for j, g in enumerate(groups) for f in address.FIELDS}
    kept = [c for c in items.columns if c not in (*settled, "_said_address_admin")]
    # As one generated row, the fields are those of one value; as columns each would hold the whole rule.
    return out.select(*kept, F.inline(F.array(F.struct(*(c.alias(n) for n, c in settled.items())))))


#: Stages that complete a record.
REPAIRS = ("product_category", "type_repair", "estimated_amount", "address_admin")


def _finished(items: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    done = items.withColumn("lotProducts", lots.supplemented(F.col("lotProducts"), F.col("lotCandidates")))
    for s in REPAIRS:  # none at all, where a notice has no answers
        done = done.withColumn(f"_said_{s}", F.coalesce(f"_said_{s}", F.array()))
    done = with_categories(done, terms, key)
    return with_divisions(with_amount(with_type(done)))


def normalize(sources: DataFrame, responses: DataFrame, terms: DataFrame, key: str = "doc_id", strict: bool = False) -> DataFrame:
    """The normalise plan: sources (key, source_text) to records with outcome_code; strict fails on
    a notice without a known type (PRJ16)."""
    docs = sources.withColumn("_parts", sections.sections(F.col("source_text")))
    docs = docs.select(key, sections.title(F.col("_parts")).alias("_head"), sections.cleaned_body(sections.body(F.col("_parts"))).alias("_body"))
    items = staged(docs, responses, key, besides=("title",), repairs=REPAIRS)
    given = lambda new, old: F.coalesce(F.nullif(text.strip(new), F.lit("")), old)
    items = items.withColumn("projectName", given(F.get_json_object("_title", "$.projectName"), F.col("projectName"))).withColumn("announcementName", F.col("_head")).withColumn("announcementContent", F.col("_body"))
    done = _finished(items, terms, key).withColumn("outcome_code", F.when(F.col("announcementType") == "", "skipped_invalid_announcement_type").otherwise("success"))
    if strict:
        done = done.withColumn("announcementType", F.when(F.col("announcementType") == "", F.raise_error(F.lit("no known announcement type"))).otherwise(F.col("announcementType")))
    return hashing.with_data_id(catalog.conform(done.withColumnRenamed(key, "doc_id")))


def extracted(sources: DataFrame, responses: DataFrame, own: list[catalog.Field], key: str = "doc_id") -> DataFrame:
    """SRC17: records of another catalog (catalog.fields_from_yaml): its fields from its stages' first
    answers, each coerced by its type, after the title and body of the source; a type of notice is
    repaired where the catalog has one, and rows of lots are completed where it has both kinds."""
    docs = sources.withColumn("_parts", sections.sections(F.col("source_text")))
    docs = docs.select(key, sections.title(F.col("_parts")).alias("announcementName"), sections.cleaned_body(sections.body(F.col("_parts"))).alias("announcementContent"))
    have = {f.key for f in own}
    items = staged(docs, responses, key, own, repairs=("type_repair",) if "announcementType" in have else ())
    if {"lotProducts", "lotCandidates"} <= have:
        items = items.withColumn("lotProducts", lots.supplemented(F.col("lotProducts"), F.col("lotCandidates")))
    if "announcementType" in have:
        items = with_type(items)
    return hashing.with_data_id(catalog.conform(items.withColumnRenamed(key, "doc_id"), own))


def _settled_pages(known: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """JON1, WIN1 after content: key, _content and _fresh of the pages whose key isn't in the ledger.
    A page counts as seen once it has content, so one that arrives empty leaves its key to the next.
    Only these pages' HTML is parsed, each once."""
    new = known.join(ledger.select("detail_key").distinct(), "detail_key", "left_anti").select(key, "detail_key", "arrival", "html")
    parsed = reading(new, "html", lambda x: (scan.page_content(x),), "_content string").withColumn("_content", text.strip(F.col("_content")))
    earlier = W.partitionBy("detail_key").orderBy("arrival", key).rowsBetween(W.unboundedPreceding, -1)
    return parsed.select(key, "_content", (F.coalesce(F.count_if(F.col("_content") != "").over(earlier), F.lit(0)) == 0).alias("_fresh"))


def _without_rejected(responses: DataFrame, key: str) -> DataFrame:
    """PRJ13: answers without those of rejected pages' later stages, so that their contacts, addresses,
    lots and repairs are never read, ranked or joined. A page is rejected if the first machinery answer
    says no and its first meta answer names a project; both come from the answers alone."""
    early = ("meta", "machinery")
    first = lambda s: F.min_by(F.when(F.col("stage") == s, F.col("payload")), F.when(F.col("stage") == s, F.col("attempt")))
    told = responses.filter(F.col("stage").isin(*early)).groupBy(key).agg(first("meta").alias("_meta"), first("machinery").alias("_machine"))
    named = text.fold_empty(F.get_json_object(jsonx.lenient_object(F.col("_meta")), "$.projectName")) != ""
    rejected = told.filter((F.lower(F.get_json_object("_machine", "$.isMachinery")) == "false") & named).select(key)
    later = responses.filter(~F.col("stage").isin(*early)).join(rejected, key, "left_anti")
    return responses.filter(F.col("stage").isin(*early)).unionByName(later)


def crawl(pages: DataFrame, responses: DataFrame, terms: DataFrame, ledger: DataFrame, machinery_only: bool = False, key: str = "doc_id") -> DataFrame:
    """The crawl plan: pages (key, url, list_url, title, list_date, html, arrival) to records. Every
    page keeps a row; outcome_code says how it ended (PRJ15), in the order of OUTCOMES. Rejected pages
    hold what the meta stage said of them."""
    if machinery_only:
        responses = _without_rejected(responses, key)
    listed, file_date = dates.normalize_date(F.col("list_date")), dates.file_date(F.col("list_date"))
    known = pages.withColumn("detail_key", jsonx.detail_key(F.col("url"), F.col("title"), file_date)).withColumn("_list", jsonx.on_list_page(F.col("url"), F.col("list_url")))
    settled = _settled_pages(known.filter(~F.col("_list")), ledger, key)
    docs = known.drop("html").join(settled, key, "left").withColumn("_fresh", F.coalesce("_fresh", F.lit(False))).withColumn("_content", F.when(F.col("_fresh"), F.col("_content")))
    items = staged(docs.select(key, "url", "title", "list_date", "detail_key", "_list", "_fresh", "_content"), responses, key, besides=("machinery",), repairs=REPAIRS)
    items = items.withColumn("announcementUrl", F.col("url")).withColumn("announcementName", F.col("title")).withColumn("announcementContent", F.coalesce("_content", F.lit("")))
    items = items.withColumn("announcementDate", F.when(F.col("announcementDate") == "", listed).otherwise(F.col("announcementDate")))
    done = _finished(items, terms, key)
    skip = F.lit(machinery_only) & (F.lower(F.get_json_object("_machinery", "$.isMachinery")) == "false") & (F.col("projectName") != "")  # unknown is kept (PRJ14)
    outcome = F.when(F.col("_list"), OUTCOMES[0]).when(~F.col("_fresh"), OUTCOMES[1]).when(F.col("announcementContent") == "", OUTCOMES[2]).when(skip, OUTCOMES[3]).when(F.col("announcementType") == "", OUTCOMES[4]).otherwise(OUTCOMES[5])
    done = done.withColumn("outcome_code", outcome).withColumnRenamed(key, "doc_id")
    return hashing.with_data_id(catalog.conform(done))


def ledger_of(crawled: DataFrame) -> DataFrame:
    """The keys that later runs skip: notices that were kept or rejected for good."""
    return crawled.filter(F.col("outcome_code").isin(OUTCOMES[3], OUTCOMES[4], OUTCOMES[5])).select("detail_key").distinct()


def merged_flag(*flags: Column) -> Column:
    """AGG2"""
    out = F.lit(False)
    for f in flags:
        out |= F.coalesce(f, F.lit(False))
    return out
