"""Operator 8: URL filters from association rules.

Fixed rules (host, path) come first: a rule fits its host and all subdomains if the url's path starts
with the rule's; the longest one decides. Other urls are judged by rules mined from labels: Spark's
FP-growth finds combinations of url tokens that go with bad pages. Tokens say where they stand:
`h:` labels of the host and its registered-name pairs, `p:` parts of the path without numbers, `q:`
names of query parameters. A mined rule holds if at least MIN_BAD labelled pages that it fits are bad,
however many are labelled, and its confidence reaches MIN_CONFIDENCE; one that a shorter rule with no less confidence already covers is
dropped. Rules are matched by inverted index: tokens of a url -> rules that hold this token (the
rarest of the rule) -> all of the rule's tokens present. A url that any rule fits is blocked.

Rules have any number of tokens. Mining takes only tokens that MIN_BAD bad pages have, as every rule's
must, and tokens that stand on exactly the same labelled pages as one class: any of a class's tokens
makes the same rules, so a url with many parameters that always come together costs no more than one
with a single parameter. What grows is the number of classes that pages share: FP-growth ranks them on
the driver, and its work grows with the combinations of classes that MIN_BAD bad pages share, which
without a limit on a rule's length can be many where as many classes come in all mixtures.

A rule is matched class by class: a url fits if it has one token of each. The rules left are sent
along with the matching if their tokens take no more than MAX_RULES rules of MAX_TOKENS
tokens of TOKEN_BYTES would; else matching joins them by
their rarest class.

What is learned from: a page that a fixed rule decides has the rule's verdict as its label, as that is
known of its url; any other has that of its text, if there is one. Rules so carry what the fixed ones
say of some hosts over to urls of other hosts that look like theirs.

Defined results: a null url or one without `://` has empty host and path, no rule and no tokens: it
is allowed. Without labels nothing is mined. Labels are of documents; a label counts for the page whose
page_id equals its doc_id, and one without such a page for nothing. Rows that repeat give repeated results; a null page_id
stays null and counts for nothing in mining.
"""

from __future__ import annotations

from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, materialize

MIN_BAD, MIN_CONFIDENCE = 5, 0.8
#: The size of an index that is broadcast, as that of so many rules of so many tokens; no rule is left out
#: for its length or their number.
MAX_RULES, MAX_TOKENS, TOKEN_BYTES = 50_000, 3, 64
BAD = "label:bad"

#: (verdict, host, path), as the contract fixes them.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The fixed rule that decides, as host and path, and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):  # the longest is asked first
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    pairs = F.when(F.size(labels) > 2, F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.concat(F.lit("h:"), F.element_at(labels, i), F.lit("."), F.element_at(labels, i + 1)))).otherwise(F.array().cast("array<string>"))
    parts = F.filter(F.split(F.lower(path), r"[/._-]+"), lambda x: (x != "") & ~x.rlike("^[0-9]+$"))
    query = F.regexp_extract(url, r"(?s)^[^#?]*\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(F.lower(query), "&"), lambda x: F.split(x, "=")[0]), lambda x: x != "")
    tag = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(kind), x))
    return F.coalesce(F.array_distinct(F.concat(tag("h:", labels), pairs, tag("p:", parts), tag("q:", names))), F.array().cast("array<string>"))


def mine_classes(labelled: DataFrame, min_support: float = 0.0, min_confidence: float = MIN_CONFIDENCE, min_bad: int = MIN_BAD) -> DataFrame | None:
    """labelled: tokens and bad (boolean). Rules: rule (sorted first tokens of its classes), parts (the
    tokens of each class), rarest (those of its rarest class), support, confidence; None without any.
    A rule rests on min_bad bad pages at least, and on a share min_support of the pages."""
    pages = materialize(labelled.filter(F.size("tokens") > 0).select(F.array_distinct("tokens").alias("tokens"), "bad").withColumn("page", F.monotonically_increasing_id()), "labelled-pages")
    n = pages.count()
    least = max(min_bad, ceil(min_support * n))
    each = pages.select("page", "bad", F.explode("tokens").alias("token"))
    on = lambda seed: F.bit_xor(F.xxhash64("page", F.lit(seed)))
    tokens_ = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"), on(1).alias("x"), on(2).alias("y")).filter(F.col("n_bad") >= least)
    classes = tokens_.groupBy("n", "x", "y").agg(F.array_sort(F.collect_list("token")).alias("members"))
    classes = materialize(classes.select(F.element_at("members", 1).alias("token"), "members", "n"), "classes")
    baskets = each.join(classes.select("token"), "token").groupBy("page", "bad").agg(F.collect_list("token").alias("items"))
    baskets = materialize(baskets.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items")), "baskets")
    used = baskets.count()
    if not used:
        return None
    found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / used, minConfidence=min_confidence).fit(baskets)
    rules = found.associationRules.filter((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD))
    rules = materialize(rules.select(F.array_sort("antecedent").alias("rule"), (F.col("support") * used / n).alias("support"), "confidence"), "rules")
    held = rules.withColumn("token", F.explode("rule")).join(classes, "token").groupBy("rule", "support", "confidence")
    rules = held.agg(F.transform(F.array_sort(F.collect_list(F.struct("token", "members"))), lambda x: x["members"]).alias("parts"), F.min_by("members", F.struct("n", "token")).alias("rarest"))
    rules = materialize(rules, "rules")
    short = rules.select(F.col("rule").alias("part"), F.col("confidence").alias("c"), F.element_at("rarest", 1).alias("token"))  # one token finds all that hold it
    longer = rules.filter(F.size("rule") > 1).select("rule", "confidence", F.explode("rule").alias("token"))
    covered = longer.join(short, "token").filter((F.size("part") < F.size("rule")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("part", "rule")) == 0)).select("rule").distinct()
    return materialize(rules.join(covered, "rule", "left_anti"), "rules")


def mine(labelled: DataFrame, **options: float) -> DataFrame:
    """The rules token by token: rule (sorted tokens), support, confidence."""
    rules = mine_classes(labelled, **options)
    if rules is None:
        return labelled.sparkSession.createDataFrame([], "rule array<string>, support double, confidence double")
    one_of_each = F.aggregate("parts", F.array(F.array().cast("array<string>")), lambda out, members: F.flatten(F.transform(out, lambda r: F.transform(members, lambda m: F.concat(r, F.array(m))))))
    return rules.select(F.explode(one_of_each).alias("rule"), "support", "confidence").withColumn("rule", F.array_sort("rule"))


def blocked_by(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (with tokens) and a column blocked: whether any rule fits. The index goes to the pages
    if it is small; otherwise urls, each once, go to the index."""
    index = materialize(rules.select(F.explode("rarest").alias("token"), "parts"), "index")
    size = index.agg(F.sum(F.octet_length(F.array_join(F.flatten("parts"), " ")))).first()[0] or 0
    if size <= MAX_RULES * MAX_TOKENS * TOKEN_BYTES:
        index = F.broadcast(index)
    urls = pages.select("url", "tokens").filter(F.size("tokens") > 0).distinct()
    fits = F.forall("parts", lambda members: F.arrays_overlap(members, F.col("tokens")))
    hits = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token").filter(fits)
    hits = hits.select(F.col("url").alias("_url")).distinct()
    return pages.join(hits, F.col("url") == F.col("_url"), "left").withColumn("blocked", F.col("_url").isNotNull())


def with_labels(source: DataFrame, labels: DataFrame, label_id: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """The pages that something is known of: page_id, tokens and bad. source: page_id, host, path and
    tokens; a page is bad if its fixed rule blocks it or, without one, if toxic is 1 or quality is 0."""
    known = labels.select(F.col(label_id).alias("page_id"), ((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("_bad")).filter("page_id is not null").groupBy("page_id").agg(F.max("_bad").alias("_bad"))
    _, verdict = fixed(F.col("host"), F.col("path"), rules)
    joined = source.filter("page_id is not null").join(known, "page_id", "left")
    return joined.select("page_id", "tokens", F.coalesce(verdict == "block", "_bad").alias("bad")).filter("bad is not null")


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", rules: list[tuple[str, str, str]] = RULES, **options: float) -> DataFrame:
    """A row for each row of pages: page_id, host, path, rule, verdict. labels: label_id with quality
    and toxic."""
    source = parsed(pages, id_col, url_col)
    mined = mine_classes(materialize(with_labels(source, labels, label_id, rules).select("tokens", "bad"), "labelled"), **options)
    out = source.withColumn("blocked", F.lit(False)) if mined is None or mined.isEmpty() else blocked_by(source, mined)
    rule, verdict = fixed(F.col("host"), F.col("path"), rules)
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, host, path, tokens."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    source = columns(pages, page_id=id_col, url=url_col).withColumn("host", host).withColumn("path", path)
    return source.withColumn("tokens", F.when(F.col("host") != "", tokens(F.col("url"), F.col("host"), F.col("path"))).otherwise(F.array().cast("array<string>")))
