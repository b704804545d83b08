"""Administrative divisions: validation, fallback and parsing."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.functions.text import let, strip

# Short names that aren't accepted, divisions, their endings, and countries.
SHORT_NAMES = ["京", "津", "沪", "渝", "冀", "豫", "云", "辽", "黑", "湘", "皖", "鲁", "新", "苏", "浙", "赣", "鄂", "桂", "甘", "晋", "蒙", "陕", "吉", "闽", "贵", "粤", "青", "藏", "川", "蜀", "宁", "琼", "港", "澳", "台", "内蒙", "新疆", "广西", "宁夏"]
MUNICIPALITIES = ["北京市", "天津市", "上海市", "重庆市"]
BARE_MUNICIPALITIES = ["北京", "天津", "上海", "重庆"]
SPECIAL_REGIONS = ["香港特别行政区", "澳门特别行政区"]
AUTONOMOUS_REGIONS = ["内蒙古自治区", "广西壮族自治区", "宁夏回族自治区", "新疆维吾尔自治区", "西藏自治区"]
PROVINCES = ["北京市", "天津市", "上海市", "重庆市", "河北省", "山西省", "辽宁省", "吉林省", "黑龙江省", "江苏省", "浙江省", "安徽省", "福建省", "江西省", "山东省", "河南省", "湖北省", "湖南省", "广东省", "海南省", "四川省", "贵州省", "云南省", "陕西省", "甘肃省", "青海省", "台湾省", "内蒙古自治区", "广西壮族自治区", "西藏自治区", "宁夏回族自治区", "新疆维吾尔自治区", "香港特别行政区", "澳门特别行政区"]
FOREIGN_COUNTRIES = ["马尔代夫", "美国", "英国", "日本", "韩国", "俄罗斯", "法国", "德国", "新加坡", "澳大利亚", "加拿大", "意大利", "西班牙", "印度", "越南", "泰国", "印度尼西亚", "印尼", "菲律宾", "阿联酋", "沙特", "巴西", "墨西哥", "南非", "埃及", "土耳其", "瑞士", "荷兰", "比利时", "瑞典", "挪威", "芬兰", "丹麦", "新西兰"]
PROVINCE_ENDINGS, CITY_ENDINGS, DISTRICT_ENDINGS = "(省|市|自治区|特别行政区)$", "(市|州|盟|地区)$", "(区|县|市|旗)$"
CHINA, TAIWAN = "中国", "中国台湾"
FIELDS = ("country", "province", "city", "district")


def _illegal(c: Column) -> Column:
    return c.rlike(r"[\x00-\x1f]")


def _group(*fields: Column) -> Column:
    """The four fields as one value, stripped, so that rules that name them often compute them once."""
    return F.struct(*(strip(c).alias(f) for f, c in zip(FIELDS, fields, strict=True)))


def reason(country: Column, province: Column, city: Column, district: Column) -> Column:
    """ADR1: why a group isn't valid (the first reason), or ok / ok_non_cn."""
    return let(_group(country, province, city, district), reason_of)


def reason_of(group: Column) -> Column:
    """ADR1 of a struct of stripped FIELDS; most groups say nothing, so that is asked first."""
    own = {f: group[f] for f in FIELDS}
    out = F.when(own["country"].isin("", CHINA) & (own["province"] == "") & (own["city"] == "") & (own["district"] == ""), "ok")
    for name, c in own.items():
        out = out.when(_illegal(c), f"{name}_illegal_chars").when(c.isin(SHORT_NAMES), f"{name}_abbrev")
    country, province, city, district = own.values()
    free = province.isin(MUNICIPALITIES + SPECIAL_REGIONS + AUTONOMOUS_REGIONS + [TAIWAN])
    return (
        out.when((country != "") & (country != CHINA), "ok_non_cn")
        .when(province.contains("台湾") & (province != TAIWAN), "taiwan_must_be_cn_taiwan")
        .when((province == TAIWAN) & ~country.isin("", CHINA), "taiwan_country_must_be_cn")
        .when(province.isin(BARE_MUNICIPALITIES), "province_missing_suffix_municipality")
        .when((province != "") & ~free & ~province.rlike(PROVINCE_ENDINGS), "province_missing_suffix")
        .when(city.isin(BARE_MUNICIPALITIES), "city_missing_suffix_municipality")
        .when((city != "") & ~city.rlike(CITY_ENDINGS), "city_missing_suffix")
        .when((district != "") & ~district.rlike(DISTRICT_ENDINGS), "district_missing_suffix")
        .when(province.isin(MUNICIPALITIES) & (city != "") & (city != province), "municipality_city_mismatch")
        .otherwise("ok")
    )


def _sound(c: Column) -> Column:
    return ~_illegal(c) & ~c.isin(SHORT_NAMES)


def valid_country(country: Column) -> Column:
    """ADR2; an empty field is valid, here and below."""
    return _sound(strip(country))


def valid_province(country: Column, province: Column) -> Column:
    c, p = strip(country), strip(province)
    taiwan = ~p.contains("台湾") | (p == TAIWAN) & c.isin("", CHINA)
    named = p.isin(SPECIAL_REGIONS + AUTONOMOUS_REGIONS + [TAIWAN]) | p.rlike(PROVINCE_ENDINGS)
    return (p == "") | _sound(p) & taiwan & (~c.isin("", CHINA) | ~p.isin(BARE_MUNICIPALITIES) & named)


def valid_city(country: Column, city: Column) -> Column:
    c, x = strip(country), strip(city)
    return (x == "") | _sound(x) & (~c.isin("", CHINA) | ~x.isin(BARE_MUNICIPALITIES) & x.rlike(CITY_ENDINGS))


def valid_district(country: Column, district: Column) -> Column:
    c, x = strip(country), strip(district)
    return (x == "") | _sound(x) & (~c.isin("", CHINA) | x.rlike(DISTRICT_ENDINGS))


def settled(old: Column, new: Column) -> Column:
    """ADR3: of two groups (structs of FIELDS): each new field that is valid, else the old one; a
    municipality is its own city. Every step is computed once."""

    def with_country(x: Column) -> Column:
        country = F.when(valid_country(x["new"]["country"]), x["new"]["country"]).otherwise(x["old"]["country"])
        return let(F.struct(x["old"].alias("old"), x["new"].alias("new"), country.alias("country")), with_others)

    def with_others(x: Column) -> Column:
        of = lambda f, valid: F.when(valid(x["country"], x["new"][f]), x["new"][f]).otherwise(x["old"][f]).alias(f)
        return let(F.struct(x["old"]["city"].alias("old_city"), x["country"].alias("country"), of("province", valid_province), of("city", valid_city), of("district", valid_district)), agreed)

    def agreed(x: Column) -> Column:
        differs = x["province"].isin(MUNICIPALITIES) & (x["city"] != "") & (x["city"] != x["province"])
        city = F.when(differs, F.when(x["old_city"] != "", x["old_city"]).otherwise(x["province"])).otherwise(x["city"])
        country = F.when((x["province"] == TAIWAN) & ~x["country"].isin("", CHINA), CHINA).otherwise(x["country"])
        return F.struct(country.alias("country"), x["province"].alias("province"), city.alias("city"), x["district"].alias("district"))

    return let(F.struct(old.alias("old"), new.alias("new")), with_country)


def fallback(old: dict[str, Column], new: dict[str, Column]) -> dict[str, Column]:
    """ADR3 with fields as columns of their own."""
    both = settled(*(F.struct(*(g[f].alias(f) for f in FIELDS)) for g in (old, new)))
    return {f: both[f] for f in FIELDS}


def or_default(detail: Column, group: dict[str, Column]) -> dict[str, Column]:
    """ADR5: China alone where there is no address."""
    none = strip(detail) == ""
    return {k: F.when(none, CHINA if k == "country" else "").otherwise(c) for k, c in group.items()}


def _folded(x: str | None) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", (x or "").strip()) if not unicodedata.combining(c)).lower()


@F.pandas_udf(T.StringType())
def fold_place(s: pd.Series) -> pd.Series:
    """TXT15: lower case without diacritics."""
    return s.map(_folded)


@F.pandas_udf(T.ArrayType(T.StringType()))
def fold_places(s: pd.Series) -> pd.Series:
    """TXT15 of each of several texts."""
    return s.map(lambda xs: None if xs is None else [_folded(x) for x in xs])


def inferred_country(folded: Column) -> Column:
    """ADR4: the Philippines from hints in a folded place text, else ''."""
    hint = folded.contains("philippines") | folded.rlike(r"\b(brgy|barangay)\b") | folded.contains("laguna") & folded.contains("binan")
    return F.when(hint, "菲律宾").otherwise("")


def parse_detail(detail: Column) -> dict[str, Column]:
    """ADR6, JON6: country, province, city and district that an address names."""
    text = strip(detail)
    foreign = F.coalesce(*(F.when(text.contains(c), c) for c in FOREIGN_COUNTRIES))
    country = F.when(text == "", "").when(text.contains(CHINA) | text.contains("中华人民共和国"), CHINA).otherwise(F.coalesce(foreign, F.lit(CHINA)))
    home = country == CHINA
    province = F.coalesce(*(F.when(text.contains(p), p) for p in sorted(PROVINCES, key=len, reverse=True)), F.lit(""))
    rest = lambda mark: F.when((mark != "") & (F.position(mark, text) > 0), F.substr(text, F.position(mark, text) + F.length(mark)))
    first = lambda c, pattern: F.coalesce(F.regexp_extract(c, pattern, 1), F.lit(""))
    near = first(rest(province), "^(.{1,20}?(?:市|自治州|地区|盟))")
    city = F.when(province.isin(MUNICIPALITIES), province).otherwise(F.when(near != "", near).otherwise(first(text, "(.{1,20}?(?:市|自治州|地区|盟))")))
    district = first(rest(city), "^(.{1,20}?(?:区|县|旗))")
    return {"country": country, "province": F.when(home, province).otherwise(""), "city": F.when(home, city).otherwise(""), "district": F.when(home, district).otherwise("")}
