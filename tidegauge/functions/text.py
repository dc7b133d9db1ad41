"""Text rules: codes, names, scores, titles, numbers, fragments, canonical JSON."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.lake import normal_code, normal_direction  # noqa: F401  part of this module's surface

# Title categories in order of priority, with the direction each one implies.
TITLE_RULES = (
    ("业绩预增|预盈|扭亏|业绩快报.*(增长|上升)", "业绩预增", "利多"),
    ("业绩预减|预亏|首亏|业绩快报.*(下降|下滑)", "业绩预减", "利空"),
    ("回购", "股份回购", "利多"),
    ("增持", "股东增持", "利多"),
    ("减持", "股东减持", "利空"),
    ("诉讼|仲裁|处罚|立案|问询", "诉讼与监管", "利空"),
    ("分红|派息|利润分配", "分红派息", "利多"),
    ("中标|签订|合同", "中标与合同", "利多"),
    ("业绩预告", "业绩预告", None),
    ("资产重组|重大资产|收购|并购", "资产重组", None),
    ("定增|向特定对象发行|非公开发行|融资|可转债|配股", "融资定增", None),
    ("权益变动", "权益变动", None),
)


def title_class(title: Column) -> Column:
    """struct(category, direction) of the first rule that a title matches; none: both null."""
    out = F.struct(F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("direction"))
    for pattern, category, direction in reversed(TITLE_RULES):
        out = F.when(F.coalesce(title, F.lit("")).rlike(pattern), F.struct(F.lit(category).alias("category"), F.lit(direction).cast("string").alias("direction"))).otherwise(out)
    return out


def is_st(name: Column) -> Column:
    """A risk-warning name: ST or *ST, then a Han character, without regard to spaces and case."""
    return F.coalesce(F.upper(F.regexp_replace(name, r"[\s\x{3000}]+", "")).rlike(r"^\*?ST[\x{4e00}-\x{9fff}]"), F.lit(False))


def factor_score(raw: Column) -> Column:
    """The numeric score of JSON that was encoded once or twice; a boolean, text or anything malformed is null."""
    inner = F.coalesce(F.when(F.get_json_object(raw, "$").startswith("{"), F.get_json_object(raw, "$")), raw)
    score = F.get_json_object(inner, "$.score")
    typed = F.from_json(inner, "score variant")["score"]
    return F.when(F.schema_of_variant(typed).rlike("BIGINT|DECIMAL|DOUBLE|FLOAT"), score.try_cast("double"))


# Units of numbers, the longer ones first, and digits in their wide form.
UNITS = ("%", "‰", "亿元", "亿", "万元", "万", "元", "倍", "pp", "个基点")
WIDE_DIGITS, DIGITS = "０１２３４５６７８９％．", "0123456789%."


def _unmarked(line: Column) -> Column:
    """A line without the list mark that it may begin with: a number and 、 or ), a number and a full stop that no digit follows, a dash or dot and a blank."""
    head = F.ltrim(line)
    count = F.length(head) - F.length(F.regexp_replace(head, "^[0-9]+", ""))
    char = lambda n: F.substr(head, count + n, F.lit(1))
    numbered = (count > 0) & (char(1).isin("、", ")") | ((char(1) == ".") & ~char(2).rlike("[0-9]")))
    dotted = (count == 0) & char(1).isin("-", "*", "·") & char(2).isin(" ", "\t")
    return F.when(numbered | dotted, F.substr(head, count + 2, F.length(head))).otherwise(line)


def _number_parts(text: Column) -> Column:
    """array of struct(value, unit): digits in order, each with the unit that follows it, or an empty one."""
    lines = F.split(F.translate(text, WIDE_DIGITS, DIGITS), "\n")
    pieces = F.regexp_extract_all(F.array_join(F.transform(lines, _unmarked), "\n"), F.lit("[0-9]+([.][0-9]+)?[^0-9]*"), F.lit(0))
    value = lambda p: F.regexp_extract(p, "^[0-9]+([.][0-9]+)?", 0)
    rest = lambda p: F.regexp_replace(F.substr(p, F.length(value(p)) + 1, F.length(p)), r"^\s+", "")
    unit = lambda p: F.coalesce(F.get(F.filter(F.array(*map(F.lit, UNITS)), lambda u: F.startswith(rest(p), u)), F.lit(0)), F.lit(""))
    return F.transform(pieces, lambda p: F.struct(value(p).alias("value"), unit(p).alias("unit")))


def numbers_in(text: Column) -> Column:
    """Numbers with their unit, in order and without blanks; list marks at line starts don't count, full-width digits do."""
    return F.transform(_number_parts(text), lambda n: F.concat(n["value"], n["unit"]))


def unknown_numbers(text: Column, allowed: Column) -> Column:
    """Numbers of a text that are in ``allowed`` (an array) neither as they stand nor without their unit."""
    known = F.array_union(allowed, F.flatten(F.transform(allowed, lambda a: F.transform(_number_parts(a), lambda n: n["value"]))))
    found = F.filter(_number_parts(text), lambda n: ~F.array_contains(known, F.concat(n["value"], n["unit"])) & ~F.array_contains(known, n["value"]))
    return F.transform(found, lambda n: F.concat(n["value"], n["unit"]))


def embedding_text(title: Column, summary: Column, industries: Column, symbols: Column, event_type: Column, event_time: Column, direction: Column, importance: Column) -> Column:
    """A line of the title, one of what is known about the event, one of the summary; what is absent or blank leaves nothing."""
    told = lambda label, value: F.when(F.trim(value) != "", F.concat(F.lit(label), F.trim(value)))
    listed = lambda label, values: told(label, F.array_join(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""), "/"))
    head = F.concat_ws(" ", told("【类型】", event_type), told("【时间】", F.date_format(event_time, "yyyy-MM-dd")), told("【方向】", direction), told("【重要度】", F.when(importance.isNotNull(), F.format_string("%.1f", F.bround(importance.cast("double"), 1)))), listed("【行业】", industries), listed("【标的】", symbols))
    return F.concat_ws("\n", told("【标题】", title), F.nullif(head, F.lit("")), F.nullif(F.trim(summary), F.lit("")))


def phrase_hits(text: Column, phrases: tuple[str, ...], around: int = 12) -> Column:
    """array of struct(phrase, snippet) for each phrase that a text has: its first place, with some characters on both sides."""
    each = [F.struct(F.lit(p).alias("phrase"), F.instr(text, p).alias("at")) for p in phrases]
    found = F.filter(F.array(*each), lambda h: h["at"] > 0)
    begin = lambda h: F.greatest(F.lit(1), h["at"] - around)
    return F.transform(found, lambda h: F.struct(h["phrase"].alias("phrase"), F.substring(text, begin(h), h["at"] + F.length(h["phrase"]) + around - begin(h)).alias("snippet")))


def like_escaped(text: Column) -> Column:
    """A text as the inside of a LIKE pattern with the backslash as its escape."""
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def safe_url(url: Column) -> Column:
    """http and https addresses; anything else is null."""
    return F.when(F.lower(F.trim(url)).rlike("^https?://"), F.trim(url))


def leaks(query: Column, title: Column, size: int = 8) -> Column:
    """Whether a query gives its answer away: ``size`` characters in a row of the title, a six-digit code, or a date."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(title) - size + 1)), lambda i: F.substring(title, i, F.lit(size)))
    shared = F.exists(runs, lambda r: (F.length(r) == size) & F.contains(query, r))
    return F.coalesce(shared, F.lit(False)) | query.rlike(r"(?<!\d)\d{6}(?!\d)") | query.rlike(r"\d{4}[-/年]\d{1,2}")


def as_of(value: Column, zone: str = "Asia/Shanghai") -> Column:
    """A day or ISO instant as an instant in UTC (timestamp without zone): a day means its last second, no zone means ``zone``; anything else is null."""
    day = value.rlike(r"^\d{4}-\d{2}-\d{2}$")
    zoned = value.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & ~day
    local = F.to_utc_timestamp(F.when(day, F.concat(value, F.lit(" 23:59:59"))).otherwise(F.translate(value, "T", " ")).try_cast("timestamp_ntz"), zone)
    return F.when(zoned, F.to_utc_timestamp(value.try_cast("timestamp"), F.current_timezone())).otherwise(local).cast("timestamp_ntz")


def canonical_hash(*columns: str) -> Column:
    """SHA-256 of compact JSON with keys in order; dates in ISO form."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def fragments(names: DataFrame, longest: int = 8) -> DataFrame:
    """(symbol, name) → (fragment, symbol): every beginning and end of two to eight characters."""
    size = F.least(F.length("name"), F.lit(longest))
    both = F.flatten(F.transform(F.sequence(F.lit(2), size), lambda n: F.array(F.substr(F.col("name"), F.lit(1), n), F.substr(F.col("name"), F.length("name") - n + 1, n))))
    return names.where(F.length("name") >= 2).select("symbol", F.explode(F.array_distinct(both)).alias("fragment"))


def matched_names(texts: DataFrame, table: DataFrame, most: int = 3) -> DataFrame:
    """(text_id, text) × fragments → (text_id, fragment, symbols, ambiguous): fragments of a text that no longer hit contains."""
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), F.lit(8)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - n + 1)), lambda i: F.substr(F.col("text"), i, n)))))
    hits = texts.select("text_id", F.explode(grams).alias("fragment")).where(F.length("fragment") >= 2).distinct().join(table, "fragment").groupBy("text_id", "fragment").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))
    each = hits.groupBy("text_id").agg(F.collect_list("fragment").alias("all"))  # of one text
    longest = ~F.exists("all", lambda f: (f != F.col("fragment")) & f.contains(F.col("fragment")))
    return hits.join(each, "text_id").where(longest).select("text_id", "fragment", "symbols", (F.size("symbols") > most).alias("ambiguous"))


def normal_name(names: DataFrame, column: str, as_col: str) -> DataFrame:
    """NFKC form without white space and without the prefixes of a listing's first days or an ex-rights day; null gives "" (there is no built-in for that form)."""
    import unicodedata

    @F.pandas_udf("string")
    def folded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda s: "" if s is None else "".join(unicodedata.normalize("NFKC", s).split()))

    return names.withColumn(as_col, F.regexp_replace(folded(F.col(column)), r"^(?:XD|XR|DR|[NC])(?=[\x{4e00}-\x{9fff}])", ""))
