"""URL rules indexed by their rarest literal token, in DataFrame expressions only.

A rule names a host and the beginning of a path. Of the literal tokens that every matching URL must have, the one that
the fewest URLs have indexes the rule. A URL's tokens fetch the rules that wait under them, and only those rules'
regular expressions run.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import staged

#: Up to so many rules are looked up in a literal within the row; more are a table that is joined.
INLINE_RULES = 1000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """Matches host + newline + path."""
        return f"^(?:[^\\n]*\\.)?{re.escape(self.host)}\\n{re.escape(self.path)}"

    @property
    def tokens(self) -> list[str]:
        """Host labels and those path words that the rule itself ends, so that a URL has them whole."""
        ends = re.findall(r"[0-9A-Za-z]+(?=[^0-9A-Za-z])", self.path)
        return sorted({*re.findall(r"[0-9a-z]+", self.host), *ends})


#: The rules of the query.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path then up to ``?``, ``#`` or the end.

    Null, or no ``://``: both empty.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.concat(host, F.lit("\n"), path), F.lit("[0-9A-Za-z]+"), F.lit(0)))


def rarest_tokens(parts: DataFrame, rules: tuple[Rule, ...]) -> list[tuple[str | None, Rule]]:
    """The token that indexes each rule: of its literal ones, that which the fewest URLs have (None: it has no literal token).

    Only the rules' own tokens are counted, over all URLs.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return [(None, r) for r in rules]
    known = F.array(*[F.lit(t) for t in wanted])
    counted = parts.select(F.explode(F.array_intersect(_tokens(F.col("host"), F.col("path")), known)).alias("token")).groupBy("token").count()
    have = {r["token"]: r["count"] for r in counted.collect()}  # one row for each of the rules' own tokens at most
    return [(min(r.tokens, key=lambda t: (have.get(t, 0), t)) if r.tokens else None, r) for r in rules]


def _best(fits: Column) -> Column:
    """Of rules that fit, the longest; of equally long ones the greatest verdict (``block`` over ``allow``), then the first by name."""
    return F.reduce(
        fits,
        F.lit(None).cast("struct<n:int,verdict:string,rule:string>"),
        lambda a, x: F.when(
            a.isNull() | (x["n"] > a["n"]) | ((x["n"] == a["n"]) & ((x["verdict"] > a["verdict"]) | ((x["verdict"] == a["verdict"]) & (x["rule"] < a["rule"])))),
            x,
        ).otherwise(a),
    )


def _inline(parts: DataFrame, indexed: list[tuple[str | None, Rule]]) -> DataFrame:
    entry = lambda r: F.struct(F.lit(len(r.name)).alias("n"), F.lit(r.verdict).alias("verdict"), F.lit(r.name).alias("rule"), F.lit(r.pattern).alias("pattern"))
    by: dict[str | None, list[Rule]] = {}
    for token, rule in indexed:
        by.setdefault(token, []).append(rule)
    always = F.array(*[entry(r) for r in by.pop(None, [])]) if None in by else None
    found = None
    if by:
        index = F.create_map(*[x for t, rs in by.items() for x in (F.lit(t), F.array(*[entry(r) for r in rs]))])
        met = F.array_intersect(_tokens(F.col("host"), F.col("path")), F.array(*[F.lit(t) for t in by]))
        found = F.flatten(F.transform(met, lambda t: F.element_at(index, t)))
    candidates = found if always is None else always if found is None else F.concat(always, found)
    if candidates is None:
        return parts.withColumn("best", F.lit(None).cast("struct<n:int,verdict:string,rule:string>"))
    target = F.concat(F.col("host"), F.lit("\n"), F.col("path"))
    fits = F.filter(candidates, lambda c: F.regexp(target, c["pattern"]))
    return parts.withColumn("best", _best(F.transform(fits, lambda c: F.struct(c["n"], c["verdict"], c["rule"]))))


def _joined(parts: DataFrame, indexed: list[tuple[str | None, Rule]]) -> DataFrame:
    """Rules as a table: Spark broadcasts it where its size is under the session's limit and shuffles otherwise."""
    spark = parts.sparkSession
    rows = [(t, len(r.name), r.verdict, r.name, r.pattern) for t, r in indexed]
    index = spark.createDataFrame(rows, "token string, n int, verdict string, rule string, pattern string")
    known = staged(parts.withColumn("__row", F.monotonically_increasing_id()), "urls")
    target = F.concat("host", F.lit("\n"), "path")
    tokens = known.select("__row", target.alias("target"), F.explode(F.concat(_tokens(F.col("host"), F.col("path")), F.array(F.lit("")))).alias("token"))
    fits = tokens.join(index.withColumn("token", F.coalesce("token", F.lit(""))), "token").where("regexp(target, pattern)")
    rank = F.struct("n", F.col("verdict").alias("b"), F.transform(F.split("rule", ""), lambda c: -F.ascii(c)).alias("order"), "verdict", "rule")
    best = fits.groupBy("__row").agg(F.max(rank).alias("m")).select("__row", F.struct(F.col("m.n").alias("n"), F.col("m.verdict").alias("verdict"), F.col("m.rule").alias("rule")).alias("best"))
    return known.join(best, "__row", "left").drop("__row")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, otherwise: str = "allow", inline_rules: int = INLINE_RULES) -> DataFrame:
    """Judges each row's URL: page_id, host, path, rule (the longest that fits, or null), verdict (its, or ``otherwise``).

    A rule fits its host and all subdomains, where the URL's path starts with the rule's.

    * A null URL, or one without ``://``, has an empty host and path; no rule fits it.
    * Rows that repeat are judged each; ids are passed on as they are. An empty table gives no rows.
    * Other columns aren't looked at; URLs of any length are read whole.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    indexed = rarest_tokens(parts, rules)
    judged = _inline(parts, indexed) if len(rules) <= inline_rules else _joined(parts, indexed)
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
