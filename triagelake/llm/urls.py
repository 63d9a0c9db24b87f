"""URL filters: pattern rules fetched by their rarest literal token.

A rule is a wildcard pattern over ``host + path`` of a URL: ``*`` stands for
anything, ``||`` in front anchors at the host or one of its subdomains, and a
rule without it may begin anywhere; every rule is a prefix at its end.  A
token is a run of letters and digits.  Each rule is filed under the rarest,
in the URLs at hand, of the tokens that any matching URL must hold whole; a
URL's tokens fetch candidate rules and only those run their regular
expression.  A rule without such a token is a candidate for every URL.

Verdict: the longest matching base rule decides; without one, a matching
pattern rule blocks; else the URL is allowed.

Defined results: NULL URLs and URLs without ``://`` have empty host and path,
match nothing and are allowed; repeated rows are judged alike, each by
itself; an empty table gives no rows; columns named like the added ones are
replaced by them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.names import fresh

# Base rules of the result, (verdict, rule), host before path.
BASE_RULES = [
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
]
PATTERN_RULES = ["||spam-farm.", "||free-bets.", "||casino-win.", "||ads-track."]
# Up to so many rules are broadcast; more are joined as the planner sees fit.
BROADCAST_RULES = 100_000


def to_regex(pattern: str) -> str:
    anchored = pattern.startswith("||")
    body = ".*".join(re.escape(p) for p in pattern.removeprefix("||").split("*"))
    return ("^(?:[^/]*\\.)?" if anchored else "") + body


def sure_tokens(pattern: str) -> list[str]:
    """Tokens that every matching URL holds whole, lower-cased.

    A token at a wildcard or at an open end of the pattern may go on in the
    URL, so it doesn't count.
    """
    anchored, body = pattern.startswith("||"), pattern.removeprefix("||")
    found = []
    for m in re.finditer(r"[A-Za-z0-9]+", body):
        opened = body[m.start() - 1] != "*" if m.start() else anchored
        closed = m.end() < len(body) and body[m.end()] != "*"
        if opened and closed:
            found.append(m[0].lower())
    return found


def split_url(df: DataFrame, url: str) -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    lower = "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), lower.upper(), lower)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return df.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))


def index_rules(spark, rules: list[tuple], counts: dict[str, int]) -> DataFrame:
    """``token, rules``: the rules filed under each token."""
    filed: dict[str, list] = {}
    for kind, rule, verdict, pattern in rules:
        tokens = sure_tokens(pattern)
        token = min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t)) if tokens else ""
        filed.setdefault(token, []).append((kind, len(rule), rule, verdict, to_regex(pattern)))
    schema = "token string, rules array<struct<kind int, size int, rule string, verdict string, regex string>>"
    return spark.createDataFrame(list(filed.items()), schema)


def judge(
    df: DataFrame, url: str = "url", base: list = BASE_RULES, patterns: list = PATTERN_RULES,
) -> DataFrame:
    """Add ``host, path, rule, verdict`` and ``pattern`` (what the method matched)."""
    spark = df.sparkSession
    df = split_url(df.drop("host", "path", "rule", "verdict", "pattern"), url)
    rules = [(1, r, v, "||" + r) for v, r in base] + [(0, p, "block", p) for p in patterns]
    # The verdict depends on the URL alone, so each is judged once.
    urls = df.select(F.concat("host", "path").alias("_target")).distinct()
    found = F.regexp_extract_all(F.lower("_target"), F.lit("([a-z0-9]+)"))
    tokens = urls.select("_target", F.explode(F.array_append(F.array_distinct(found), "")).alias("token"))
    small = F.broadcast if len(rules) <= BROADCAST_RULES else lambda df: df
    # Counted over all URLs; only the counts of rules' own tokens come back.
    wanted = spark.createDataFrame([(t,) for t in {t for r in rules for t in sure_tokens(r[3])}], "token string")
    seen = tokens.join(small(wanted), "token").groupBy("token").count().collect()
    index = index_rules(spark, rules, {r["token"]: r["count"] for r in seen})
    candidates = tokens.join(small(index), "token").select("_target", F.explode("rules").alias("_rule"))
    matched = candidates.where(F.regexp_like("_target", "_rule.regex"))
    best = matched.groupBy("_target").agg(F.max("_rule").alias("_best"))
    # Names of the pages' own columns may be any.
    target = fresh("_target", df.columns)
    best = best.withColumnRenamed("_target", target).withColumnRenamed("_best", f"{target}_best")
    judged = df.withColumn(target, F.concat("host", "path")).join(best, target, "left")
    found = F.col(f"{target}_best")
    is_base = found["kind"] == 1
    return judged.select(
        *[F.col(c) for c in df.columns],
        F.when(is_base, found["rule"]).alias("rule"),
        F.coalesce(found["verdict"], F.lit("allow")).alias("verdict"),
        F.when(~is_base, found["rule"]).alias("pattern"),
    )
