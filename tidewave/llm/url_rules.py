"""URL verdicts from pattern rules that are indexed by their rarest token (operator 8).

A rule is a host with a path ("example.net/en/"), and becomes a regular expression over host and path.
Its index entry is the one of its literal tokens that fewest rules have. A URL's own tokens fetch the rules
filed under them, and only those expressions run; the longest rule that fits decides.

The index goes to the tasks as a broadcast only while its size is under broadcast_bytes; more rules than
that are joined to the distinct URLs by token instead.

Defined cases: a null URL or one without "://" has an empty host and path and no rule; repeated URLs and
rows each get their verdict; a rule given twice counts once, its first action; an empty table gives an
empty result; further columns pass through, but for those named host, path, rule or verdict, which are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

TOKEN = re.compile(r"[a-z0-9]+")
BROADCAST_BYTES = 64 << 20


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def index_rules(rules: Iterable[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """(action, rule) pairs -> (token, rule, action, pattern): each rule once, under its rarest token; ties go to the longer, then the earlier token."""
    once: dict[str, str] = {}
    for action, rule in rules:
        once.setdefault(rule, action)
    tokens = {r: TOKEN.findall(r.lower().partition("/")[0]) + TOKEN.findall(r.lower().partition("/")[2]) for r in once}
    common = Counter(t for ts in tokens.values() for t in set(ts))
    out = []
    for rule, action in once.items():
        host, slash, path = rule.partition("/")
        # the last token of a path may go on in the URL, so it can't be looked up unless something follows it
        path_tokens = TOKEN.findall(path.lower())
        if path_tokens and re.fullmatch(r"[A-Za-z0-9]", path[-1:]):
            path_tokens.pop()
        usable = TOKEN.findall(host.lower()) + path_tokens
        token = min(usable, key=lambda t: (common[t], -len(t), usable.index(t))) if usable else ""
        out.append((token, rule, action, rf"(?:[^\x00]*\.)?{re.escape(host.lower())}\x00{re.escape(slash + path)}"))
    return out


def judge_urls(df: DataFrame, rules: Iterable[tuple[str, str]], default: str = "allow", url_col: str = "url", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with host, path, rule (null: none fits) and verdict."""
    index, df = index_rules(rules), df.drop("host", "path", "rule", "verdict")
    parsed = df.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    if sum(len(x) + 64 for row in index for x in row) > broadcast_bytes:
        return _judge_by_join(parsed, index, default)
    shared = df.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("rule string, action string")
    def verdict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        filed: dict[str, list] = {}
        for token, rule, action, pattern in shared.value:
            filed.setdefault(token, []).append((len(rule), rule, action, re.compile(pattern, re.S)))
        always = filed.get("", [])
        for hosts, paths in batches:
            rows = []
            for host, path in zip(hosts, paths, strict=True):
                found = list(always)
                for t in {*TOKEN.findall(host), *TOKEN.findall(path.lower())}:
                    found += filed.get(t, ())
                best = max((x[:3] for x in found if x[3].match(f"{host}\x00{path}")), default=(0, None, None), key=lambda x: (x[0], x[1].index("/")))
                rows.append(best[1:])
            yield pd.DataFrame(rows, columns=["rule", "action"])

    out = parsed.withColumn("_judged", verdict("host", "path"))
    return out.select(*df.columns, "host", "path", F.col("_judged.rule").alias("rule"), F.coalesce("_judged.action", F.lit(default)).alias("verdict"))


def _judge_by_join(parsed: DataFrame, index: list[tuple], default: str) -> DataFrame:
    """The same with the index as a table: distinct URLs meet it by token."""
    rules = parsed.sparkSession.createDataFrame(index, "token string, rule string, action string, pattern string")
    urls = parsed.select("host", "path").distinct()
    tokens = F.array_distinct(F.concat(F.regexp_extract_all("host", F.lit("([a-z0-9]+)"), 1), F.regexp_extract_all(F.lower("path"), F.lit("([a-z0-9]+)"), 1), F.array(F.lit(""))))
    fits = urls.withColumn("token", F.explode(tokens)).join(rules, "token").where(F.expr("concat(host, '\\u0000', path) RLIKE concat('(?s)^', pattern)"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), F.instr("rule", "/").alias("h"), "rule", "action")).alias("b"))
    out = parsed.join(best, ["host", "path"], "left")
    rest = [c for c in parsed.columns if c not in ("host", "path")]
    return out.select(*rest, "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.action", F.lit(default)).alias("verdict"))
