"""URL verdicts by pattern rules, indexed by their rarest literal token.

A rule is a host with a path prefix, or a regular expression with the literal tokens it
can't match without. Each rule is filed under that one of its tokens which the fewest URLs
hold (counted over all URLs). The tokens of a URL fetch the rules filed under them, and
only those run their regular expressions.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TOKEN = re.compile("[a-z0-9]+")
#: The contract's rules, longest fit wins.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: The method's own patterns for URLs that no rule of the first kind fits: (name, expression, tokens).
PATTERNS = (
    ("spam host", r"^[a-z][a-z0-9+.-]*://([^/?#]*[^a-z0-9/?#])?spam[^a-z0-9]", ("spam",)),
    ("casino host", r"^[a-z][a-z0-9+.-]*://([^/?#]*[^a-z0-9/?#])?casino[^a-z0-9]", ("casino",)),
    ("ad click", r"[/?&.]adclick[/?&=.]", ("adclick",)),
    ("executable", r"^[^?#]*\.exe([?#]|$)", ("exe",)),
)


@dataclass
class Rule:
    verdict: str
    name: str
    length: int
    match: re.Pattern
    tokens: tuple = field(default=())


def host_rule(verdict: str, rule: str) -> Rule:
    """``host/path``: fits the host and all its subdomains where the path starts so. A last
    token that the path does not close may go on in a URL, so it can't file the rule."""
    host, slash, path = rule.partition("/")
    path = slash + path
    low = path.lower()
    closed = low if re.search("[^a-z0-9]$", low) or not low else re.sub("[a-z0-9]+$", "", low)
    regex = re.compile("(?:.*\\.)?" + re.escape(host) + "\x00" + re.escape(path), re.S)
    return Rule(verdict, rule, len(rule), regex, tuple(dict.fromkeys(TOKEN.findall(host.lower()) + TOKEN.findall(closed))))


def pattern_rule(name: str, expression: str, tokens: tuple) -> Rule:
    return Rule("block", name, 0, re.compile(expression, re.S), tuple(tokens))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path


class RuleIndex:
    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.by_token, self.always = defaultdict(list), []
        for r in rules:
            if r.tokens:
                self.by_token[min(r.tokens, key=lambda t: (counts.get(t, 0), t))].append(r)
            else:
                self.always.append(r)

    def candidates(self, text: str) -> list[Rule]:
        if len(self.by_token) == 0:
            return self.always
        return [r for t in set(TOKEN.findall(text)) if t in self.by_token for r in self.by_token[t]] + self.always

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None]:
        """host, path, the host rule that won, verdict, the pattern that won. Of host rules of
        one length the first by name wins, of patterns the first by name."""
        host, path = split_url(url)
        low = (url or "").lower()
        best, pattern = None, None
        for r in self.candidates(low):
            if r.length:
                if (best is None or (-r.length, r.name, r.verdict) < (-best.length, best.name, best.verdict)) and r.match.match(host + "\x00" + path):
                    best = r
            elif (pattern is None or r.name < pattern.name) and r.match.search(low):
                pattern = r
        if best:
            return host, path, best.name, best.verdict, None
        return host, path, None, "block" if pattern else "allow", pattern.name if pattern else None


SCHEMA = "page_id long, host string, path string, rule string, verdict string, pattern string"


def judge_urls(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) for each row of ``pages``.

    Null URLs and those without ``://`` have an empty host and path; host rules can't fit
    them. Where no rule fits, ``rule`` is null and the verdict is ``allow`` unless one of the
    method's patterns matches. Repeated rows get equal results; no rows give none. The rule
    set is the caller's configuration and goes to the tasks with the code.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    names = sorted({t for r in rules for t in r.tokens})
    held = F.array_intersect(F.split(F.lower("url"), "[^a-z0-9]+"), F.array(*map(F.lit, names))) if names else F.array().cast("array<string>")
    counts = {r["t"]: r["count"] for r in rows.select(F.explode(held).alias("t")).groupBy("t").count().collect()}  # a row a rule token at most
    index = RuleIndex(rules, counts)

    def run(batches):
        for b in batches:
            found = [index.judge(u) for u in b.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array([f[i] for f in found], pa.string()) for i in range(5))], ["page_id", "host", "path", "rule", "verdict", "pattern"])

    return rows.mapInArrow(run, SCHEMA)


def production_rules() -> list[Rule]:
    return [host_rule(v, r) for v, r in RULES] + [pattern_rule(*p) for p in PATTERNS]


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), production_rules()).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH u AS (SELECT page_id, url, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(host_r, path_r, rule, v) AS (VALUES ('com', '/', 'com/', 'allow'), ('example.com', '/en/', 'example.com/en/', 'block'), ('www.example.com', '/en/', 'www.example.com/en/', 'allow'), ('net', '/es/', 'net/es/', 'block'), ('net', '/fr/', 'net/fr/', 'block')),
f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM p JOIN r ON (host = host_r OR ends_with(host, '.' || host_r)) AND starts_with(path, path_r) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.v, CASE WHEN regexp_matches(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://([^/?#]*[^a-z0-9/?#])?(spam|casino)[^a-z0-9]') OR regexp_matches(lower(coalesce(url, '')), '[/?&.]adclick[/?&=.]')
    OR regexp_matches(lower(coalesce(url, '')), '^[^?#]*\.exe([?#]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN f USING (page_id)
"""
