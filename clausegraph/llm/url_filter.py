"""URL filters: host-suffix and path-prefix expressions, met by short hash prefixes.

A rule is a host, a path and a verdict. It fits its host and all subdomains, where the url's path starts
with the rule's. So a url meets a rule exactly if one of the url's expressions, a suffix of its host by
whole labels with a prefix of its path, is the rule's own host and path. Which expressions can be is known
from the rules: only their numbers of labels and lengths of path are made (the rules' shapes), so nothing
that could match is left out, and deep hosts and long paths cost no more than the rules ask for.

Expressions are made once for each distinct host and path, not for each url. They meet the rules by
equality of the first SHORT hexadecimal digits of their SHA-256; then the full digests are compared. Rules
are broadcast within BROADCAST_BYTES. Beyond that both sides shuffle by the short prefix; as a suffix like
`com` may be in half of all expressions, prefixes are counted first and the rules of hot ones are broadcast.
Of the rules that fit, the longest wins (code points of host and path; then the longer host).

Defined cases: a null url, or one without `://`, has an empty host and path, which only a rule with an
empty host and path fits; urls that no rule fits get the verdict `otherwise`. A rule's null host or path
counts as empty and its host is lower-cased as urls are; of rules that repeat host and path, block wins.
Rows that repeat are judged each; null ids pass through; an empty table gives an empty result, and no
rules give every url `otherwise`; other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegraph.llm.common import BROADCAST_BYTES, ascii_lower, cut, join_hot, load

SHORT, RULE_BYTES = 8, 400
#: (host, path, verdict) of the registered query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first `://`: the host up to `/`, `?`, `#` or the end, A-Z lower-cased, and the path from there up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def rule_table(rules: DataFrame) -> DataFrame:
    """short, digest, labels, path_length, length, host_length, rule and verdict of rules (host, path, verdict), one row for each host and path."""
    named = rules.select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    one = named.groupBy("host", "path").agg(F.when(F.bool_or(F.col("verdict") == "block"), "block").otherwise("allow").alias("verdict"))
    rule = F.concat("host", "path")
    out = one.select(F.sha2(rule.cast("binary"), 256).alias("digest"), _labels(F.col("host")).alias("labels"), F.length("path").alias("path_length"), F.length(rule).alias("length"), F.length("host").alias("host_length"), rule.alias("rule"), "verdict")
    return out.select(F.substring("digest", 1, SHORT).alias("short"), "*")


def expressions(places: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """host, path, short and digest for each of the shapes (labels, length of path) that a distinct host and path has."""
    if not shapes:
        return places.select("host", "path", F.lit("").alias("short"), F.lit("").alias("digest")).where("false")
    asked = F.from_json(F.lit(json.dumps([{"k": k, "n": n} for k, n in sorted(shapes)])), "array<struct<k:int,n:int>>")
    each = places.select("host", "path", _labels(F.col("host")).alias("_labels"), F.explode(asked).alias("_s"))
    each = each.where("_s.k <= _labels and _s.n <= length(path)")
    text = F.expr("concat(substring_index(host, '.', -_s.k), substring(path, 1, _s.n))")
    each = each.select("host", "path", F.sha2(text.cast("binary"), 256).alias("digest"))
    return each.select("host", "path", F.substring("digest", 1, SHORT).alias("short"), "digest")


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow", most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The id, host, path, rule and verdict of every row of urls; rules has host, path and verdict (allow or block)."""
    host, path = host_and_path(F.col(url_col))
    rows = urls.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    known = cut(rule_table(rules))
    small = known.count() * RULE_BYTES <= most_bytes
    shapes = [tuple(r) for r in known.select("labels", "path_length").distinct().collect()]  # bounded by the labels and lengths that urls can have
    places = cut(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")))
    asked = expressions(places, shapes)
    own = known.select("short", F.col("digest").alias("rule_digest"), F.struct("length", "host_length", "rule", "verdict").alias("found"))
    if small:
        met = asked.join(F.broadcast(own), "short").select("host", "path", "digest", "rule_digest", "found")
    else:
        times = asked.groupBy("short").agg(F.count(F.lit(1)).alias("n"))
        keyed = cut(own.groupBy("short").agg(F.collect_list(F.struct("rule_digest", "found")).alias("rules")).join(times, "short"))  # distinct digests of one short prefix
        met = join_hot(asked, keyed, "short", "n", asked.count()).select("host", "path", "digest", F.explode("rules").alias("r")).select("host", "path", "digest", "r.rule_digest", "r.found")
    best = met.where("digest = rule_digest").groupBy("host", "path").agg(F.max("found").alias("found"))
    place = F.struct("host", "path")
    table = places.join(best, ["host", "path"]).select(place.alias("place"), "n", "found")
    judged = join_hot(rows.select("page_id", place.alias("place")), cut(table), "place", "n", rows.count(), "left")
    return judged.select("page_id", "place.host", "place.path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(otherwise)).alias("verdict"))


def op13_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


OP13_SQL = rf"""
WITH r(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS t FROM pages),
cut AS (
  SELECT page_id, translate(regexp_extract(t, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
placed AS (SELECT DISTINCT host, path FROM cut),
best AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM placed JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY host, path)
SELECT page_id, cut.host, cut.path, rule, coalesce(verdict, 'allow') AS verdict
FROM cut LEFT JOIN best USING (host, path)
"""
