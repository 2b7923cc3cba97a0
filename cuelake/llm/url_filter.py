"""URL filter: pattern rules filed under their rarest literal token.

Every rule is a regular expression with the literal tokens that any matching URL must hold. Token
counts over all URLs tell which token of a rule is rarest; the rule is filed under that one. A URL's
own tokens then fetch the few rules filed under them, and only those run their expression.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_place, keep, materialise, scratch

#: The rules of the query's contract, (host, path, verdict).
CONTRACT_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

#: Our own pattern rules for URLs that no host rule fits: (pattern, literal host labels or path
#: segments it needs, verdict). The longest pattern that fits decides; none: allow.
DEFAULT_PATTERNS = [
    (r"^(?:[^/]*\.)?spam-farm\.[^/]*", ["h:spam-farm"], "block"),
    (r"^(?:[^/]*\.)?casino\.[^/]*", ["h:casino"], "block"),
    (r"^(?:[^/]*\.)?porn\.[^/]*", ["h:porn"], "block"),
    (r"^[^/]*/(?:[^/]*/)*wp-login\.php$", ["p:wp-login.php"], "block"),
]


#: A list of more rules is too large to send to every task: it is a table's (``judge_urls_by_table``).
MOST_RULES = 10_000
_JUDGED = "struct<rule:string,verdict:string,n_candidates:int>"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct literal tokens: host labels as ``h:label``, whole path segments as ``p:segment``."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, parts))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c == "/" else "\\" + c if ord(c) < 128 else c for c in text)


def host_rules(rules: Sequence[tuple[str, str, str]]) -> list[tuple[str, str, list[str], str, int, int]]:
    """(host, path prefix, verdict) as pattern rules. A rule fits its host and all subdomains when the
    path starts with the rule's. The last path segment of a rule may be cut short, so it is no token."""
    return [
        (host + path, r"^(?:[^/]*\.)?" + _quoted(host) + _quoted(path),
         [f"h:{x}" for x in host.split(".")] + [f"p:{x}" for x in path.split("/")[1:-1]], verdict, 1, len(host + path))
        for host, path, verdict in rules
    ]


def pattern_rules(patterns: Sequence[tuple[str, list[str], str]]) -> list[tuple[str, str, list[str], str, int, int]]:
    return [(None, pattern, tokens, verdict, 0, len(pattern)) for pattern, tokens, verdict in patterns]


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = CONTRACT_RULES,
    patterns: Sequence[tuple[str, list[str], str]] = DEFAULT_PATTERNS,
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """``pages`` with host, path, rule, verdict, and n_candidates: rules whose expression ran.

    The longest fitting host rule wins and is named in ``rule``; without one ``rule`` is null and the
    longest fitting pattern rule decides, else ``default``. Of rules of equal length the later one wins. A null url or one
    without ``://`` has an empty host and path and fits no host rule. Repeated rows are judged each for itself; columns named
    like the new ones are replaced; an empty table gives no rows. The rules come as a Python list of at most ``MOST_RULES`` in all; more are an error,
    and go through ``judge_urls_by_table``. Each row is judged where it is: nothing is shuffled
    but the counts of the rules' tokens.
    """
    base = pages.withColumn("host", url_host(F.col(url_col))).withColumn("path", url_path(F.col(url_col)))
    base = base.drop("rule", "verdict", "n_candidates")
    if len(rules) + len(patterns) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules: use judge_urls_by_table")
    listed = sorted(enumerate(host_rules(rules) + pattern_rules(patterns)), key=lambda r: (-r[1][4], -r[1][5], -r[0]))
    tokens = sorted({t for _, r in listed for t in r[2]})
    counts: dict[str, int] = {}
    if tokens:
        wanted = F.broadcast(pages.sparkSession.createDataFrame([(t,) for t in tokens], "token string"))
        seen = base.select(F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token")).join(wanted, "token")
        counts = {r["token"]: r["count"] for r in seen.groupBy("token").count().collect()}  # no more rows than the rules' tokens
    index: dict[str, list[tuple]] = {}
    for place, (_, (name, pattern, needs, says, _, _)) in enumerate(listed):
        index.setdefault(min(needs, key=lambda t: (counts.get(t, 0), t)), []).append((place, name, pattern, says))

    @F.arrow_udf(_JUDGED)
    def judged(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        ready: dict[str, re.Pattern] = {}
        out = []
        for host, path in zip(hosts.to_pylist(), paths.to_pylist()):
            found = {f"h:{x}" for x in host.split(".")} | {f"p:{x}" for x in path.split("/")}
            # In the order of the rules; the first that fits decides.
            tried, best = 0, (None, default)
            for _, name, pattern, says in sorted(x for t in found & index.keys() for x in index[t]):
                tried += 1
                if (ready.get(pattern) or ready.setdefault(pattern, re.compile(pattern, re.S))).search(host + path):
                    best = (name, says)
                    break
            out.append({"rule": best[0], "verdict": best[1], "n_candidates": tried})
        return pa.array(out, pa.struct([("rule", pa.string()), ("verdict", pa.string()), ("n_candidates", pa.int32())]))

    names = base.columns
    told = by_place(base.select("*", judged("host", "path")))
    last = told.columns[-1]
    return told.select(*told.columns[:-1], f"{last}.rule", f"{last}.verdict", f"{last}.n_candidates").toDF(*names, "rule", "verdict", "n_candidates")


def rule_table(spark, rules: Sequence[tuple[str, str, str]] = (), patterns: Sequence[tuple[str, list[str], str]] = ()) -> DataFrame:
    """Rules as ``judge_urls_by_table`` takes them: rule, pattern, needs (the tokens), verdict, place (the order in which they decide)."""
    listed = sorted(enumerate(host_rules(rules) + pattern_rules(patterns)), key=lambda r: (-r[1][4], -r[1][5], -r[0]))
    rows = [(name, pattern, needs, says, place) for place, (_, (name, pattern, needs, says, _, _)) in enumerate(listed)]
    return spark.createDataFrame(rows, "rule string, pattern string, needs array<string>, verdict string, place long")


def judge_urls_by_table(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``judge_urls`` for any number of rules, a table as of ``rule_table``: nothing is sent to all tasks or to the driver. Each rule is filed under its rarest
    token by a join with the tokens' counts; a URL's tokens fetch their rules by another, and only those run, in the JVM. ``n_candidates`` counts all of them. A rule that needs no token is an
    error. Patterns are of Java's kind, places have no ties."""
    with scratch(pages.sparkSession):
        named = by_place(pages.drop("host", "path", "rule", "verdict", "n_candidates"))
        url = named.columns[pages.drop("host", "path", "rule", "verdict", "n_candidates").columns.index(url_col)]
        rows = materialise(named.withColumn("_row", F.monotonically_increasing_id()).withColumn("host", url_host(F.col(url))).withColumn("path", url_path(F.col(url))), "urls")
        tokens = materialise(rows.select("_row", F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"), F.concat("host", "path").alias("said")), "url-tokens")
        filed = rules.where(F.when(F.coalesce(F.size("needs"), F.lit(0)) < 1, F.raise_error(F.concat(F.lit("a rule needs no token: "), "pattern")).cast("boolean")).otherwise(True))
        asked = filed.select("place", F.explode("needs").alias("token"))
        counts = tokens.join(asked.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("n"))
        rarest = asked.join(counts, "token", "left").groupBy("place").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("r")).select("place", "r.token")
        index = materialise(filed.join(rarest, "place").select("token", "place", "pattern", "rule", "verdict"), "rule-index")
        met = tokens.join(index, "token").withColumn("fits", F.rlike("said", F.concat(F.lit("(?s)"), "pattern")))
        best = met.groupBy("_row").agg(F.count("*").cast("int").alias("n_candidates"), F.min(F.when(F.col("fits"), F.struct("place", "rule", "verdict"))).alias("b"))
        out = rows.join(best, "_row", "left").select(*named.columns, "host", "path", "b.rule", F.coalesce("b.verdict", F.lit(default)).alias("verdict"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))
        told = keep(materialise(out, "judged-urls"))
        return told.toDF(*pages.drop("host", "path", "rule", "verdict", "n_candidates").columns, "host", "path", "rule", "verdict", "n_candidates")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
j AS (SELECT p.page_id, p.host, p.path,
             max_by(r.h || r.p, length(r.h || r.p)) AS rule, max_by(r.v, length(r.h || r.p)) AS v
      FROM p LEFT JOIN r ON (p.host = r.h OR suffix(p.host, '.' || r.h)) AND starts_with(p.path, r.p)
      GROUP BY p.page_id, p.host, p.path)
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN regexp_matches(host || path, '^([^/]*\.)?spam-farm\.[^/]*') THEN 'block'
                        WHEN regexp_matches(host || path, '^([^/]*\.)?casino\.[^/]*') THEN 'block'
                        WHEN regexp_matches(host || path, '^([^/]*\.)?porn\.[^/]*') THEN 'block'
                        WHEN regexp_matches(host || path, '^[^/]*/([^/]*/)*wp-login\.php$') THEN 'block' ELSE 'allow' END) AS verdict
FROM j
"""
