"""Allow and block rules for urls: a trie over reversed host labels, then path segments."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_RULES = 200_000
MAX_RULE_CHARS = 64 << 20

#: The rules of the contract's query, (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
RESULT = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])


class Trie:
    """Rules by reversed host labels; each host node has a second trie of path segments.

    A rule's path is a plain prefix of the url's path, so its last piece may end inside a segment:
    whole segments are edges and the rest is kept as ``tails`` of the node reached.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(("h", label), {})
            *whole, tail = path.split("/")
            for segment in whole:
                node = node.setdefault(("p", segment), {})
            tails = node.setdefault("tails", {})
            # an exact duplicate with both verdicts: block wins
            if tails.get(tail, ("", "allow"))[1] != "block":
                tails[tail] = (host + path, verdict)

    @staticmethod
    def _along(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for i, segment in enumerate(segments):
            tails = node.get("tails")
            if tails:
                # the longest tail that the rest of the path starts with; a tail has no slash
                fits = [t for t in tails if segment.startswith(t)]
                if fits:
                    best = tails[max(fits, key=len)]
            if i == len(segments) - 1:
                break
            node = node.get(("p", segment))
            if node is None:
                break
        return best

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """Rule text and verdict of the longest fitting rule: deepest host first, then longest path."""
        segments = path.split("/")
        node, best = self.root, self._along(self.root, segments)
        for label in reversed(host.split(".")):
            node = node.get(("h", label))
            if node is None:
                break
            best = self._along(node, segments) or best
        return best


def host_and_path(url):
    """Columns of the host (A-Z lowered) and the path; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise("")
    authority = F.regexp_extract(rest, "^[^/?#]*", 0)
    lowered = F.translate(authority, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return lowered, path


def judge_urls(df: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """``df`` (with a column ``url``) plus host, path, rule and verdict.

    The rule list is a parameter of the driver and is broadcast; it is refused beyond
    ``MAX_RULES`` rules or ``MAX_RULE_CHARS`` characters.  Null urls and urls without ``://`` have
    empty host and path, which no rule with a path fits; they get ``default``.  Repeated rows are
    judged alike; columns named host, path, rule or verdict are replaced; an empty table gives an
    empty result.
    """
    rules = list(rules)
    if len(rules) > MAX_RULES or sum(len(h) + len(p) for _, h, p in rules) > MAX_RULE_CHARS:
        raise ValueError("rule list exceeds the broadcast bound")
    for verdict, _, _ in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {verdict!r}")
    trie = df.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf(RESULT)
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        find = trie.value.find
        got = [find(h, p) or (None, default) for h, p in zip(host, path, strict=True)]
        return pd.DataFrame(got, columns=["rule", "verdict"])

    host, path = host_and_path(F.col("url"))
    kept = df.drop("host", "path", "rule", "verdict")
    return (
        kept.withColumns({"host": host, "path": path})
        .withColumn("_judged", judge("host", "path"))
        .select("*", "_judged.rule", "_judged.verdict")
        .drop("_judged")
    )


SQL = r"""
WITH r AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(v, h, q) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                          ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (
  SELECT page_id, max_by(h || q, length(h) * 1000 + length(q)) AS rule, max_by(v, length(h) * 1000 + length(q)) AS verdict
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
