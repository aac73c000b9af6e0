"""Line dedup by winnowing over line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stage_table

MIN_LINES = 3
#: A shorter run counts too, where the caller asks for it, if it has more words than this.
LONG_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
BLANK = " \t\n\x0b\x0c\r"
#: A newline that no blank line follows: a unit is a line together with the blank lines after it.
CUT = r"\n(?![\x20\x09\x0b-\x0d]*(?:\n|\z))"


def _runs(starts: Column, t: int) -> Column:
    """Maximal runs (s, e) of lines covered by windows of ``t`` lines that begin at ``starts`` (sorted).

    Matches extend both ways: windows that overlap or touch are one run.
    """
    n = F.size(starts)
    begins = F.filter(starts, lambda j, i: (i == 0) | (F.get(starts, i - 1) + t < j))
    ends = F.filter(starts, lambda j, i: (i == n - 1) | (F.get(starts, i + 1) > j + t))
    return F.arrays_zip(begins.alias("s"), F.transform(ends, lambda j: j + F.lit(t - 1)).alias("e"))


def _flags(runs: Column, n: Column) -> Column:
    """An array of n booleans, true inside runs; linear in n."""
    last = F.coalesce(F.get(runs, F.size(runs) - 1)["e"], F.lit(-1))

    def piece(r, i):
        before = F.coalesce(F.get(runs, i - 1)["e"], F.lit(-1))
        return F.concat(F.array_repeat(F.lit(False), r["s"] - before - 1), F.array_repeat(F.lit(True), r["e"] - r["s"] + 1))

    return F.concat(F.flatten(F.transform(runs, piece)), F.array_repeat(F.lit(False), n - 1 - last))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """``docs`` with repeated runs of lines taken out of ``text``, plus n_lines and n_removed.

    Lines are compared without surrounding white space; blank lines belong to the line before.
    Each window of ``min_lines`` lines names its least line hash (the leftmost of equals): these
    window minima are the fingerprints.  Windows whose fingerprint stands at two places or more are
    keyed by a 128-bit hash of all their lines and joined with the key's first position in the
    order (doc_id, line); a line goes if a window over it occurred earlier.  So every
    repeated run of ``min_lines`` lines or more is found, the first occurrence stays, and shorter
    repeats stay.  Within one document later repeats go as well.

    With ``long_words`` windows of fewer lines are fingerprinted in the same way if their words
    together exceed it, whatever the number of lines of the document: then every repeated run of
    ``min_lines`` lines or of more than ``long_words`` words is found.

    A null text stays null with 0 lines; an empty text is one blank line.  Rows with the same doc_id
    and text are one document and get the same decision; a null doc_id comes last in the order.  Other
    columns pass through, columns named n_lines and n_removed are replaced; an empty table
    gives an empty result.
    """
    t = min_lines
    src = docs.drop("n_lines", "n_removed").withColumns({
        "_d": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)),
        "_t": F.xxhash64("text"),
    })
    units = F.split(F.col("text"), CUT)
    words = [] if long_words is None else [F.transform(units, lambda u: F.regexp_count(u, F.lit(WORD))).alias("w")]
    hashes = src.select("_d", "_t", F.transform(units, lambda u: F.xxhash64(F.btrim(u, F.lit(BLANK)))).alias("h"), *words)
    if long_words is None:
        hashes = hashes.filter(F.size("h") >= t)

    def window(j, n):
        part = F.slice(F.col("h"), j + 1, n)
        low = F.array_min(part)
        return F.struct(
            j.alias("j"), F.lit(n).alias("n"), low.alias("fp"), (j + F.array_position(part, low).cast("int") - 1).alias("at"),
            F.xxhash64(part).alias("g1"), F.xxhash64(F.lit(n), F.reverse(part)).alias("g2"),
        )

    def windows(n):
        js = F.when(F.size("h") >= n, F.sequence(F.lit(0), F.size("h") - n)).otherwise(F.array().cast("array<int>"))
        if n < t:
            js = F.filter(js, lambda j: sum((F.get(F.col("w"), j + k) for k in range(1, n)), F.get(F.col("w"), j)) > long_words)
        return F.transform(js, lambda j: window(j, n))

    sizes = [t] if long_words is None else range(1, t + 1)
    wins = hashes.select("_d", "_t", F.explode(F.concat(*[windows(n) for n in sizes])).alias("w")).select("_d", "_t", "w.*")
    place = lambda at: F.struct("_d", "_t", at)
    # written once, so the texts are hashed once and hot fingerprints and keys can be dealt to several tasks
    wins = stage_table(wins, "windows")
    shared = wins.groupBy("fp").agg(F.min(place("at")).alias("a"), F.max(place("at")).alias("b"), F.count("*").alias("c")).filter("a <> b").select("fp", "c")
    wins = spread_join(wins, stage_table(shared, "fingerprints"), ["fp"], "c", "left_semi").select("_d", "_t", "j", "n", "g1", "g2")
    wins = stage_table(wins, "windows")
    first = wins.groupBy("g1", "g2").agg(F.min(place("j")).alias("first"), F.max(place("j")).alias("last"), F.count("*").alias("c")).filter("first <> last").drop("last")
    later = spread_join(wins, stage_table(first, "first"), ["g1", "g2"], "c").filter(place("j") > F.col("first"))
    gone = later.groupBy("_d", "_t").agg(F.collect_set(F.struct("j", "n")).alias("wins"))
    lines = F.flatten(F.transform("wins", lambda w: F.sequence(w["j"], w["j"] + w["n"] - 1)))
    gone = gone.select("_d", "_t", F.array_sort(F.array_distinct(lines)).alias("lines")).select("_d", "_t", _runs(F.col("lines"), 1).alias("runs"))

    joined = src.join(gone, ["_d", "_t"], "left").withColumn("_u", units)
    flags = _flags(F.col("runs"), F.size("_u"))
    joined = joined.withColumn("_f", F.when(F.col("runs").isNotNull(), flags))
    kept = F.filter(F.col("_u"), lambda u, i: ~F.get(F.col("_f"), i))
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r["e"] - r["s"] + 1)
    cols = [F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias(c) if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(
        *cols,
        F.when(F.col("text").isNull(), 0).otherwise(F.size("_u")).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
    )


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
b AS (SELECT doc_id, i, line, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS x FROM l),
n AS (SELECT doc_id, i, line, x, sum(CASE WHEN x <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM b),
g AS (SELECT doc_id, u, max(x) AS x, string_agg(line, chr(10) ORDER BY i) AS raw FROM n GROUP BY doc_id, u),
k AS (
  SELECT doc_id, row_number() OVER w AS j, x, raw, count(*) OVER (PARTITION BY doc_id) AS n_lines,
         x || chr(1) || lead(x, 1) OVER w || chr(1) || lead(x, 2) OVER w AS key FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY u)),
f AS (SELECT doc_id, j, row_number() OVER (PARTITION BY key ORDER BY doc_id, j) > 1 AS again FROM k WHERE key IS NOT NULL),
m AS (
  SELECT k.doc_id, k.j, k.raw, k.n_lines,
         coalesce(max(CASE WHEN f.again THEN 1 ELSE 0 END) OVER (PARTITION BY k.doc_id ORDER BY k.j ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM k LEFT JOIN f USING (doc_id, j)),
r AS (
  SELECT doc_id, max(n_lines) AS n_lines, sum(gone)::BIGINT AS n_removed,
         coalesce(string_agg(CASE WHEN gone = 0 THEN raw END, chr(10) ORDER BY j), '') AS text FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, md5(r.text) AS kept_md5 FROM documents d LEFT JOIN r USING (doc_id)
"""
