"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a classifier decides.

DataFrame functions only; the driver handles two summaries of bounded size (see ``MAX_PATTERNS``).
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_table

#: The kinds with a base form, and all.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: Stands for a character that must not join its neighbours; one code point, so places stay.
CUT, SPARE = "\uf8ff", "\uf8fe"

_LOCAL = r"A-Za-z0-9._%+\-" + CUT
_LABEL = r"A-Za-z0-9\-"
#: The contract's patterns without nested repeats: where those would allow a separator only between
#: other characters, separators elsewhere are first replaced by ``CUT``, so plain character runs do.
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_LABEL}]++\.[{_LABEL}.]+"
EMAIL_DOTS = rf"\.(?![{_LABEL}])|(?<![{_LABEL}])\."
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9\x20-]+"
CARD_GAPS = r"(?<![0-9])[\x20-]|[\x20-](?![0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Wider patterns whose matches are candidates only.
LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?|\.)[A-Za-z]{2,}+(?![A-Za-z0-9])"
LOOSE_IP = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
#: Keys and tokens of letters and digits; the contract knows no base form of them.
LOOSE_SECRET = r"(?<![A-Za-z0-9_/+.-])[A-Za-z0-9_/+-]{20,}+={0,2}(?![A-Za-z0-9_/+.=-])"
LOOSE_PHONE = r"(?<![0-9+.-])(?<!\+[0-9]{1,3}[\x20.-])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"

#: Gazetteers and context words (fixed values).
TOP_DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|co|de|fr|es|it|uk|nl|pl|eu|us|ca|au|jp|cn|in|br|ru|ch|at|be|se"
KEY_HEADS = r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|sk-|sk_live_|pk_live_|xox[abprs]-|AIza|eyJ|glpat-|npm_)"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
CALLING_CODES = r"^(?:1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|5[1-8]|6[0-6]|8[1-6]|9[0-58]|2[1-9][0-9]|3[578][0-9]|42[013]|85[0-9]|9[67][0-9])"
CONTEXT = (
    ("e-?mail|contact|write|reach|correo|courriel|kontakt", "version|example\\s*$"),
    ("\\bip\\b|addr|host|server|client|login|from", "version|release|\\bv\\s*$|section|build"),
    ("card|visa|master|amex|credit|payment|tarjeta|carte|karte", "order|isbn|token|serial|invoice|tracking|sha|hash"),
    ("tel|phone|call|fax|mobile|cell|whatsapp|telefon|dial", "order|isbn|token|serial|version|score"),
    ("token|secret|passw|credential|bearer|auth|(?:api|access|private)[_ -]?key", "commit|checksum|digest|\\bsha|\\bmd5|revision|://\\S*$"),
)
BEFORE, AFTER = 40, 20
VOTES, ROUNDS = 5, 50
#: Log-odds from which a wider candidate is added.
THRESHOLD = 2.0
#: Bound of what is collected: kinds * 3**votes patterns, times the levels of the features.
MAX_PATTERNS = len(ALL_KINDS) * 3**VOTES
LEVELS = 8
#: Values scanned in one go, and code points of the pieces that contexts are cut from.
BLOCK, PIECE = 256, 1024

SPAN = "array<struct<s:int,e:int,m:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(values: Column, op) -> Column:
    """For each value (a long) what ``op`` makes of 0 and the values before it.

    Blocks of ``BLOCK`` values are scanned by themselves, then their totals, so the work grows in
    proportion for all but enormous arrays (the totals of a million values are 4,000).
    """
    zero = F.struct(F.lit(0).cast("long").alias("p"), F.array().cast("array<bigint>").alias("out"))

    def step(acc, v):
        return F.struct(op(acc["p"], v).alias("p"), F.concat(acc["out"], F.array(acc["p"])).alias("out"))

    def direct(x):
        return F.aggregate(x, zero, step)

    def blocked(x):
        cuts = F.sequence(F.lit(0), F.floor(F.size(x) / F.lit(BLOCK)).cast("int"))
        return _let(F.transform(cuts, lambda k: direct(F.slice(x, k * BLOCK + 1, BLOCK))), joined)

    def joined(blocks):
        offs = direct(F.transform(blocks, lambda b: b["p"]))["out"]
        return F.flatten(F.zip_with(blocks, offs, lambda b, o: F.transform(b["out"], lambda v: op(v, o))))

    return _let(values, blocked)


PAIRS = "array<struct<g:int,n:int,m:string>>"


def _pairs(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches m, their lengths n and the lengths g of what stands before each."""
    gaps, hits = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(gaps, hits, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("n"), m.alias("m")))
    return F.filter(pairs, lambda x: x["m"].isNotNull())


def _placed(pairs: Column) -> Column:
    """Matches with their places in code points, ends exclusive."""
    before = _scan(F.transform(pairs, lambda v: (v["g"] + v["n"]).cast("long")), lambda a, v: a + v)
    return F.zip_with(pairs, before, lambda v, p: F.struct((p + v["g"]).cast("int").alias("s"), (p + v["g"] + v["n"]).cast("int").alias("e"), v["m"].alias("m")))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn check."""
    back = F.split(F.reverse(F.substring(digits, 1, 19)), "")
    back = F.filter(back, lambda d: d != "")

    def term(d, i):
        v = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.transform(back, term), F.lit(0), lambda a, v: a + v) % 10 == 0


def _octets(m: Column) -> Column:
    """Whether no part exceeds 255, whatever its leading zeros."""
    return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _matches(text: Column) -> dict[str, Column]:
    """Columns of the matches of each pattern, before any check; ``text`` must not be null."""
    t = F.translate(text, CUT, SPARE)
    found = {
        "email": (F.contains(t, F.lit("@")), F.regexp_replace(t, EMAIL_DOTS, CUT), EMAIL),
        "ip": (t.rlike(r"[0-9]\.[0-9]"), t, IP),
        "card": (t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), F.regexp_replace(t, CARD_GAPS, CUT), CARD),
        "phone": (t.rlike(r"\+[0-9]"), t, PHONE),
        "loose_email": (t.rlike(r"[\x20(\[]at[\x20)\]]"), t, LOOSE_EMAIL),
        "loose_ip": (t.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"), t, LOOSE_IP),
        "loose_phone": (t.rlike(r"[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}"), t, LOOSE_PHONE),
        "loose_secret": (t.rlike(LOOSE_SECRET), t, LOOSE_SECRET),
    }
    return {k: F.when(some, _pairs(*of)).otherwise(F.array().cast(PAIRS)) for k, (some, *of) in found.items()}


def _checked(spans: dict[str, Column]) -> tuple[list[Column], list[Column]]:
    """The base spans of ``KINDS`` and the wider candidates of ``ALL_KINDS``."""
    n = lambda x: F.length(_digits(x["m"]))
    base = [
        spans["email"],
        F.filter(spans["ip"], lambda x: _octets(x["m"])),
        F.filter(spans["card"], lambda x: (n(x) >= 16) & (n(x) <= 19) & _luhn(_digits(x["m"]))),
        F.filter(spans["phone"], lambda x: (n(x) >= 8) & (n(x) <= 15)),
    ]
    wide = [
        spans["loose_email"], spans["loose_ip"], F.filter(spans["card"], lambda x: (n(x) >= 13) & (n(x) <= 19)), spans["loose_phone"],
        F.filter(spans["loose_secret"], lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]")),
    ]
    return base, wide


def _vote(yes: Column, no: Column) -> Column:
    return F.when(F.coalesce(yes, F.lit(False)), 1).when(F.coalesce(no, F.lit(False)), -1).otherwise(0)


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """The text between two places at most ``PIECE`` apart, from its pieces, so its cost is the same at every place."""
    first = F.floor(start / PIECE).cast("int")
    return F.substr(F.array_join(F.slice(pieces, first + 1, 2), ""), start - first * PIECE + 1, end - start)


def _of_kind(kind: Column, columns: list[Column]) -> Column:
    out = F.when(kind == 0, columns[0])
    for i, c in enumerate(columns[1:], 1):
        out = out.when(kind == i, c)
    return out


def _candidate(x: Column) -> Column:
    """A candidate (k, s, e, m, base) with its labelers' votes and the classifier's features."""
    kind, m, digits, base = x["k"], x["m"], _digits(x["m"]), x["base"]
    before = F.lower(_cut(F.col("_pieces"), F.greatest(x["s"] - BEFORE, F.lit(0)), x["s"]))
    after = F.lower(_cut(F.col("_pieces"), x["e"], x["e"] + AFTER))
    n, hex_or_base64 = F.length(digits), "^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|[A-Za-z0-9_+-]{20,}={0,2})$"
    plus = F.startswith(m, F.lit("+"))
    shape = [
        _vote(m.rlike(r"@[A-Za-z0-9-]{2,}.*\.[A-Za-z]{2,}$") | ~F.contains(m, F.lit("@")), m.rlike(r"\.[0-9]+$")),
        _vote(_octets(m) | F.contains(m, F.lit(":")), F.lit(True)),
        _vote(_luhn(digits), F.lit(True)),
        _vote((n >= 10) & (n <= 15), (n < 8) | (n > 15)),
        _vote(m.rlike(hex_or_base64) & (n * 8 >= F.length(m)), m.rlike("[/_-].*[/_-].*[/_-]") | (n * 16 < F.length(m))),
    ]
    listed = [
        F.lower(m).rlike(rf"(?:\.|dot\W{{0,2}})(?:{TOP_DOMAINS})$").cast("int"),
        -m.rlike(r"^(?:0|127|255)\.").cast("int"),
        _vote(digits.rlike(ISSUERS), F.lit(True)),
        _vote(plus & digits.rlike(CALLING_CODES), plus),
        m.rlike(KEY_HEADS).cast("int"),
    ]
    good, poor = (_of_kind(kind, [F.lit(c[i]) for c in CONTEXT]) for i in (0, 1))
    edge = before.rlike(r"""(?:^|[\s(\[:;,|<>*#$%&"'=])$""") & after.rlike(r"""^(?:$|[\s)\]:;,.|!?<>*#$%&"'])""")
    # of the base patterns: a match that failed their checks is a no, another form is no answer
    failed = (kind == 2) & (n >= 16) & ~_luhn(digits)
    votes = [_vote(base, failed), _of_kind(kind, shape), _of_kind(kind, listed), _vote(F.regexp_like(before, good), F.regexp_like(before, poor)), _vote(edge, F.lit(True))]
    size = F.least(F.length(m) / 6, F.lit(LEVELS - 1)).cast("int")
    share = F.least(n * 4 / F.length(m), F.lit(4)).cast("int")
    seps = F.least(F.length(m) - F.length(F.regexp_replace(m, r"[\x20().-]", "")), F.lit(LEVELS - 1)).cast("int")
    return F.struct(
        kind.alias("k"), x["s"].alias("s"), x["e"].alias("e"), base.alias("base"),
        F.concat_ws(",", *[v.cast("string") for v in votes]).alias("votes"), size.alias("f0"), share.alias("f1"), seps.alias("f2"),
    )


def _apart(own: Column, wide: Column) -> Column:
    """The spans of ``wide`` that overlap none of ``own``; spans of either list never overlap each other."""
    far = F.lit(1 << 40)
    row = lambda own: lambda x: F.struct(x["s"].alias("s"), F.lit(own).alias("own"), x["e"].alias("e"), x["m"].alias("m"))

    def kept(x):
        ends = _scan(F.transform(x, lambda v: F.when(v["own"], v["e"]).otherwise(0).cast("long")), lambda a, v: F.greatest(a, v))
        # the same from the right, over places counted down from beyond any text
        starts = _scan(F.transform(F.reverse(x), lambda v: F.when(v["own"], far - v["s"]).otherwise(0).cast("long")), lambda a, v: F.greatest(a, v))
        around = F.arrays_zip(x.alias("x"), ends.alias("e"), F.reverse(starts).alias("s"))
        return F.filter(around, lambda v: ~v["x"]["own"] & (v["e"] <= v["x"]["s"]) & (far - v["s"] >= v["x"]["e"]))

    both = F.array_sort(F.concat(F.transform(own, row(True)), F.transform(wide, row(False))))
    found = F.transform(_let(both, kept), lambda v: F.struct(v["x"]["s"].alias("s"), v["x"]["e"].alias("e"), v["x"]["m"].alias("m")))
    return F.when((F.size(own) == 0) | (F.size(wide) == 0), wide).otherwise(found)


def _base_of(kind: int, c: Column) -> Column:
    return c["base"] & (c["k"] == kind)


def candidates(rows: DataFrame) -> DataFrame:
    """``rows`` without their text but with its candidates, base spans first and each list by place, in one pass without a shuffle."""
    keep = [c for c in rows.columns if c != "text"]
    x = rows.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    some = F.col("_t").rlike(r"[0-9@]|[\x20(\[]at[\x20)\]]")
    hits = _matches(F.col("_t"))
    # all lists go through one expression each time, which keeps the plan small
    x = x.withColumn("_raw", F.when(some, F.array(*hits.values())))
    x = x.withColumn("_all", F.when(F.exists("_raw", lambda v: F.size(v) > 0), F.transform("_raw", _placed)))
    base, wide = _checked({k: F.get(F.col("_all"), F.lit(i)) for i, k in enumerate(hits)})
    x = x.withColumns({"_base": F.array(*base, F.array().cast(SPAN)), "_wide": F.array(*wide)})
    x = x.withColumn("_wide", F.zip_with("_base", "_wide", _apart))
    x = x.withColumn("_pieces", F.when(F.col("_all").isNotNull(), F.regexp_extract_all("_t", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))
    parts = []
    for i in range(len(ALL_KINDS)):
        for lists in ("_base", "_wide"):
            parts.append(F.expr(f"transform(get({lists}, {i}), x -> struct({i} AS k, x.s AS s, x.e AS e, x.m AS m, {lists == '_base'} AS base))"))
    x = x.withColumn("_found", F.concat(*parts))
    none = F.array().cast("array<struct<k:int,s:int,e:int,base:boolean,votes:string,f0:int,f1:int,f2:int>>")
    return x.select(*keep, F.when(F.size("_found") > 0, F.transform("_found", _candidate)).otherwise(none).alias("c"))


def fit_votes(counts: dict[tuple[int, str], int], rounds: int = ROUNDS) -> dict[tuple[int, str], float]:
    """Log-odds of each (kind, votes) by expectation-maximisation over labeler reliabilities.

    Every labeler has, for each kind, chances of a yes and a no under both truths; where it abstains it
    says nothing, so what it cannot see is not held against a span.  The first posteriors are the
    majority's, and counts are smoothed.
    """
    odds: dict[tuple[int, str], float] = {}
    for kind in {k for k, _ in counts}:
        rows = [([int(v) for v in votes.split(",")], n, votes) for (k, votes), n in sorted(counts.items()) if k == kind]
        post = [1 / (1 + math.exp(-1.5 * sum(v))) for v, _, _ in rows]
        for _ in range(rounds):
            total = sum(n for _, n, _ in rows)
            prior = (sum(p * n for p, (_, n, _) in zip(post, rows, strict=True)) + 1) / (total + 2)
            chance = [[{-1: 1.0, 1: 1.0} for _ in range(VOTES)] for _ in range(2)]
            for p, (v, n, _) in zip(post, rows, strict=True):
                for j in range(VOTES):
                    if v[j]:
                        chance[1][j][v[j]] += p * n
                        chance[0][j][v[j]] += (1 - p) * n
            scale = [[sum(c.values()) for c in side] for side in chance]
            logit = []
            for v, _, _ in rows:
                x = math.log(prior / (1 - prior))
                for j in (j for j in range(VOTES) if v[j]):
                    x += math.log(chance[1][j][v[j]] / scale[1][j]) - math.log(chance[0][j][v[j]] / scale[0][j])
                logit.append(max(-30.0, min(30.0, x)))
            post = [1 / (1 + math.exp(-x)) for x in logit]
        # labels are symmetric; the strict pattern's votes say which side is the positive one
        sign = 1 if sum(x * v[0] * n for x, (v, n, _) in zip(logit, rows, strict=True)) >= 0 else -1
        odds |= {(kind, votes): sign * x for x, (_, _, votes) in zip(logit, rows, strict=True)}
    return odds


def fit_spans(rows: list[tuple[int, str, str, int, int]], odds: dict[tuple[int, str], float]) -> dict[str, float]:
    """Weights "kind|feature|level" of the span classifier, learned from the posteriors of all candidates.

    A naive Bayes model over the span's own shape; the labelers' log-odds enter as its prior.
    """
    sums: dict[tuple[int, str, int], list[float]] = {}
    total: dict[tuple[int, str], list[float]] = {}
    for kind, votes, feature, level, n in rows:
        p = 1 / (1 + math.exp(-odds[kind, votes]))
        for store, key in ((sums, (kind, feature, level)), (total, (kind, feature))):
            cell = store.setdefault(key, [0.0, 0.0])
            cell[0] += (1 - p) * n
            cell[1] += p * n
    weights = {}
    for (kind, feature, level), (no, yes) in sums.items():
        n0, n1 = total[kind, feature]
        weights[f"{kind}|{feature}|{level}"] = math.log((yes + 1) / (n1 + LEVELS)) - math.log((no + 1) / (n0 + LEVELS))
    return weights


def _lookup(table: dict[str, float], key: Column) -> Column:
    if not table:
        return F.lit(0.0)
    entries = [F.lit(x) for pair in sorted(table.items()) for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), key), F.lit(0.0))


def _scored(rows: DataFrame, threshold: float) -> DataFrame:
    """``rows`` without their text, plus f: their base spans and the added ones, (k, s, e, base, score) by kind and place."""
    cands = stage_table(candidates(rows), "pii")
    flat = cands.select(F.explode("c").alias("c")).select("c.*")
    levels = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in ("f0", "f1", "f2")]))
    seen = [tuple(r) for r in flat.select("k", "votes", levels.alias("x")).groupBy("k", "votes", "x.f", "x.v").count().collect()]
    counts: dict[tuple[int, str], int] = {}
    for kind, votes, feature, _, n in seen:
        if feature == "f0":
            counts[kind, votes] = counts.get((kind, votes), 0) + n
    odds = fit_votes(counts)
    weights = fit_spans(seen, odds)
    prior = {f"{k}|{v}": x for (k, v), x in odds.items()}

    def score(c: Column) -> Column:
        kind = c["k"].cast("string")
        own = [_lookup(weights, F.concat_ws("|", kind, F.lit(f), c[f].cast("string"))) for f in ("f0", "f1", "f2")]
        return _lookup(prior, F.concat_ws("|", kind, c["votes"])) + sum(own, F.lit(0.0))

    scored = F.transform("c", lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"), c["base"].alias("base"), score(c).alias("score")))
    return cands.select(*[c for c in cands.columns if c != "c"], F.array_sort(F.filter(scored, lambda c: c["base"] | (c["score"] > threshold))).alias("f"))


def find_pii(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_spans and found.

    ``found`` has kind, start, end, base and score of every span, by kind and place, n_spans their number.  Base spans
    always stay; a wider candidate, or a key or token of the kind ``secret``, which has no base form, is added if the
    classifier's log-odds exceed ``threshold``.  Places are code points of the
    whole text, ends exclusive.  Null and empty texts have no spans; repeated rows are judged alike; an
    empty table gives an empty result; other columns are left aside.  The work on a text grows in proportion to its length.
    """
    x = _scored(docs.select("doc_id", "text"), threshold)
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    show = lambda spans: F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["k"]), c["s"].cast("string"), c["e"].cast("string"))), ",")
    base = F.filter("f", lambda c: c["base"])
    found = F.transform("f", lambda c: F.struct(F.get(names, c["k"]).alias("kind"), c["s"].alias("start"), c["e"].alias("end"), c["base"].alias("base"), c["score"].alias("score")))
    return x.select(
        "doc_id",
        *[F.size(F.filter("f", partial(_base_of, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(show(base).cast("binary"), 256).alias("base_sha256"),
        show(F.col("f")).alias("spans"),
        F.size("f").cast("long").alias("n_spans"),
        found.alias("found"),
    )


def mask(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets.

    Spans of any kinds that overlap are masked as one, under the kind of that which begins first (of equals the
    longest).  Spans belong to texts, not to ids: rows are matched by two hashes of the text, 128 bits together, so null
    and repeated ids make no difference.  Null and empty texts stay; an empty table gives an empty result.
    """
    key = {"_k1": F.xxhash64("text"), "_k2": F.xxhash64(F.lit(1), F.col("text"))}
    rows = docs.select(F.col("text").cast("string").alias("text")).withColumns(key)
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    spans = F.array_sort(F.transform("f", lambda c: F.struct(c["s"].alias("s"), (-c["e"]).alias("o"), c["e"].alias("e"), c["k"].alias("k"))))
    hits = _scored(rows, threshold).filter(F.size("f") > 0).dropDuplicates(["_k1", "_k2"]).select("_k1", "_k2", spans.alias("_f"))

    def merged(x):
        ends = _scan(F.transform(x, lambda v: v["e"].cast("long")), lambda a, v: F.greatest(a, v))
        reach = F.zip_with(x, ends, lambda v, r: F.struct(v["s"].alias("s"), v["k"].alias("k"), r.alias("r"), F.greatest(v["e"].cast("long"), r).alias("n")))
        # a span that begins where all before it have ended begins a masked one; that ends where the next begins
        return _let(reach, lambda y: F.filter(F.transform(y, lambda v, i: F.struct(v["s"].alias("s"), v["k"].alias("k"), v["r"].alias("r"), i.alias("i"))), lambda v: (v["i"] == 0) | (v["s"] >= v["r"])))

    def pieces(x):
        total = F.array_max(F.transform("_f", lambda v: v["e"].cast("long")))
        return F.transform(x, lambda v, i: F.struct(F.when(i == 0, 0).otherwise(v["r"]).cast("long").alias("from"), v["s"].cast("long").alias("to"), F.get(names, v["k"]).alias("kind"), F.when(i == F.size(x) - 1, total).alias("last")))

    chunks = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    named = F.when(F.col("_f").isNotNull(), _let(_let(F.col("_f"), merged), pieces))
    joined = docs.withColumns(key).join(hits, ["_k1", "_k2"], "left").withColumns({"_p": named, "_c": F.when(F.col("_f").isNotNull(), chunks)})
    show = F.transform("_p", lambda v: F.concat(_long_cut(F.col("_c"), v["from"], v["to"]), F.lit("["), v["kind"], F.lit("]")))
    tail = _long_cut(F.col("_c"), F.get(F.col("_p"), F.size("_p") - 1)["last"], F.size("_c").cast("long") * PIECE)
    text = F.when(F.col("_p").isNull(), F.col("text")).otherwise(F.concat(F.array_join(show, ""), tail))
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])


def _long_cut(pieces: Column, start: Column, end: Column) -> Column:
    """The text between two places, from its pieces."""
    first = F.floor(start / PIECE).cast("int")
    n = F.floor(end / PIECE).cast("int") - first + 1
    return F.substr(F.array_join(F.slice(pieces, first + 1, n), ""), (start - first * PIECE + 1).cast("int"), (end - start).cast("int"))
