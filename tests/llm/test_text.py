import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import packing, pii, quality, tokens, url_filter, warc

from .conftest import prose

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- quality


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = Counter(wins)
    over = {k for i, x in enumerate(wins) if many[x] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(over)


def test_base_counts(docs, corpus):
    got = quality.judge(docs.withColumn("kept", F.lit("clash")).withColumn("g", F.lit(1))).collect()
    assert len(got) == len(corpus)
    want = {r[0]: brute_quality(r[1]) for r in corpus}
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == w
        assert r["base_failed"] == (w[0] < 20 or 100 * w[4] > 30 * w[0]) and (not r["kept"] or not r["base_failed"])


def test_outliers_go_and_prose_stays(spark, none):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.choice([25, 80, 300])), "en" if i % 3 else "de", "s0" if i % 2 else "s1") for i in range(600)]
    rows += [(1000 + i, " ".join(w + "###" for w in prose(rng, 80).split()), "en", "s0") for i in range(40)]
    rows += [(2000 + i, prose(rng, 40), None, None) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality.judge(df).filter("kept").collect()}
    assert not kept & set(range(1000, 1040)) and set(range(600)) <= kept and set(range(2000, 2005)) <= kept
    assert {r["doc_id"] for r in quality.keep_good(df).collect()} == kept and quality.keep_good(df).columns == df.columns
    assert quality.judge(none).count() == 0 and quality.keep_good(none).count() == 0


@pytest.mark.parametrize("percent", [30, 45])
def test_a_group_with_much_junk_does_not_hide_it(spark, percent):
    rng = random.Random(percent)
    n = 400 * percent // 100
    rows = [(i, prose(rng, rng.choice([25, 80, 300])), "en", "s0") for i in range(400 - n)]
    rows += [(1000 + i, " ".join(w + rng.choice(["#", "$%", "", "***"]) for w in prose(rng, rng.choice([30, 80])).split()), "en", "s0") for i in range(n)]
    kept = {r["doc_id"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).filter("kept").collect()}
    assert kept == set(range(400 - n))


@pytest.mark.parametrize("others", [300, 20])
def test_leftover_rows_and_tiny_tables_are_judged(spark, others):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.choice([25, 80])), "en", "s0") for i in range(others)]
    rows += [(1000 + i, " ".join(w + "###" for w in prose(rng, 80).split()), "xx", None) for i in range(5)]
    rows += [(2000 + i, prose(rng, 40), None, None) for i in range(5)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r["doc_id"] for r in got if r["kept"]} == {*range(others), *range(2000, 2005)} and all(r["distance"] is not None for r in got)


def test_salted_joins_give_the_same_verdicts(docs, monkeypatch):
    want = {r["doc_id"]: (r["kept"], round(r["distance"] or 0, 6)) for r in quality.judge(docs).collect()}
    monkeypatch.setattr(quality, "MAX_BROADCAST", 0)
    assert {r["doc_id"]: (r["kept"], round(r["distance"] or 0, 6)) for r in quality.judge(docs).collect()} == want


def test_chi_square_values():
    assert abs(quality._chi2_cdf(9.487729, 4) - 0.95) < 1e-6 and abs(quality._chi2_sf_inverse(0.05, 4) - 9.487729) < 1e-4


# ---- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(v - 9 if v > 9 else v for v in (int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d)))) % 10 == 0


def brute_pii(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def adversarial():
    rng = random.Random(7)
    parts = ["a@b.co", "x..y@z.w.v", "@", ".", "..", "a.b", "1.2.3.4", "256.1.1.1", "01.002.3.0004", "1.2.3.4.5.6.7.8", "4111111111111111", "4111 1111-1111 1111", "4111  1111", "-", " ",
             "+1 (555) 123-4567", "+", "+12", "é", "日本", "\U0001f600", "_", "a_b@c-d.e_f@g.hi", "\n", "5500005555555559", "12", "+49.30.1234567", "\uf8ff", "%@a.b", "0000000000000000", "a@.b", "a@b."]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(400)]


def test_base_spans_against_regular_expressions(spark):
    texts = [*adversarial(), "", None, "9" * 6000, "1." * 4000, "a." * 4000 + "@" + "b." * 4000 + "c", "1 " * 5000, "a" * 30000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("c", F.lit("clash"))
    rows = pii.find_pii(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_pii(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (texts[r["doc_id"]] or "")[:80]
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(w.startswith(k) for w in want) for k in PATTERNS]
        assert set(want) <= set(r["spans"].split(",")) | {""} if want else True


def test_labelers_add_the_likely_and_leave_the_unlikely(spark, none):
    rng = random.Random(3)
    filler = lambda: prose(rng, 8, 99)
    rows = [f"{filler()} call phone +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} {filler()}" for _ in range(60)]
    rows += [f"{filler()} phone ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}, {filler()}" for _ in range(10)]
    rows += [f"order token x{rng.randrange(100, 999)}-555-{rng.randrange(1000, 9999)}y {filler()}" for _ in range(10)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_pii(df).collect()}
    assert all(got[i]["n_phone"] == 1 for i in range(60)) and all(got[i]["n_phone"] == 0 for i in range(60, 80))
    assert sum(bool(got[i]["spans"]) for i in range(60, 70)) >= 8 and not any(got[i]["spans"] for i in range(70, 80))
    assert pii.find_pii(none).count() == 0
    masked = {r["doc_id"]: r["text"] for r in pii.mask(df).collect()}
    assert "[phone]" in masked[0] and "555-" not in masked[0] and masked[75] == rows[75]


def test_masking_follows_texts_not_ids(spark):
    rows = [(None, "mail a@b.co now"), (1, "x a@b.co"), (1, "nothing here"), (1, "x a@b.co"), (2, ""), (3, None), (4, "a" * 1500 + " +49 30 1234567 a@b.co\u00e9 1.2.3.4" + "b" * 3000 + " c@d.org")]
    # an address that is part of a longer email: one mark, no rest in clear
    rows.append((5, "user+49301234567@example.com and 4111 1111 1111 1111"))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("c", F.lit("clash"))
    got = pii.mask(df)
    assert got.columns == df.columns
    want = ["mail [email] now", "x [email]", "nothing here", "x [email]", "", None, "a" * 1500 + " [phone] [email]\u00e9 [ip]" + "b" * 3000 + " [email]", "[email] and [card]"]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, ((r[0], w) for r, w in zip(rows, want, strict=True))))


def test_very_many_spans_in_one_text(spark):
    n = 40_000
    df = spark.createDataFrame([(1, "1.2.3.4 " * n), (2, "a@b.co, " * n)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_pii(df).collect()}
    assert got[1]["n_ip"] == n and got[2]["n_email"] == n
    assert got[1]["base_sha256"] == hashlib.sha256(",".join(f"ip:{8 * i}:{8 * i + 7}" for i in range(n)).encode()).hexdigest()


def test_wide_spans_apart_from_base_ones(spark):
    rng = random.Random(4)

    def some(n):
        places = sorted(rng.sample(range(3000), 2 * n))
        return [(s, e, "m") for s, e in zip(places[::2], places[1::2], strict=True)]

    rows = [(i, some(rng.choice([0, 1, 40, 600])), some(rng.choice([0, 1, 50, 700]))) for i in range(30)]
    kind = "array<struct<s:int,e:int,m:string>>"
    got = spark.createDataFrame(rows, f"i int, own {kind}, wide {kind}").select("i", pii._apart(F.col("own"), F.col("wide")).alias("x")).collect()
    for r in got:
        _, own, wide = rows[r["i"]]
        assert [tuple(x) for x in r["x"]] == [w for w in wide if not any(o[0] < w[1] and w[0] < o[1] for o in own)]


def test_secrets_and_obfuscated_addresses_are_added(spark):
    rng = random.Random(13)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    filler = lambda: prose(rng, 12, 99)
    planted, rows = {}, []
    for i in range(120):
        before = filler() + rng.choice([" token = \"", " api_key: \"", " password=\""])
        rows.append(before + key() + "\" " + filler())
        planted[i] = f"secret:{len(before)}:{len(before) + 40}"
    rows += [f"{filler()} contact joe{i} at mail{i} dot com, {filler()}" for i in range(40)]
    rows += [f"{filler()} write to joe{i}@mail{i}.com, {filler()}" for i in range(120)]
    rows += [f"{filler()} see http://a.org/some-long/path-of/words-and-more/{i} {filler()}" for i in range(60)]
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.find_pii(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    caught = sum(planted[i] in got[i] for i in planted)
    assert caught >= 0.95 * len(planted) and all(len(got[i]) == 1 for i in planted)
    assert sum(any(s.startswith("email") for s in got[i]) for i in range(120, 160)) >= 36
    assert not any(s for i in range(280, 340) for s in got[i] if s)


def test_expectation_maximisation_finds_the_good_labeler():
    counts = {}
    rng = random.Random(5)
    for _ in range(4000):
        y = rng.random() < 0.5
        v = [(1 if y else -1) if rng.random() < q else (-1 if y else 1) for q in (0.95, 0.9, 0.85, 0.6, 0.5)]
        key = (0, ",".join(map(str, v)))
        counts[key] = counts.get(key, 0) + 1
    odds = pii.fit_votes(counts)
    assert odds[0, "1,1,1,1,1"] > 3 and odds[0, "-1,-1,-1,-1,-1"] < -3 and odds[0, "1,1,-1,-1,-1"] > 0


# ---- archives


def test_archives_round_trip(spark, none):
    html = ["<p>a</p>", "<p>a</p>", "b\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n", "", None, "é" * 5000, "<p>a</p>", "line\nline\r\n"]
    rows = [(i, f"http://h{i}.org/p?q=1#f", h) for i, h in enumerate(html)] + [(50, None, "<p>a</p>"), (51, "http://x/\r\nEvil: 1", "z"), (None, "http://n/", "null id"), (7, "http://h7.org/", "line\nline\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = warc.round_trip(df, payload=True).collect()
    assert len(got) == len(rows)
    last = {}
    for p, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if p is None else p)
    for r in got:
        text = next(h or "" for p, _, h in rows if p == r["page_id"])
        raw = text.encode()
        assert r["response"]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode() and r["response"]["payload_bytes"] == len(raw)
        assert r["request"]["record_type"] == "request" and r["metadata"]["record_type"] == "metadata"
        if r["page_id"] not in (7, None):
            head = last[text] == r["page_id"]
            assert r["response"]["record_type"] == ("response" if head else "revisit") and r["refers_to"] == (None if head else last[text])
            assert r["response"]["payload"] == (text if head else None)
    assert sorted(r["response"]["record_type"] for r in got if r["page_id"] == 7) == ["response", "revisit"]
    assert {r["response"]["record_type"] for r in warc.round_trip(df, min_revisit_bytes=10**6).collect()} == {"response"}
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(empty).count() == 0


def test_large_pages_have_files_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LARGE", 1000)
    monkeypatch.setattr(warc, "FILE_BYTES", 16_000)
    sizes = [10] * 50 + [999, 1000, 1001, 3999, 4000, 4001, 16_001, 70_000, 70_000]
    rows = [(i, f"http://h/{i}", chr(97 + i % 7) * n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    for least in (0, 5000, 10**6):
        got = {r["page_id"]: r for r in warc.round_trip(df, least).collect()}
        assert {i: r["response"]["payload_bytes"] for i, r in got.items()} == dict(enumerate(sizes))
        assert {i: r["response"]["payload"] for i, r in got.items() if r["response"]["record_type"] == "response"}.items() <= {r[0]: r[2] for r in rows}.items()
    warc.write_archives(df, f"file://{tmp_path}/w")
    held = [sum(len(b) for _, b in warc.parse_records(warc._members(f.read_bytes()))) for f in (tmp_path / "w").glob("*.gz")]
    assert len(held) > 5 and all(h < 40_000 or h < 72_000 for h in held)


def test_records_without_a_response_still_come_out(spark):
    rows = [("<r>", "request", "<gone>", None), ("<m>", "metadata", "<gone>", None), ("<v>", "revisit", None, "<nowhere>")]
    df = spark.createDataFrame(rows, "record_id string, record_type string, concurrent_to string, refers_to string")
    kinds = {"target_uri": "string", "warc_date": "string", "payload_digest": "string", "payload_bytes": "long", "page_id": "long", "fields": "map<string,string>", "payload": "string"}
    got = {r["capture_id"]: r for r in warc.assemble(df.withColumns({k: F.lit(None).cast(v) for k, v in kinds.items()})).collect()}
    assert got["<gone>"]["response"] is None and got["<gone>"]["request"] is not None and got["<v>"]["refers_to"] is None


def test_gzip_members():
    import gzip

    assert warc._members(gzip.compress(b"a") + gzip.compress(b"b")) == b"ab"


# ---- urls


def brute_url(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = [(len(h.split(".")) if h else 0, len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h) or not h) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


def test_urls_against_brute_force(spark):
    rng = random.Random(2)
    rules = [*url_filter.RULES, ("block", "a.example.org", "/"), ("allow", "example.org", "/es/x"), ("block", "com", "/d"), ("allow", "net", "")]
    urls = [None, "", "nope", "http://", "http://ORG", "http://org/", "http://Example.ORG/es/", "http://x.example.org/en/12?q", "https://é.com/de/", "ftp://a://b/c", "http://xorg/", "http://a.example.org/es/x#y", "http://n.net", "http://org?/x"]
    urls += [f"http://{rng.choice(['', 'a.', 'b.a.'])}{rng.choice(['example.org', 'z.com', 'net'])}{rng.choice(['', '/'])}{rng.choice(['es/', 'es', 'en/1', 'en/13/z', 'de/', 'd', 'fr/'])}" for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    for r in url_filter.judge_urls(df, rules, default="block").collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_url(urls[r["page_id"]], rules, "block"), urls[r["page_id"]]
    with pytest.raises(ValueError):
        url_filter.judge_urls(df, [("deny", "a", "/")])
    assert url_filter.judge_urls(df.limit(0)).count() == 0


# ---- tokens

WORD_FILE, BYTE_FILE = "word_bpe_49k.json", "byte_bpe_50k.json"


def plain(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def test_token_counts(docs, corpus, none):
    t = plain(WORD_FILE)
    got = tokens.token_counts(docs.withColumn("n_tokens", F.lit("clash")), public_tokenizers.path(WORD_FILE)).collect()
    want = {r[0]: len(t.encode(r[1] or "", add_special_tokens=False)) for r in corpus}
    assert len(got) == len(corpus)
    for r in got:
        assert (r["n_tokens"], r["over_limit"]) == (want[r["doc_id"]], want[r["doc_id"]] > 2048)
    sizes = {r[0]: len((r[1] or "").encode()) for r in corpus}
    assert {r["doc_id"]: r["n_bytes"] for r in got} == sizes
    assert tokens.token_counts(none, public_tokenizers.path(WORD_FILE)).count() == 0


@pytest.mark.parametrize("name", [WORD_FILE, BYTE_FILE])
def test_overlapping_chunks_give_the_whole(name):
    t = plain(name)
    rng = random.Random(6)
    texts = [prose(rng, 900), "x" * 3000, "ab " * 1200, "1234567890" * 300, " " * 2500 + "end", "é日本 " * 600, "a\n\n\n b   c\t" * 300, "<|endoftext|> and " * 200, prose(rng, 200) + "y" * 1500 + prose(rng, 200), "e\u0301 " * 700, "word<|startoftext|>" * 150, "\U0001f600" * 800]
    for text in texts:
        whole = len(t.encode(text, add_special_tokens=False))
        for chunk, overlap in ((300, 40), (700, 16), (1024, 128)):
            assert tokens.count_tokens(text, t, chunk, overlap) == whole, (text[:20], chunk)


@pytest.mark.parametrize("name", [WORD_FILE, BYTE_FILE])
def test_texts_without_white_space_cost_little_more_than_once(name):
    t, rng = plain(name), random.Random(12)

    class Counting:
        chars = 0

        def encode(self, text, **options):
            Counting.chars += len(text)
            return t.encode(text, **options)

    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = [pick("ABCdefgh0123456789+/", 60_000), pick("abcdefgh", 60_000), pick("0123456789", 60_000), pick("日本語文字列。", 60_000), "a" * 60_000, " " * 60_000, "e" + "\u0301" * 60_000, "#*$%" * 15_000]
    for text in texts:
        Counting.chars = 0
        assert tokens.count_tokens(text, Counting(), 4096, 256) == len(t.encode(text, add_special_tokens=False)), text[:20]
        assert Counting.chars < 3 * len(text), text[:20]


# ---- packing


def test_ids_are_the_library_s(corpus):
    t, ids = plain(BYTE_FILE), packing.Ids(public_tokenizers.path(BYTE_FILE))
    assert ids.ranks is not None
    rng = random.Random(8)
    alphabet = "ab c'ts  \n\t.,;:!?0123456789ÀéßñÿŒ“”—…€'ll"
    texts = [r[1] or "" for r in corpus] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["a<|endoftext|>b", "\u2028x", "\x1c y", "日本", "İ"]
    for text in texts:
        assert ids(text) == np.asarray(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text[:40]
    assert packing.Ids(public_tokenizers.path(WORD_FILE)).ranks is None


def check_packing(rows, texts, t, capacity):
    by_doc, seqs = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for d, ps in by_doc.items():
        ids = t.encode(texts[d] or "", add_special_tokens=False).ids + [2]
        ps.sort(key=lambda r: r["piece"])
        assert [p["piece"] for p in ps] == list(range(len(ps))) and len(ps) == -(-len(ids) // capacity)
        at = 0
        for p in ps:
            part = ids[at : at + p["length"]]
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(np.asarray(part, "<u4").tobytes()) and p["ids"] == part
            at += p["length"]
        assert at == len(ids) and all(p["length"] == capacity for p in ps[1:])
    for ps in seqs.values():
        at = 0
        for p in sorted(ps, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    return len(seqs)


def test_packing(spark, docs, corpus, none):
    t = plain(BYTE_FILE)
    texts = {r[0]: r[1] for r in corpus}
    df = docs.dropDuplicates(["doc_id"]).withColumn("piece", F.lit("clash"))
    for capacity, shard in ((256, 50_000), (1024, 10)):
        rows = packing.pack_documents(df, public_tokenizers.path(BYTE_FILE), 2, capacity, shard=shard).collect()
        check_packing(rows, texts, t, capacity)
    assert packing.pack_documents(none, public_tokenizers.path(BYTE_FILE)).count() == 0
    again = packing.pack_documents(docs, public_tokenizers.path(BYTE_FILE)).collect()  # repeated rows are packed each by itself
    places = Counter((r["sequence_id"], r["offset"]) for r in again)
    assert max(places.values()) == 1 and len({r["doc_id"] for r in again}) == len(texts)


def test_packing_is_tight_and_follows_the_rule():
    rng = np.random.default_rng(4)
    sizes = np.sort(rng.integers(1, 1024, 20_000))[::-1]
    which, at = packing.place_all(sizes)
    fill = np.bincount(which, weights=sizes)
    assert fill.max() <= 1024 and (fill > 0).sum() <= 1.02 * math.ceil(sizes.sum() / 1024)
    for b in rng.choice(np.unique(which), 50):
        own = np.flatnonzero(which == b)
        ends = sorted((int(at[i]), int(at[i] + sizes[i])) for i in own)
        assert ends[0][0] == 0 and all(x[1] == y[0] for x, y in zip(ends, ends[1:], strict=False))
    bins = packing.SumOfSquares(10)
    squares = lambda: int((bins.counts[1:10] ** 2).sum())
    for size in rng.integers(1, 10, 300).tolist():
        n, before = bins.counts.copy(), squares()
        options = [2 * (n[h - size] * (h > size) - n[h]) + (2 if h > size else 1) for h in range(size, 10) if n[h]]
        options.append(2 * n[10 - size] + 1)
        bins.place(size)
        if not n[size]:
            assert squares() - before == min(options)
