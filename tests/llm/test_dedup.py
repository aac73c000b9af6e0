import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import common, decontam, kernels as K, line_dedup, near_dup, queries, suffix_dedup

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_shingle_kernel_agrees_with_sets(spark):
    texts = ["A b c d e f", "a B c d e", "a b", "", " \t", "é ü x y z w", "x" * 50, None, "b c d e f"]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for limit in (1, 20, 1 << 20):
        seen = []
        for _, data, offs in K.slices(batch, "text", limit):
            h, at = K.shingles(data, offs)
            seen += [h[at[r] : at[r + 1]].tolist() for r in range(len(at) - 1)]
        assert [len(set(s)) for s in seen] == [len(shingle_set(t)) for t in texts]
        assert set(seen[0]) & set(seen[1]) and not set(seen[2]) & set(seen[0]) and seen[8][0] in seen[0]


def test_words_with_a_pattern_don_t_collide(spark):
    """Thue-Morse words and their complements agree in any polynomial hash modulo a power of two."""
    word = lambda a, b, n: "".join(b if i.bit_count() % 2 else a for i in range(n))
    rows = [(k, w) for k, w in enumerate(word(*p, n) for n in (8, 64, 1024, 2048, 4096) for p in ("ab", "ba"))]
    rows += [(100, "a" * 8), (101, "a" * 16), (102, "a" * 9), (103, "A" * 9)]
    got = got_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute_components(rows) and [d for d, x in got.items() if not x[2]] == [103]


def test_hot_keys_are_dealt_and_lose_nothing(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0] * 9 + list(range(300))), i) for i in range(5000)] + [(None, -1)]
    big = spark.createDataFrame(rows, "k int, i int").repartition(4)
    small = big.filter("k is not null").groupBy("k").agg(F.count("*").alias("c")).filter("k % 3 = 0")
    for how in ("inner", "left_semi"):
        got = common.spread_join(big, small, ["k"], "c", how)
        assert got.columns == (["k", "i", "c"] if how == "inner" else ["k", "i"])
        assert sorted((r["k"], r["i"]) for r in got.collect()) == sorted(r for r in rows if r[0] is not None and r[0] % 3 == 0)
    assert common.spread_join(big.limit(0), small.limit(0), ["k"], "c").count() == 0


# ---- near duplicates


def brute_components(rows, threshold=75):
    sets = {d: shingle_set(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= threshold * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def got_components(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(df).collect()}


def test_near_duplicates_against_all_pairs(docs, corpus, none):
    got = near_dup.near_duplicates(docs.withColumn("n", F.lit("clash")).withColumn("label", F.lit(1))).collect()
    assert len(got) == len(corpus)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute_components([(r[0], r[1]) for r in corpus])
    assert near_dup.near_duplicates(none).count() == 0


def test_chains_and_links_between_members_of_a_hub(spark):
    """Copies of copies and a family around a hub, with ids that make the hub anything but the smallest."""
    rng = random.Random(2)
    base = prose(rng, 260).split(" ")

    def edit(words, k):
        w = list(words)
        for _ in range(k):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        return w

    rows = [(1000, base)]
    for i in range(60):
        rows.append((i, edit(base, rng.choice([3, 6, 8, 10, 14]))))
    for i in range(20):
        rows.append((100 + i, edit(rows[1 + i][1], rng.choice([4, 7, 9]))))
    rows = [(d, " ".join(w)) for d, w in rows]
    want = brute_components(rows)
    assert 3 < len({c for _, c, _ in want.values()}) < 70
    assert got_components(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_components_go_on_until_edges_settle(spark, monkeypatch):
    """A round number bounded by a range, here cut to one, must not end the loop early."""
    monkeypatch.setattr(near_dup, "range", lambda *a: [0], raising=False)
    edges = spark.createDataFrame([(i, i + 1) for i in random.Random(6).sample(range(40), 40)], "a long, b long")
    assert {(r["doc_id"], r["label"]) for r in near_dup.components(edges).collect()} == {(i, 0) for i in range(41)}


def test_prefix_filter_loses_no_link(spark):
    rng = random.Random(8)
    rows = []
    for f in range(12):
        base = prose(rng, 120).split(" ")
        for k in range(6):
            w = list(base)
            for _ in range(rng.randrange(1, 7)):
                w[rng.randrange(len(w))] = f"u{rng.randrange(1000)}"
            rows.append((f * 10 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = df.select("doc_id", F.col("doc_id").alias("label"))
    got = {(r["a"], r["b"]) for r in near_dup.missed_pairs(labels, df).collect()}
    sets = {d: shingle_set(t) for d, t in rows}
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert linked and linked <= got and len(got) < len(rows) * 6


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:900], rng.integers(0, 2**63, 100).astype(np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((near_dup.signature(a) == near_dup.signature(b)).mean() - true) < 0.15
    one = near_dup.signature(a[:1])
    assert len(set(one.tolist())) == 1


# ---- substrings


def brute_substrings(rows, length):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[p : p + length] for _, b in data for p in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if len(b) else b""
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("length", "head", "batches"), [(400, 160, 4), (60, 24, 3)])
def test_substrings_against_all_windows(docs, corpus, length, head, batches):
    got = suffix_dedup.dedup_substrings(docs.withColumn("g", F.lit(0)), length, head, batches).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_substrings([(r[0], r[1]) for r in corpus], length)
    for r in got:
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and sum(s["e"] - s["s"] for s in r["spans"]) == r["n_removed"]


def test_substrings_by_rows_for_hot_heads(docs, corpus, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    got = suffix_dedup.dedup_substrings(docs, 60, 24, 2, keep_bytes=False).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_substrings([(r[0], r[1]) for r in corpus], 60)


def brute_passages(rows, size):
    """Bytes of each row in runs of words of which every word stands in a window of ``size`` words that also starts elsewhere."""
    cut = [[(m.start(), m.end(), bytes(m[0]).lower()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for _, t in rows]
    seen = Counter(tuple(w for _, _, w in ws[i : i + size]) for ws in cut for i in range(len(ws) - size + 1))
    out = []
    for (doc, _), ws in zip(rows, cut, strict=True):
        on = {j for i in range(len(ws) - size + 1) if seen[tuple(w for _, _, w in ws[i : i + size])] > 1 for j in range(i, i + size)}
        out.append((doc, sum(ws[j][1] - (ws[j - 1][1] if j - 1 in on else ws[j][0]) for j in on)))
    return sorted(out)


@pytest.mark.parametrize(("words", "hot"), [(51, 4096), (8, 1)])
def test_passages_against_all_windows(docs, corpus, monkeypatch, words, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = suffix_dedup.dedup_substrings(docs, 60, 24, 2, keep_bytes=False, words=words).collect()
    rows = [(r[0], r[1]) for r in corpus]
    assert sorted((r["doc_id"], r["n_passage_bytes"]) for r in got) == brute_passages(rows, words)
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_substrings(rows, 60)


def test_query_tells_passages_that_are_too_short_to_remove(spark, tmp_path):
    """Over fifty words in under 400 bytes, between other line ends, stand in two texts; a third text is clean."""
    rng = random.Random(5)
    words = prose(rng, 56).split()
    rows = [(1, prose(rng, 80) + " " + " ".join(words) + "\n" + prose(rng, 80)), (2, prose(rng, 90) + "\n" + "\n".join(words).title() + " " + prose(rng, 60)), (3, prose(rng, 200)), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op2_suffix_array_dedup(spark, str(tmp_path)).collect()}
    size = len(" ".join(words))
    assert size < 400 and [got[i]["n_passage_bytes"] for i in (1, 2, 3, 4)] == [size, size, 0, 0] and {r["n_removed"] for r in got.values()} == {0}


def test_huge_text_is_cut_in_chunks(monkeypatch):
    rng = random.Random(4)
    data = np.frombuffer(prose(rng, 3000).encode(), np.uint8)
    whole = suffix_dedup.runs(data, np.array([0, len(data)]), 100, 40)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 2000)
    windows = set()
    for s, part, at in suffix_dedup._chunks(data, np.array([0, len(data)]), 100):
        _, _, _, _, lo, m = suffix_dedup.runs(part, at, 100, 40)
        for a, n in zip(lo, m, strict=True):
            windows |= set(range(s + a, s + a + n + 1))
    assert windows == set(range(len(data) - 99)) == {p for a, n in zip(whole[4], whole[5], strict=True) for p in range(a, a + n + 1)}


def test_levels_grow_geometrically(spark):
    family = suffix_dedup.IndexFamily(spark)
    for b in range(5):
        family.add(spark.createDataFrame([(b * 3 + i,) for i in range(5)], "g long"))
    assert [r for r, _ in family.levels] == [2, 0]
    count = Counter(b * 3 + i for b in range(5) for i in range(5))
    assert {r["g"] for r in family.shared().collect()} == {g for g, n in count.items() if n > 1}


def test_substrings_of_nothing(none):
    assert suffix_dedup.dedup_substrings(none).count() == 0


# ---- lines


def brute_lines(rows, t=3):
    units = {}
    for d, text in rows:
        if text is None:
            units[d] = None
            continue
        out = []
        for line in text.split("\n"):
            if out and not line.strip(" \t\x0b\x0c\r"):
                out[-1] += "\n" + line
            else:
                out.append(line)
        units[d] = out
    first = {}
    for d in sorted(units):
        u = [x.strip(" \t\n\x0b\x0c\r") for x in units[d] or ()]
        for j in range(len(u) - t + 1):
            first.setdefault(tuple(u[j : j + t]), (d, j))
    out = {}
    for d, us in units.items():
        if us is None:
            out[d] = (None, 0, 0)
            continue
        u = [x.strip(" \t\n\x0b\x0c\r") for x in us]
        gone = {k for j in range(len(u) - t + 1) if first[tuple(u[j : j + t])] != (d, j) for k in range(j, j + t)}
        out[d] = ("\n".join(x for i, x in enumerate(us) if i not in gone), len(us), len(gone))
    return out


def test_lines_against_brute_force(docs, corpus, none):
    got = line_dedup.dedup_lines(docs.withColumn("n_lines", F.lit(9)).withColumn("runs_", F.lit(9)))
    assert set(got.columns) == {"doc_id", "text", "lang", "source", "runs_", "n_lines", "n_removed"}
    rows = got.collect()
    want = brute_lines([(r[0], r[1]) for r in corpus])
    assert len(rows) == len(corpus) and {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in rows} == want
    assert sum(w[2] for w in want.values()) > 20
    assert line_dedup.dedup_lines(none).count() == 0


def test_blank_lines_and_short_repeats(spark):
    rows = [(1, "a\n\nb\n\nc\nd"), (2, "x\na\nb\n\n\nc\ny"), (3, "a\nb"), (4, "\n\na\nb\nc"), (None, "q\nr\ns"), (5, "q\nr\ns")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[2] == "x\ny" and got[3] == "a\nb" and got[5] == "q\nr\ns" and got[None] == ""
    assert got[4].strip() == ""


def brute_long_lines(rows, t=3, bound=50):
    """Kept texts where a run goes if it has t lines or more than bound words; one line a unit, no blank lines."""
    first, units = {}, {d: text.split("\n") for d, text in sorted(rows)}
    wins = lambda u: ((j, n) for n in range(1, t + 1) for j in range(len(u) - n + 1) if n == t or sum(len(WORD.findall(x)) for x in u[j : j + n]) > bound)
    for d, u in units.items():
        for j, n in wins(u):
            first.setdefault(tuple(u[j : j + n]), (d, j))
    gone = {d: {k for j, n in wins(u) if first[tuple(u[j : j + n])] != (d, j) for k in range(j, j + n)} for d, u in units.items()}
    return {d: ("\n".join(x for i, x in enumerate(u) if i not in gone[d]), len(u), len(gone[d])) for d, u in units.items()}


def test_long_repeats_of_one_and_two_lines(spark):
    rng = random.Random(4)
    line = lambda n: prose(rng, n, 999)
    long, edge, pair, short = line(52), line(50), [line(30), line(21)], [line(30), line(20)]
    rows = [(1, [line(9), long, line(9)]), (2, [long]), (3, [line(9), long]), (4, pair), (5, [line(9), *pair, line(9)]), (6, [line(9), pair[1], pair[0]]),
            (7, short), (8, [*short, line(9)]), (9, [edge]), (10, [edge]), (11, [long, line(9), long]), (12, [line(9), line(9), line(9)])]
    rows += [(20 + i, [rng.choice([long, edge, *pair, *short, line(12)]) for _ in range(rng.randrange(1, 9))]) for i in range(60)]
    rows = [(d, "\n".join(u)) for d, u in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(df, long_words=line_dedup.LONG_WORDS).collect()}
    assert got == brute_long_lines(rows)
    assert [got[d][2] for d in range(1, 13)] == [0, 1, 1, 0, 2, 0, 0, 0, 0, 0, 2, 0]
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect() if r["doc_id"] < 13}[3] == rows[2][1]


# ---- decontamination


def brute_leaks(rows, items, threshold=75):
    out = []
    for d, t in rows:
        s = shingle_set(t)
        for i, x in items:
            q = shingle_set(x)
            if q and 100 * len(s & q) >= threshold * len(q):
                out.append((d, i, len(s & q), len(q)))
    return sorted(out)


def test_leaks_against_brute_force(spark, docs, corpus, none):
    rng = random.Random(9)
    w = (corpus[3][1]).split()
    items = [(0, " ".join(w[2:20])), (1, " ".join(["Other", *w[5:24]]).upper()), (2, prose(rng, 20)), (3, ""), (4, None), (5, "one"), (6, corpus[5][1]), (7, " ".join(w[2:20]))]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("lang", F.lit("en"))
    want = brute_leaks([(r[0], r[1]) for r in corpus], items)
    assert len({i for _, i, _, _ in want}) >= 4
    assert sorted(tuple(r) for r in decontam.find_leaks(docs, table).collect()) == want
    kept = decontam.drop_leaks(docs, table)
    assert kept.columns == docs.columns
    bad = {d for d, *_ in want}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in corpus if r[0] not in bad)
    assert decontam.find_leaks(none, table).count() == 0 and decontam.find_leaks(docs, table.limit(0)).count() == 0 and decontam.drop_leaks(docs, table.limit(0)).count() == len(corpus)


def test_items_in_shards_give_the_same(spark, docs, corpus, monkeypatch):
    items = [(i, corpus[i][1]) for i in range(12)]
    table = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam, "SHARD_ITEMS", 5)
    monkeypatch.setattr(decontam, "SHARD_BYTES", 4000)
    assert sorted(tuple(r) for r in decontam.find_leaks(docs, table).collect()) == brute_leaks([(r[0], r[1]) for r in corpus], items)


def test_sketch_cannot_miss():
    rng = np.random.default_rng(5)
    text = " ".join(f"w{i}" for i in range(44))
    index = decontam.Index([(1, text)], 75)
    own = index.sets[0]
    for _ in range(200):
        some = rng.permutation(own)[: -(-75 * len(own) // 100)]
        assert index.search(np.sort(some), np.array([0, len(some)]))
    assert not index.search(rng.permutation(own)[: 74 * len(own) // 100], np.array([0, 74 * len(own) // 100]))
