"""Near duplicates by one-permutation hashing, banded buckets and star-shaped candidate edges.

Steps, each a distributed table:

1. one pass over the texts gives every document its number of distinct shingles, a 128-bit
   fingerprint of the set, and a one-permutation signature made dense by optimal densification;
2. documents with the same set fall into one class, so a group of exact copies is one row from
   here on;
3. bands of the signature make buckets.  Every bucket sends its members only to its centre, the
   member that meets the most others over all buckets, so edges grow with members, not pairs;
4. edges are confirmed on full shingle sets, read again from the texts;
5. connected components of the confirmed edges.  Members of buckets that still hold more than one
   component go through an exact prefix filter, and the few pairs that it leaves go to step 4
   again; so a link between two members neither of which is a centre is not lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import spread_join, stage_table

BINS = 128
ROWS = 4
STAR_PART = 512
BLOCK = 1024
PAIRS_HELD = 1 << 19

_U = np.uint64


def _probe_table(bins: int, tries: int) -> np.ndarray:
    """Bins that an empty bin looks into, in order: the 2-universal choice of optimal densification."""
    seeds = np.arange(bins * tries, dtype=_U) + _U(0xD1B54A32D192ED03)
    return (K.mix(seeds) >> _U(40)).astype(np.int64).reshape(bins, tries) % bins


_PROBES = _probe_table(BINS, 16 * BINS)
_EDGES = (np.arange(BINS + 1, dtype=object) * ((1 << 64) // BINS))
_EDGES = np.array([int(e) for e in _EDGES[:-1]], dtype=_U)


def signature(distinct: np.ndarray) -> np.ndarray:
    """Signature of a sorted, non-empty set of 64-bit hashes: the least hash in each bin, dense."""
    at = np.searchsorted(distinct, _EDGES)
    nxt = np.append(at[1:], len(distinct))
    full = nxt > at
    sig = np.zeros(BINS, np.uint32)
    sig[full] = ((distinct[at[full]] >> _U(20)) & _U(0xFFFFFFFF)).astype(np.uint32)
    empty = np.flatnonzero(~full)
    width = 16
    done = 0
    while len(empty) and done < _PROBES.shape[1]:
        look = _PROBES[empty, done : done + width]
        hit = full[look]
        first = hit.argmax(axis=1)
        ok = hit[np.arange(len(empty)), first]
        sig[empty[ok]] = sig[look[ok, first[ok]]]
        empty, done, width = empty[~ok], done + width, width * 4
    if len(empty):  # practically never
        sig[empty] = sig[np.flatnonzero(full)[0]]
    return sig


SKETCH = "doc_id long, bare boolean, n long, f1 long, f2 long, sig binary"


def _one(text: np.ndarray) -> int:
    """A second, independent hash of a text's only shingle, so sets of one have 128 bits as well."""
    words = K.WORD.findall(text.tobytes().translate(K.LOWER))[: K.SHINGLE]
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little")


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, bare = batch.column(0), batch.column(2)
        for first, data, offs in K.slices(batch, "text"):
            hashes, at = K.shingles(data, offs)
            rows = len(at) - 1
            n, f1, f2 = np.zeros(rows, np.int64), np.zeros(rows, _U), np.zeros(rows, _U)
            sigs: list[bytes | None] = [None] * rows
            for r in range(rows):
                h = hashes[at[r] : at[r + 1]]
                if not len(h):
                    continue
                h = np.sort(h)
                if len(h) > 1:
                    h = h[np.append(True, h[1:] != h[:-1])]
                n[r] = len(h)
                f1[r] = h.sum(dtype=_U)
                f2[r] = (h * h * _U(0x9E3779B97F4A7C15) + (h >> _U(7))).sum(dtype=_U) if len(h) > 1 else _one(data[offs[r] : offs[r + 1]])
                sigs[r] = signature(h).tobytes()
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, rows), bare.slice(first, rows), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(sigs, pa.binary())],
                names=["doc_id", "bare", "n", "f1", "f2", "sig"],
            )


def row_id() -> Column:
    """doc_id, or for a null one a number of 2^62 or more made from the text, so it comes after usual ids."""
    from_text = F.shiftrightunsigned(F.xxhash64(F.col("text").cast("string")), 2).bitwiseOR(F.lit(1 << 62))
    return F.coalesce(F.col("doc_id").cast("long"), from_text)


def sketch(docs: DataFrame) -> DataFrame:
    """One row a document; ``bare`` marks those without a doc_id, which have their ``row_id`` in its place."""
    src = docs.select(row_id().alias("doc_id"), F.col("text").cast("string"), F.col("doc_id").cast("long").isNull().alias("bare"))
    return src.mapInArrow(_sketches, SKETCH)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bands = BINS // ROWS
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, bands, ROWS).astype(_U)
        key = np.broadcast_to(np.arange(bands, dtype=_U), sig.shape[:2]).copy()
        for k in range(ROWS):
            key = K.mix(key * _U(0x9E3779B97F4A7C15) + sig[:, :, k] + _U(1))
        doc = np.repeat(batch.column(0).to_numpy(), bands)
        n = np.repeat(batch.column(1).to_numpy(), bands)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(doc), pa.array(n)], names=["key", "doc_id", "n"])


def _confirm(threshold: int):
    """Over rows sorted by (a, part, role): the centre's text comes before its members'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, np.zeros(0, _U)
        for batch in batches:
            if not batch.num_rows:
                continue
            a, part, b = (batch.column(i).to_numpy() for i in (0, 1, 2))
            for first, data, offs in K.slices(batch, "text"):
                hashes, at = K.shingles(data, offs)
                out = []
                for r in range(len(at) - 1):
                    h = np.unique(hashes[at[r] : at[r + 1]])
                    i = first + r
                    if b[i] < 0:
                        centre, own = (a[i], part[i]), h
                    elif centre == (a[i], part[i]) and len(h) and len(own):
                        both = np.searchsorted(own, h)
                        both[both == len(own)] = 0
                        same = int((own[both] == h).sum())
                        if 100 * same >= threshold * (len(own) + len(h) - same):
                            out.append((int(a[i]), int(b[i])))
                if out:
                    x = np.asarray(out, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

    return run


def confirm(edges: DataFrame, docs: DataFrame, threshold: int = 75) -> DataFrame:
    """The edges (a, b) whose full shingle sets have 100 * intersection >= threshold * union.

    ``a`` is the centre of a star.  A centre's members are dealt to parts of about ``STAR_PART``
    by their number, and its text goes to each part once, so no star meets in one task.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = stage_table(edges.groupBy("a").agg(F.count("*").alias("c")), "stars")
    parts = F.ceil(F.col("c") / F.lit(STAR_PART)).cast("int")
    dealt = spread_join(edges, size, ["a"], "c").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    dealt = stage_table(dealt, "dealt")
    # the sides of these joins grow with the input, so none is ever broadcast
    members = dealt.hint("merge").join(texts, dealt.b == texts.doc_id).select("a", "part", "b", "text")
    heads = dealt.select("a", "part").distinct()
    heads = heads.hint("merge").join(texts, heads.a == texts.doc_id).select("a", "part", F.lit(-1).cast("long").alias("b"), "text")
    rows = members.unionByName(heads).repartition("a", "part").sortWithinPartitions("a", "part", "b")
    return rows.mapInArrow(_confirm(threshold), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, label) of all nodes of the edges (a, b): the smallest node that each can reach.

    Alternates large-star and small-star steps, each of which keeps the components and adds at
    most one edge per edge, until every component is a star around its smallest node, however many rounds
    that takes; written tables cut the lineage each round.
    """
    def canonical(e: DataFrame) -> DataFrame:
        return e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    e = stage_table(canonical(edges), "edges")
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        larger, smaller = (F.sum((F.col("b") > F.col("a")).cast("long")), F.sum((F.col("b") < F.col("a")).cast("long")))
        low = stage_table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), larger.alias("c"), smaller.alias("s")), "low")
        # in a star the centre has larger neighbours only, and any other node has the centre only
        if low.filter("s > 1 OR (s > 0 AND c > 0)").isEmpty():
            return low.select(F.col("a").alias("doc_id"), F.col("m").alias("label"))
        large = spread_join(both.filter("b > a"), low.filter("c > 0").select("a", "m", "c"), ["a"], "c").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage_table(canonical(large), "edges")
        m = stage_table(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c")), "least")
        joined = spread_join(large, m, ["a"], "c")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(m.select("a", F.col("m").alias("b")))
        e = stage_table(canonical(small), "edges")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, n, token): one row a distinct shingle."""
    for batch in batches:
        doc, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for first, data, offs in K.slices(batch, "text"):
            hashes, at = K.shingles(data, offs)
            sets = [np.unique(hashes[at[r] : at[r + 1]]) for r in range(len(at) - 1)]
            n = np.array([len(h) for h in sets], np.int64)
            rows = slice(first, first + len(sets))
            cols = [np.repeat(doc[rows], n), np.repeat(label[rows], n), np.repeat(n, n), np.concatenate(sets).view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc_id", "label", "n", "token"])


def _meet(threshold: int):
    """Pairs of different labels that share a token, by the position filter; rows sorted by (token, i, j)."""

    def pairs(x: pd.DataFrame) -> pd.DataFrame:
        key = pd.factorize(pd.MultiIndex.from_frame(x[["token", "i", "j"]]))[0] if len(x) else np.zeros(0, int)
        doc, lab, n, pos, blk, bi, bj = (x[c].to_numpy() for c in ("doc_id", "label", "n", "pos", "blk", "i", "j"))
        out, held, left, shift = [], 0, np.arange(len(x)), 1
        while True:
            left = left[left + shift < len(x)]
            left = left[key[left] == key[left + shift]]
            if not len(left):
                break
            p, q = left, left + shift
            ok = (lab[p] != lab[q]) & ((bi[p] == bj[p]) | (blk[p] != blk[q]))
            p, q = p[ok], q[ok]
            need = -(-threshold * (n[p] + n[q]) // (100 + threshold))
            ok = (1 + np.minimum(n[p] - pos[p], n[q] - pos[q]) >= need) & (100 * np.minimum(n[p], n[q]) >= threshold * np.maximum(n[p], n[q]))
            p, q = doc[p[ok]], doc[q[ok]]
            if len(p):
                out.append(np.column_stack([np.minimum(p, q), np.maximum(p, q)]))
                held += len(p)
            if held > PAIRS_HELD:  # one pair meets at many shingles
                out = [np.unique(np.concatenate(out), axis=0)]
                held = len(out[0]) // 2
            shift += 1
        got = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": got[:, 0], "b": got[:, 1]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for x in batches:
            x = x if held is None else pd.concat([held, x], ignore_index=True)
            if not len(x):
                continue
            last = (x["token"] == x["token"].iloc[-1]) & (x["i"] == x["i"].iloc[-1]) & (x["j"] == x["j"].iloc[-1])
            held = x[last]
            yield pairs(x[~last])
        if held is not None:
            yield pairs(held)

    return run


def missed_pairs(labels: DataFrame, docs: DataFrame, threshold: int = 75) -> DataFrame:
    """Pairs (a, b) of different labels that may still reach the threshold: an exact prefix filter.

    ``labels`` (doc_id, label) are documents of different texts.  A shingle is open if documents
    of two labels or more have it; only open shingles can be shared across labels, so a document of which
    less than the threshold is open has no link left.  The others order their shingles with
    the closed first and then the rarest first.  Two sets that reach the threshold share a
    shingle in a prefix, at positions that leave enough to come; only such pairs are returned.
    Hot shingles are compared in blocks of ``BLOCK``.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = labels.hint("merge").join(texts, "doc_id").select("doc_id", "label", "text").mapInArrow(_tokens, "doc_id long, label long, n long, token long")
    rows = stage_table(rows, "tokens")
    for _ in range(2):
        df = rows.groupBy("token").agg(F.count("*").alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("token", "df")
        opened = spread_join(rows, stage_table(df, "open"), ["token"], "df", "left_semi")
        enough = opened.groupBy("doc_id").agg(F.count("*").alias("opened"), F.first("n").alias("m")).filter(f"100 * opened >= {threshold} * m").select("doc_id", "opened")
        rows = stage_table(opened.join(enough.select("doc_id").hint("merge"), "doc_id", "left_semi"), "tokens")
    df = stage_table(rows.groupBy("token").agg(F.count("*").alias("df")), "counts")
    order = Window.partitionBy("doc_id").orderBy("df", "token")
    own = Window.partitionBy("doc_id")
    placed = spread_join(rows, df, ["token"], "df").withColumn("pos", F.col("n") - F.count("*").over(own) + F.row_number().over(order))
    prefix = stage_table(placed.filter(f"pos <= n - ceil({threshold} * n / 100) + 1").select("token", "doc_id", "label", "n", "pos"), "prefix")
    size = prefix.groupBy("token").agg(F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("token", "c")
    nb = F.ceil(F.col("c") / F.lit(BLOCK)).cast("int")
    x = spread_join(prefix, stage_table(size, "sizes"), ["token"], "c").withColumn("nb", nb).withColumn("blk", F.pmod(F.xxhash64("doc_id"), F.col("nb")).cast("int"))
    x = x.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumns({"i": F.least("blk", "o"), "j": F.greatest("blk", "o")})
    x = x.select("token", "i", "j", "blk", "doc_id", "label", "n", "pos").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return x.mapInPandas(_meet(threshold), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    Null, empty and wordless texts have an empty set and are linked with nothing.  Documents
    with fewer than five words have their whole sequence as the one shingle.  Repeated rows with
    one doc_id are rows of one document and come back as often.  Rows with a null doc_id and one text
    are a document too; it is linked like any other under its ``row_id``, which stands in component_id where
    no member has an id, and comes back with a null doc_id.  An empty table gives an empty result.
    Other columns are left aside.
    """
    rows = stage_table(sketch(docs), "sketch")
    sets = rows.filter("n > 0")
    # rows without words are a class too, so that they are dealt like any other large class below
    classes = stage_table(rows.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")), "classes")
    reps = sets.join(classes.filter("n > 0").select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    reps = stage_table(reps.select("doc_id", "n", "sig"), "reps")

    buckets = reps.select("doc_id", "n", "sig").mapInArrow(lambda it: _bands(_pick(it)), "key long, doc_id long, n long")
    sizes = stage_table(buckets.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    buckets = stage_table(spread_join(buckets, sizes, ["key"], "size"), "buckets")
    met = buckets.select("doc_id").distinct().hint("merge")
    texts = docs.select(row_id().alias("doc_id"), F.col("text").cast("string"))
    # of the texts only those that meet another are read from here on
    texts = stage_table(texts.join(met, "doc_id", "left_semi"), "texts")
    reach = buckets.groupBy("doc_id").agg(F.sum("size").alias("reach"))
    ranked = buckets.join(reach, "doc_id")
    centre = ranked.groupBy("key").agg(F.max(F.struct("reach", (-F.col("doc_id")).alias("neg"), F.col("n"))).alias("c"), F.first("size").alias("rows"))
    stars = (
        spread_join(buckets.drop("size"), stage_table(centre, "centres"), ["key"], "rows")
        .select((-F.col("c.neg")).alias("a"), F.col("doc_id").alias("b"), F.col("c.n").alias("na"), F.col("n").alias("nb"))
        .filter(f"a <> b AND 100 * least(na, nb) >= {threshold} * greatest(na, nb)")
        .select("a", "b")
        .distinct()
    )
    stars = stage_table(stars, "stars")
    links = stage_table(confirm(stars, texts, threshold), "links")
    found = stage_table(components(links), "labels")

    labelled = buckets.join(found, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("c")).filter("lo < hi").select("key", "c")
    rest = spread_join(labelled, stage_table(open_keys, "open"), ["key"], "c", "left_semi").select("doc_id", "label").distinct()
    pairs = missed_pairs(rest, texts, threshold)
    tried = stars.unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = stage_table(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    more = stage_table(confirm(pairs, texts, threshold), "links")
    if more.limit(1).count():
        joined = found.select(F.col("doc_id").alias("a"), F.col("label").alias("b"))
        found = stage_table(components(joined.unionByName(more)), "labels")

    label = classes.join(found.withColumnRenamed("doc_id", "rep"), "rep", "left").select("n", "f1", "f2", "c", F.coalesce("label", "rep").alias("component_id"))
    got = spread_join(rows.select("doc_id", "bare", "n", "f1", "f2"), stage_table(label, "classes"), ["n", "f1", "f2"], "c")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    own = F.when(~F.col("bare"), F.col("doc_id")).alias("doc_id")
    return got.select(own, F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.select(["doc_id", "n", "sig"])
