"""Exact-substring dedup with sampled suffix arrays in a logarithmic family of levels.

A byte goes if a string of ``length`` bytes over it also starts anywhere else.  Comparing all
suffixes is needless: winnowing names, for every window of ``length`` bytes, one suffix inside it by content
alone, so equal windows name the same suffix at the same distance.  The named suffixes (about one
in 120) are what is indexed:

1. One pass finds every document's named suffixes.  A run is a stretch of windows with the same
   named suffix; its context is all bytes of its windows.
2. New batches get suffix arrays: sorted tables of their suffixes' heads.  Each is merge-scanned
   against the levels there are, which tells the heads that occur again, and becomes a level; levels of
   equal rank merge, so N batches have log N levels and each entry is written log N times.  Suffixes are ordered by a
   fingerprint of their first ``head`` bytes, since only equality of heads counts and the bytes
   themselves would take several times the corpus.
3. Runs with heads that occur again fall into classes of equal context.  All windows of a class
   with two members or more are repeats.
4. Where one head has several classes, one context of each is looked at window by window, which
   extends the matches both ways byte by byte.  Heads with very many classes compare their windows as rows
   instead, so no group meets in one task.

The same steps over a hash of each word in place of each byte find the passages of so many words that start
elsewhere too.  They are told apart from what is removed, since a passage of words may be shorter than ``length`` bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import delete, new_path, release, scope, stage_table

LENGTH = 400
HEAD = 160
BATCHES = 4
HOT = 4096
CHUNK = 2 << 20
#: The least passage of over fifty words.
WORDS = 51

_U = np.uint64
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_I1, _I2 = pow(_B1, -1, 1 << 64), pow(_B2, -1, 1 << 64)
_HIGH = _U(0xFFFFFFFF00000000)
_LOW = _U(0xFFFFFFFF)


class Prints:
    """128-bit fingerprints of any substring of a buffer from two prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        wide = data.astype(_U) + _U(1)
        self.sums = []
        for base, inverse in ((_B1, _I1), (_B2, _I2)):
            total = np.zeros(n + 1, _U)
            np.cumsum(wide * K.powers(base, n)[:n], out=total[1:])
            self.sums.append((total, K.powers(inverse, n)))

    def first(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total, inverse = self.sums[0]
        return K.mix((total[end] - total[start]) * inverse[start])

    def second(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total, inverse = self.sums[1]
        return K.mix((total[end] - total[start]) * inverse[start])


def _slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of ``w`` values, from minima of blocks run forward and back."""
    m = len(x) - w + 1
    blocks = np.append(x, np.full(-len(x) % w, np.iinfo(np.uint64).max, _U)).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:m], ahead[w - 1 : w - 1 + m])


def runs(data: np.ndarray, offs: np.ndarray, length: int, head: int) -> tuple[np.ndarray, ...]:
    """(row, g, c1, c2, lo, m) of the runs of all rows: windows lo .. lo + m of the row share a named suffix."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    p = Prints(data)
    total, inverse = p.sums[0]
    heads = K.mix((total[head:] - total[:-head]) * inverse[: n - head + 1])
    # least hash, leftmost of equals: the high half is the hash, the low half the place
    packed = (heads & _HIGH) | np.arange(len(heads), dtype=_U)
    named = (_slide_min(packed, length - head + 1) & _LOW).astype(np.int64)
    # windows inside one row
    sizes = np.maximum(np.diff(offs) - length + 1, 0)
    row = np.repeat(np.arange(len(sizes)), sizes)
    first = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=first[1:])
    start = np.arange(first[-1]) - np.repeat(first[:-1] - offs[:-1], sizes)
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    at = named[start]
    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])))
    lo, hi = start[new], start[np.append(new[1:], len(start)) - 1]
    at, row = at[new], row[new]
    shape = (at - lo).astype(_U) * _U(1 << 32) + (hi - lo).astype(_U)
    c1 = K.mix(p.first(lo, hi + length) + K.mix(shape + _U(1)))
    c2 = K.mix(p.second(lo, hi + length) + K.mix(shape + _U(2)))
    return row, heads[at].view(np.int64), c1.view(np.int64), c2.view(np.int64), lo - offs[row], hi - lo


def _units(data: np.ndarray, offs: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """What windows are made of and where rows begin: the bytes, or a 64-bit hash of each word with A-Z lowered."""
    if not words:
        return data, offs
    starts, ends = K.word_bounds(data, offs)
    return K.word_hashes(data, starts, ends), np.searchsorted(starts, offs)


def _chunks(data: np.ndarray, offs: np.ndarray, length: int):
    """(first row, row offset in units, units, offsets): slices, with a huge text cut in overlapping chunks."""
    if len(data) <= 2 * CHUNK or len(offs) != 2:
        yield 0, data, offs
        return
    for s in range(0, len(data), CHUNK):
        part = data[s : s + CHUNK + length - 1]
        yield s, part, np.array([0, len(part)], np.int64)


RUNS = "d long, t long, g long, c1 long, c2 long, lo long, m long"


def _find_runs(length: int, head: int, words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, data, offs in K.slices(batch, "text", CHUNK):
                for shift, part, at in _chunks(*_units(data, offs, words), length):
                    row, g, c1, c2, lo, m = runs(part, at, length, head)
                    if len(row):
                        cols = [d[first + row], t[first + row], g, c1, c2, lo + shift, m]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["d", "t", "g", "c1", "c2", "lo", "m"])

    return run


class IndexFamily:
    """Suffix arrays of batches in levels of geometric size, as sorted tables in the shared folder."""

    def __init__(self, spark):
        self.spark = spark
        self.levels: list[tuple[int, str]] = []
        self.hits: list[DataFrame] = []

    def _write(self, df: DataFrame) -> str:
        path = new_path(self.spark, "level")
        df.repartition("g").sortWithinPartitions("g").write.parquet(path)
        return path

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema("g long, n int").parquet(path)

    def add(self, heads: DataFrame) -> None:
        """Index the heads (g) of a batch; heads that occur again in it or in any level are hits."""
        path = self._write(heads.groupBy("g").agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("n")))
        own = self._read(path)
        hits = own.filter("n > 1").select("g")
        for _, other in self.levels:
            hits = hits.unionAll(own.join(self._read(other).select("g"), "g").select("g"))
        self.hits.append(stage_table(hits.distinct(), "hits"))
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            _, other = self.levels.pop()
            both = self._read(other).unionAll(self._read(path)).groupBy("g").agg(F.least(F.sum("n"), F.lit(2)).cast("int").alias("n"))
            merged = self._write(both)
            delete(self.spark, other)
            delete(self.spark, path)
            path, rank = merged, rank + 1
        self.levels.append((rank, path))

    def shared(self) -> DataFrame:
        out = self.hits[0]
        for h in self.hits[1:]:
            out = out.unionAll(h)
        return out.distinct()


def _contexts(length: int, words: bool):
    """Over (d, t, text, w): w lists the runs of a text to show; one row (g, k, n, hot, ctx) a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            held = 0
            for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                units, _ = _units(raw, np.array([0, len(raw)], np.int64), words)
                for w in wanted.as_py():
                    ctx = units[w["lo"] : w["lo"] + w["m"] + length].tobytes()
                    rows.append((w["g"], w["k"], w["n"], w["hot"], ctx))
                    held += len(ctx)
                if held > CHUNK:
                    yield _context_rows(rows)
                    rows, held = [], 0
            if rows:
                yield _context_rows(rows)

    return run


def _context_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["g", "k", "n", "hot", "ctx"])


def _windows(ctx: list[bytes], length: int, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, offset, w1, w2) of every window of the contexts."""
    data = np.frombuffer(b"".join(ctx), _U if words else np.uint8)
    sizes = np.array([len(c) for c in ctx], np.int64) // data.itemsize
    offs = np.zeros(len(ctx) + 1, np.int64)
    np.cumsum(sizes, out=offs[1:])
    counts = sizes - length + 1
    first = np.zeros(len(ctx) + 1, np.int64)
    np.cumsum(counts, out=first[1:])
    which = np.repeat(np.arange(len(ctx)), counts)
    off = np.arange(first[-1]) - first[which]
    start = offs[which] + off
    p = Prints(data)
    return which, off, p.first(start, start + length), p.second(start, start + length)


def _compare(length: int, words: bool):
    """Repeats among the contexts of each head; rows come sorted by head."""

    def solve(k: list[int], n: list[int], ctx: list[bytes]) -> pa.RecordBatch:
        which, off, w1, w2 = _windows(ctx, length, words)
        order = np.lexsort((w2, w1))
        a, b = w1[order], w2[order]
        same = np.append(False, (a[1:] == a[:-1]) & (b[1:] == b[:-1]))
        again = np.zeros(len(a), bool)
        again[order] = same | np.append(same[1:], False)
        single = np.asarray(n) == 1
        rows = np.flatnonzero(again & single[which])
        w, o = which[rows], off[rows]
        # rows keep the order of contexts, then offsets
        new = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else np.zeros(0, np.int64)
        last = np.append(new[1:], len(w)) - 1
        keys = np.asarray(k, np.int64)[w[new]] if len(w) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(o[new]), pa.array(o[last] if len(w) else new)], names=["k", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k: list[int] = []
        n: list[int] = []
        ctx: list[bytes] = []
        held, last = 0, None
        for batch in batches:
            for g, kk, nn, c in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if g != last and held > CHUNK:
                    yield solve(k, n, ctx)
                    k, n, ctx, held = [], [], [], 0
                last = g
                k.append(kk)
                n.append(nn)
                ctx.append(c)
                held += len(c)
        if k:
            yield solve(k, n, ctx)

    return run


def _explode(length: int, words: bool):
    """One row (w1, w2, k, n, off) a window, for heads with very many classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                part = batch.slice(s, 2048)
                which, off, w1, w2 = _windows(part.column(2).to_pylist(), length, words)
                k, n = part.column(0).to_numpy()[which], part.column(1).to_numpy()[which]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (w1.view(np.int64), w2.view(np.int64), k, n, off)], names=["w1", "w2", "k", "n", "off"])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, head: int = HEAD, batches: int = BATCHES, words: bool = False) -> DataFrame:
    """(d, t, marks): for documents with repeats, spans (s, e) of bytes, or of words, whose union is what repeats.

    ``docs`` has d, t and text; d and t tell documents apart.  ``length`` and ``head`` count bytes, or words.
    """
    spark = docs.sparkSession
    early = f"suffixes-{uuid.uuid4().hex}"
    with scope(early):
        found = stage_table(docs.select("d", "t", "text").mapInArrow(_find_runs(length, head, words), RUNS), "runs")
        family = IndexFamily(spark)
        for b in range(batches):
            family.add(found.filter(F.pmod(F.xxhash64("d", "t"), F.lit(batches)) == b).select("g"))
        # written first, so that both sides of the join are plain exchanges and hot heads can be split
        shared = stage_table(family.shared(), "shared")
    again = stage_table(found.join(shared, "g", "left_semi"), "again")
    release(spark, early)

    classes = again.groupBy("g", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "lo", "m")).alias("r"))
    classes = stage_table(classes.withColumn("k", F.monotonically_increasing_id()), "classes")
    many = stage_table(classes.groupBy("g").agg(F.count("*").alias("nc")).filter("nc > 1"), "many")
    look = classes.join(many, "g").select("g", "k", "n", (F.col("nc") > HOT).alias("hot"), "r.*")
    wanted = look.groupBy("d", "t").agg(F.collect_list(F.struct("g", "k", "n", "hot", "lo", "m")).alias("w"))
    # every copy of a repeated row shows its contexts; that changes nothing, as their classes count twice anyway
    shown = docs.select("d", "t", "text").join(wanted, ["d", "t"])
    shown = stage_table(shown.select("text", "w").mapInArrow(_contexts(length, words), "g long, k long, n long, hot boolean, ctx binary"), "contexts")

    few = shown.filter("NOT hot").select("g", "k", "n", "ctx").repartition("g").sortWithinPartitions("g")
    few = few.mapInArrow(_compare(length, words), "k long, lo long, hi long")
    rows = shown.filter("hot").select("k", "n", "ctx").mapInArrow(_explode(length, words), "w1 long, w2 long, k long, n long, off long")
    twice = rows.groupBy("w1", "w2").agg(F.count("*").alias("m")).filter("m > 1").select("w1", "w2")
    hot = rows.filter("n = 1").join(twice, ["w1", "w2"], "left_semi").groupBy("k").agg(F.min("off").alias("lo"), F.max("off").alias("hi"))
    ends = few.unionByName(hot)

    single = classes.join(ends, "k").select("r.d", "r.t", (F.col("r.lo") + F.col("lo")).alias("s"), (F.col("r.lo") + F.col("hi") + length).alias("e"))
    whole = again.join(classes.filter("n > 1").select("g", "c1", "c2"), ["g", "c1", "c2"], "left_semi")
    whole = whole.select("d", "t", F.col("lo").alias("s"), (F.col("lo") + F.col("m") + length).alias("e"))
    return single.unionByName(whole).groupBy("d", "t").agg(F.collect_set(F.struct("s", "e")).alias("marks"))


OUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<s:long,e:long>>"


def _union(marks) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for m in sorted((m["s"], m["e"]) for m in marks or ()):
        if spans and m[0] <= spans[-1][1]:
            if m[1] > spans[-1][1]:
                spans[-1] = (spans[-1][0], m[1])
        else:
            spans.append(m)
    return spans


def _passage_bytes(text: pa.Buffer, marks) -> int:
    """Bytes from the first to the last word of each run of words that ``marks`` cover."""
    spans = _union(marks)
    if not spans:
        return 0
    raw = np.frombuffer(text, np.uint8)
    starts, ends = K.word_bounds(raw, np.array([0, len(raw)], np.int64))
    return int(sum(ends[e - 1] - starts[s] for s, e in spans))


def _remove(keep_bytes: bool, words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for doc, text, marks, passages in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in (1, 2, 3)), strict=True):
                raw = memoryview(text.as_buffer())
                spans = _union(marks.as_py())
                digest, at, parts = hashlib.sha256(), 0, []
                for s, e in [*spans, (len(raw), len(raw))]:
                    digest.update(raw[at:s])
                    if keep_bytes:
                        parts.append(bytes(raw[at:s]))
                    at = e
                row = (doc, len(raw), sum(e - s for s, e in spans), len(spans), digest.hexdigest(), [{"s": s, "e": e} for s, e in spans])
                row += (b"".join(parts),) if keep_bytes else ()
                out.append((*row, _passage_bytes(text.as_buffer(), passages.as_py())) if words else row)
                held += len(raw)
                if held > 2 * CHUNK or len(out) >= 4096:
                    yield _removed_rows(out, keep_bytes, words)
                    out, held = [], 0
            if out:
                yield _removed_rows(out, keep_bytes, words)

    return run


def _removed_rows(out: list[tuple], keep_bytes: bool, words: bool) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))] + [pa.binary()] * keep_bytes + [pa.int64()] * words
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"] + ["kept"] * keep_bytes + ["n_passage_bytes"] * words
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def dedup_substrings(docs: DataFrame, length: int = LENGTH, head: int = HEAD, batches: int = BATCHES, keep_bytes: bool = True, words: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and, if asked for, the kept bytes of every row.

    Texts are UTF-8 bytes, null ones empty; a match never crosses rows.  Strings are judged on the
    input, so all copies go, and overlapping repeats count.  Kept bytes may break a character.  Repeated rows
    are documents of their own, each of which repeats the other.  Texts shorter than ``length``
    lose nothing; an empty table gives an empty result; other columns are left aside.

    With ``words``, ``n_passage_bytes`` tells how many bytes stand in passages of so many words that also start elsewhere,
    whatever the white space between words and the case of A-Z.  Nothing is removed for that: such a passage may be shorter than ``length``.
    """
    src = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    src = src.withColumns({"d": F.coalesce("doc_id", F.lit(-(1 << 63))), "t": F.xxhash64("text")})
    marks = stage_table(repeated_spans(src, length, head, batches), "marks")
    if words:
        passages = stage_table(repeated_spans(src, words, max(1, words * 2 // 5), batches, words=True).withColumnRenamed("marks", "passages"), "passages")
        marks = marks.join(passages, ["d", "t"], "full")
    else:
        marks = marks.withColumn("passages", F.lit(None).cast(marks.schema["marks"].dataType))
    joined = src.join(marks, ["d", "t"], "left").select("doc_id", "text", "marks", "passages")
    return joined.mapInArrow(_remove(keep_bytes, words > 0), "doc_id long, " + OUT + (", kept binary" if keep_bytes else "") + (", n_passage_bytes long" if words else ""))
