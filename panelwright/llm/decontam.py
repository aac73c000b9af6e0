"""Benchmark decontamination: size-partitioned MinHash containment search, exactly verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

SHARD_ITEMS = 50_000
SHARD_BYTES = 32 << 20
FILTER_BITS = 22

_U = np.uint64


class Index:
    """Items of one shard, partitioned by the power of two of their set size.

    Each partition has one sketch length for all its items: the least s MinHash values of an item
    with s = floor((100 - threshold) * upper / 100) + 1, where upper is the partition's largest size.  A
    document that holds ``threshold`` per cent of an item lacks at most s - 1 of its shingles, so it
    holds at least one of the sketch: the search misses nothing.
    """

    def __init__(self, items: list[tuple[int, str | None]], threshold: int):
        self.threshold = threshold
        self.ids: list[int] = []
        self.sets: list[np.ndarray] = []
        self.partitions: dict[int, list[int]] = {}
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            got, _ = K.shingles(raw, np.array([0, len(raw)], np.int64))
            got = np.unique(got)
            if len(got):
                self.partitions.setdefault(int(len(got)).bit_length(), []).append(len(self.ids))
                self.ids.append(item)
                self.sets.append(got)
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        for p, members in self.partitions.items():
            upper = max(len(self.sets[m]) for m in members)
            s = (100 - threshold) * upper // 100 + 1
            key = np.concatenate([self.sets[m][:s] for m in members])
            who = np.repeat(members, [min(s, len(self.sets[m])) for m in members])
            order = np.argsort(key, kind="stable")
            self.keys[p] = key[order], who[order]
            self.filter[key >> _U(64 - FILTER_BITS)] = True

    def search(self, hashes: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item_id, shared, size of the item) of all items that rows contain."""
        near = np.flatnonzero(self.filter[hashes >> _U(64 - FILTER_BITS)])
        if not len(near):
            return []
        row = np.searchsorted(at, near, side="right") - 1
        near = hashes[near]
        pairs = []
        for key, who in self.keys.values():
            lo, hi = np.searchsorted(key, near, "left"), np.searchsorted(key, near, "right")
            n = hi - lo
            if n.any():
                i = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                pairs.append(np.column_stack([np.repeat(row, n), who[i]]))
        if not pairs:
            return []
        found, own, last = [], None, -1
        for r, m in np.unique(np.concatenate(pairs), axis=0).tolist():
            if r != last:
                own, last = np.unique(hashes[at[r] : at[r + 1]]), r
            item = self.sets[m]
            i = np.searchsorted(own, item)
            i[i == len(own)] = 0
            shared = int((own[i] == item).sum())
            if 100 * shared >= self.threshold * len(item):
                found.append((r, self.ids[m], shared, len(item)))
        return found


def _shards(items: DataFrame, threshold: int):
    """Broadcast indexes over shards of the items; both the number and the bytes of a shard are bounded.

    A single item longer than the byte bound is a shard by itself.
    """
    spark = items.sparkSession
    src = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).withColumn("b", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    n, total = src.agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    shards = max(1, -(-n // SHARD_ITEMS), -(-total // SHARD_BYTES))
    for _ in range(20):
        dealt = src.withColumn("s", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
        worst = dealt.groupBy("s").agg(F.count("*").alias("m"), F.sum("b").alias("b")).filter(f"m > 1 AND (m > {2 * SHARD_ITEMS} OR b > {2 * SHARD_BYTES})")
        if shards == 1 or not worst.limit(1).count():
            break
        shards *= 2
    for s in range(shards if n else 0):
        rows = dealt.filter(F.col("s") == s).select("item_id", "text").collect()
        yield spark.sparkContext.broadcast(Index([(r[0], r[1]) for r in rows], threshold))


def find_leaks(docs: DataFrame, items: DataFrame, threshold: int = 75) -> DataFrame:
    """Pairs (doc_id, item_id, n_shared, n_item): documents that contain benchmark items.

    ``docs`` has doc_id and text, ``items`` item_id and text.  A pair is a hit if 100 * shared >=
    ``threshold`` * the item's number of distinct five-word shingles.  The documents are read once for each shard of
    items and never shuffled.  Items and documents without words match nothing; repeated rows of
    either side repeat their pairs; empty tables give an empty result.
    """
    schema = "doc_id long, item_id long, n_shared long, n_item long"
    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def searcher(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for first, data, offs in K.slices(batch, "text"):
                    hits = index.value.search(*K.shingles(data, offs))
                    if hits:
                        cols = list(zip(*hits, strict=True))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([ids[first + r] for r in cols[0]], pa.int64()), *(pa.array(c, pa.int64()) for c in cols[1:])],
                            names=["doc_id", "item_id", "n_shared", "n_item"],
                        )
        return run

    found = None
    for index in _shards(items, threshold):
        part = src.mapInArrow(searcher(index), schema)
        found = part if found is None else found.unionAll(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def drop_leaks(docs: DataFrame, items: DataFrame, threshold: int = 75) -> DataFrame:
    """``docs`` without the rows that contain a benchmark item; all columns stay, nothing is shuffled."""
    def dropper(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for first, data, offs in K.slices(batch, "text"):
                    for r, *_ in index.value.search(*K.shingles(data, offs)):
                        keep[first + r] = False
                yield batch.filter(pa.array(keep))
        return run

    out = docs
    for index in _shards(items, threshold):
        out = out.mapInArrow(dropper(index), docs.schema)
    return out


SQL = r"""
WITH t AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
w AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM t),
s AS (
  SELECT DISTINCT side, id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
                                        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT id, count(*) AS n_item FROM s WHERE side = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, max(n.n_item) AS n_item
FROM s d JOIN s i ON d.sh = i.sh AND d.side = 'd' AND i.side = 'i' JOIN n ON n.id = i.id
GROUP BY d.id, i.id HAVING 100 * count(*) >= 75 * max(n.n_item)
"""
