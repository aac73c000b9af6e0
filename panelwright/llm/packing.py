"""Best-fit packing of token sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table
from .tokens import tokenizer

CAPACITY = 1024
SHARD_PIECES = 50_000
SLACK = 8
#: Pre-token pattern of the byte-level tokenizers (fixed value, public).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on whose classes all regular-expression engines agree.
PLAIN = r"[\n\r\t\x20-\x7e¡-¬®-ſ‐-‧€]*"


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit bytes, as the library of the file gives them.

    Plain texts of a byte-level file whose ids follow the order of its merges are encoded by the
    faster rank encoder over the same vocabulary, which gives the same ids (held against the library in the
    tests).  All other files, texts with characters outside ``PLAIN`` and texts with an added special string
    go to the library.
    """

    def __init__(self, path: str):
        import json

        import regex

        self.t = tokenizer(path)
        spec = json.loads(self.t.to_str())
        self.special = [a["content"] for a in spec.get("added_tokens", ())]
        self.plain = regex.compile(PLAIN).fullmatch
        self.ranks = self._ranks(spec)

    @staticmethod
    def _ranks(spec: dict):
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer") or model.get("type") != "BPE":
            return None
        if model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            return None
        added = {a["content"] for a in spec.get("added_tokens", ())}
        vocab = {w: i for w, i in model["vocab"].items() if w not in added}
        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if sorted(vocab.values()) != list(range(256 + len(joined))) or any(vocab.get(w) != 256 + i for i, w in enumerate(joined)):
            return None
        import tiktoken

        alphabet = _byte_alphabet()
        table = {bytes(alphabet[c] for c in w): i for w, i in vocab.items()}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.ranks is None or not self.plain(text) or any(s in text for s in self.special):
            return np.asarray(self.t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return array("I", self.ranks.encode_ordinary(text)).tobytes()


def tokenize_pieces(df: DataFrame, path: str, end_id: int | None = 2, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids: one row a piece.

    A document is its token ids and ``end_id``.  Only documents longer than ``capacity`` are cut,
    into pieces of ``capacity`` with the shorter rest first.  Null text counts as empty and is the
    end id alone; without an ``end_id`` an empty document has no pieces.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(path)
        for batch in batches:
            out: list[tuple] = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = ids(value.as_py() or "") + tail
                n = len(data) // 4
                rest = n % capacity
                at, piece = 0, 0
                while at < n:
                    length = rest if not piece and rest else capacity
                    part = data[4 * at : 4 * (at + length)]
                    row = (doc, piece, at, length, zlib.crc32(part))
                    out.append((*row, np.frombuffer(part, "<u4").astype("i8")) if with_ids else row)
                    at += length
                    piece += 1
                if len(out) >= 4096:
                    yield _rows(out, with_ids)
                    out = []
            if out:
                yield _rows(out, with_ids)

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _rows(out: list[tuple], with_ids: bool) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True))
    arrays = [pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(cols[:5])]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if with_ids:
        arrays.append(pa.array(list(cols[5]), pa.list_(pa.int64())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each of the descending ``sizes`` by tightest gap, and the number of bins."""
    counts, gaps, fresh = np.zeros(capacity + 1, np.int64), [[] for _ in range(capacity + 1)], 0
    which, at = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        fits = counts[size:]
        k = int(fits.argmax() if fits[0] else (fits > 0).argmax())
        gap = size if fits[0] else size + k
        if counts[gap]:
            b = gaps[gap].pop()
            counts[gap] -= 1
        else:
            b, gap, fresh = fresh, capacity, fresh + 1
        which[i], at[i] = b, capacity - gap
        if gap > size:
            gaps[gap - size].append(b)
            counts[gap - size] += 1
    return which, at, fresh


def place_all(sizes: np.ndarray, capacity: int = CAPACITY, slack: int = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each of the descending ``sizes``.

    The sum-of-squares rule places all of them.  It leaves every gap about equally often, so at
    the end bins with more than ``slack`` tokens free are emptied and their pieces placed again by
    best fit, if that takes fewer bins.
    """
    bins = SumOfSquares(capacity)
    placed = np.asarray([bins.place(s) for s in sizes.tolist()], np.int64).reshape(-1, 2)
    which, at = placed[:, 0], placed[:, 1]
    fill = np.bincount(which, weights=sizes, minlength=bins.fresh)
    poor = fill < capacity - slack
    again = np.flatnonzero(poor[which]) if len(which) else which
    if len(again):
        w, o, n = _best_fit(sizes[again], capacity)
        if n < int(poor.sum()):
            free = np.flatnonzero(poor)[:n]
            which[again], at[again] = free[w], o
    return which, at


class SumOfSquares:
    """Open bins counted by residual gap; an item goes where the sum of squared counts is least.

    Moving a bin from gap g to gap g - s changes the sum by 2 (N[g-s] - N[g]) + 2 and a new bin by
    2 N[C-s] + 1; full bins have gap 0 and count for nothing.  Ties take the smallest gap.
    """

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.fresh = 0

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) for an item of ``size`` tokens."""
        c, n = self.capacity, self.counts
        if n[size]:  # an exact fit closes a bin: a gap of none is free, so nothing is lower
            gap = size
        else:
            before = n[size : c + 1]
            change = 2 * (n[: c + 1 - size] - before) + 2
            change[0] = 1 - 2 * before[0]
            change[before == 0] = np.iinfo(np.int64).max
            gap = size + int(np.argmin(change))
            new = 2 * int(n[c - size]) + 1 if size < c else 0
            if not n[gap] or new < change[gap - size]:
                gap = 0
        if gap:
            which = self.open[gap].pop()
            n[gap] -= 1
        else:
            which, gap = self.fresh, c
            self.fresh += 1
        left = gap - size
        if left:
            self.open[left].append(which)
            n[left] += 1
        return which, c - gap


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` plus sequence_id and offset.

    Pieces of full length are sequences by themselves and never move.  The rest are dealt by a hash of
    their keys to shards of about ``shard`` pieces, so no shard grows with the input and no key
    can fill one; each packs its own from the longest to the shortest.  A shard
    leaves at most a few open sequences, which is the price of packing in parallel.  ``pieces``
    should be a written table: it is counted and read.  Repeated rows are packed each by itself.
    """
    full = F.col("length") >= capacity
    some = pieces.filter(~full)
    n = max(1, -(-some.count() // shard))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        which, at = place_all(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"] = (which * n + pdf["_shard"].to_numpy()) * 2
        pdf["offset"] = at
        return pdf.drop(columns="_shard")

    rest = [c for c in pieces.columns if c not in ("doc_id", "piece", "length")]
    carried = some.select("doc_id", "piece", "length", *rest, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)).alias("_shard"))
    schema = carried.drop("_shard").schema.add("sequence_id", "long").add("offset", "long")
    packed = carried.groupBy("_shard").applyInPandas(run, schema)
    alone = pieces.filter(full).select("doc_id", "piece", "length", *rest).withColumns(
        {"sequence_id": F.monotonically_increasing_id() * 2 + 1, "offset": F.lit(0).cast("long")}
    )
    return packed.unionByName(alone)


def pack_documents(df: DataFrame, path: str, end_id: int | None = 2, capacity: int = CAPACITY, with_ids: bool = True, shard: int = SHARD_PIECES) -> DataFrame:
    """Tokenise, cut and pack ``df`` (doc_id, text): one row a piece with its place in a sequence.

    Other columns of ``df`` are left aside.  An empty table gives an empty result.
    """
    pieces = stage_table(tokenize_pieces(df, path, end_id, capacity, with_ids), "pieces")
    return pack(pieces, capacity, shard).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
