"""Token counts by the tokenizer's own library, with overlap resynchronisation for huge texts."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
BATCH_CHARS = 1 << 18
#: No place this near a chunk's cut end is trusted; patterns look ahead by far less.
EDGE_CHARS = 32

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a .json file, loaded once a worker, without truncation or padding."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


class _Chunk:
    """The tokens of ``text[lo:hi]`` with places in the whole text."""

    def __init__(self, t, text: str, lo: int, hi: int):
        self.lo, self.hi = lo, hi
        self.tokens = t.encode(text[lo:hi], add_special_tokens=False)
        self.n = len(self.tokens)

    def span(self, i: int) -> tuple[int, int]:
        s, e = self.tokens.token_to_chars(i)
        return s + self.lo, e + self.lo

    def begins_word(self, i: int) -> bool:
        """Whether token ``i`` begins a pre-token that follows another one; never so beside a special string."""
        own, before = self.tokens.token_to_word(i), self.tokens.token_to_word(i - 1) if i else None
        return own is not None and before is not None and own != before

    def first_after(self, place: int) -> int:
        """The number of the first token that begins at ``place`` or later."""
        a, b = 0, self.n
        while a < b:
            m = (a + b) // 2
            a, b = (m + 1, b) if self.span(m)[0] < place else (a, m)
        return a


def _splice(a: _Chunk, b: _Chunk) -> tuple[int, int] | None:
    """Token numbers at which to leave ``a`` and enter ``b``; None if no place is proven stable.

    Pre-tokenisation goes from left to right, so what follows a pre-token's beginning depends on
    nothing before it, and tokens never cross pre-tokens.  A place is taken only where a pre-token
    begins in both chunks, inside a run of at least eight tokens with the same places in both, and away from the end of ``a``,
    which the characters cut off there could still change.
    """
    i, j, best, run = a.first_after(b.lo), 0, [], []
    while i < a.n and j < b.n:
        x, y = a.span(i), b.span(j)
        if x[1] > a.hi - EDGE_CHARS:
            break
        if x == y:
            run.append((i, j))
            if len(run) > len(best):
                best = run
        else:
            run = []
        i, j = i + (x <= y), j + (y <= x)
    if len(best) < 8:
        return None
    middle = len(best) // 2
    for k in sorted(range(2, len(best) - 2), key=lambda k: abs(k - middle)):
        i, j = best[k]
        if a.begins_word(i) and b.begins_word(j):
            return i, j
    return None


def _word_at(a: _Chunk, i: int, floor: int) -> int | None:
    """The number of the last token at or before ``i``, after ``floor``, that begins a pre-token."""
    while i > floor and not a.begins_word(i):
        word = a.tokens.token_to_word(i)
        first = a.tokens.word_to_tokens(word)[0] if word is not None else i
        i = first if first < i else i - 1
    return i if i > floor else None


def _start_of_overlap(a: _Chunk, wide: int, skip: int) -> int | None:
    """Where an overlap of about the last ``wide`` characters of ``a`` begins: at a pre-token, with another well inside."""
    last = _word_at(a, a.first_after(a.hi - EDGE_CHARS) - 4, skip + 4)
    if last is None:
        return None
    i = _word_at(a, min(a.first_after(a.hi - wide), last - 4), skip)
    return None if i is None else a.span(i)[0]


def count_tokens(text: str, t, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """The number of tokens that the library gives for the whole text.

    Texts longer than ``chunk`` are encoded in overlapping chunks with offsets.  A chunk's
    successor begins at one of its pre-tokens; the two are spliced in the middle of a run of tokens
    alike in both, and the overlap widens until there is one.  Where a chunk has no such place (one pre-token
    without end, or a tokenizer without pre-tokens), the chunk is made twice as long and encoded anew, at
    worst until it is the whole text, so the work stays within a small multiple of encoding the text once.
    Special strings are never cut through: a chunk's edge tokens don't count.
    """
    if len(text) <= chunk:
        return len(t.encode(text, add_special_tokens=False))
    total, skip, have = 0, 0, _Chunk(t, text, 0, chunk)
    while have.hi < len(text):
        wide, place = overlap, None
        while place is None and wide < have.hi - have.lo:
            start = _start_of_overlap(have, wide, skip)
            if start is None:
                break  # nor does a wider overlap have one
            more = _Chunk(t, text, start, min(len(text), have.hi + chunk))
            place = _splice(have, more)
            wide *= 4
        if place is None:
            # the tokens skipped at the chunk's beginning lie before a proven place and stay the same
            have = _Chunk(t, text, have.lo, min(len(text), 2 * have.hi - have.lo))
            continue
        total += place[0] - skip
        have, skip = more, place[1]
    return total + have.n - skip


def token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 2048, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """``df`` plus n_bytes, n_tokens and over_limit; no shuffle, one pass.

    ``path`` is the tokenizer file, which every worker must be able to open.  A null text counts as
    empty: 0 bytes, 0 tokens.  Columns of those names are replaced; an empty table gives an empty
    result.
    """
    src = df.drop("n_bytes", "n_tokens", "over_limit")
    keep = [c for c in src.columns if c != text]
    # the text alone is looked at; it goes back only if the caller selects it
    schema = src.select(*keep).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            col = batch.column(batch.schema.get_field_index("_text"))
            counts, sizes, queue, chars = [0] * len(col), [0] * len(col), [], 0

            def flush():
                nonlocal chars
                for i, e in zip([q[0] for q in queue], t.encode_batch_fast([q[1] for q in queue], add_special_tokens=False), strict=True):
                    counts[i] = len(e)
                queue.clear()
                chars = 0

            for i, value in enumerate(col):
                s = value.as_py()
                if not s:
                    continue
                sizes[i] = len(s.encode())
                if len(s) > chunk:
                    counts[i] = count_tokens(s, t, chunk, overlap)
                    continue
                queue.append((i, s))
                chars += len(s)
                if chars >= BATCH_CHARS:
                    flush()
            if queue:
                flush()
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            arrays += [pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    return src.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)
