"""Token counts of whole documents by overlap resynchronisation.

A document of up to ``chunk`` characters is one chunk. A longer one is encoded as overlapping chunks with
offsets, spliced where two neighbours agree on a boundary that is proven stable, so memory is bounded by the
chunk and not by the document, wherever the document has split positions. A stretch without any grows the left chunk until it ends, as
nothing else proves its tokens.

Why a common boundary is proven. The byte-level splitter scans from left to right without looking back: what
follows a split position depends on the text after it alone, and merges never cross such a position. A split
position at least ``MARGIN`` characters before the end of the left chunk can't be moved by text beyond that end (the
longest special string and the splitter's one character of lookahead are shorter). If the right chunk splits
there too, both scans are in the same state, so the right chunk's tokens from there on are those of the whole
text. Where two chunks share no such position the overlap doubles; when it covers the whole left chunk, that
chunk grows instead. Proven positions only: a position inside a split word (a merge boundary) never counts.

Within a chunk nothing is approximated either. Text is cut before each space that follows a character other than white
space, which is always a split position, and the token count of each distinct piece is computed once by the
library and remembered in a bounded table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import SLICE_BYTES, held, spread
from .kernel import flat, slices

CHUNK, OVERLAP, MARGIN, REMEMBER = 16384, 256, 64, 400_000


def tokenizer(name: str, owner: str = "token_counts"):
    """The tokenizer of a file of ``public_tokenizers`` (or of a path), loaded once in each worker."""

    def load():
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        path = name
        if "/" not in name:
            import public_tokenizers

            path = public_tokenizers.path(name)
        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        return loaded

    return held(owner, name, load)


def boundaries(encoding, base: int) -> dict[int, int]:
    """Split positions of an encoded chunk that begins at character ``base``: position -> tokens before it."""
    found, last = {}, object()
    for k, (word, (start, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if word is None or word != last:
            found[base + start] = k
        last = word
    return found


class Splicer:
    """Counts the tokens of one text chunk by chunk. ``widened`` counts overlaps that had to grow."""

    def __init__(self, tok, chunk: int = CHUNK, overlap: int = OVERLAP):
        if chunk < 1 or overlap < 1:
            raise ValueError("chunk and overlap must be positive")
        self.tok, self.chunk, self.overlap, self.widened = tok, chunk, overlap, 0

    def encode(self, text: str):
        return self.tok.encode(text, add_special_tokens=False)

    def count(self, text: str) -> int:
        n, total = len(text), 0
        base, end = 0, min(self.chunk, n)  # the left chunk
        left, taken = self.encode(text[base:end]), 0  # its first ``taken`` tokens aren't counted from here
        start = 0  # the proven position its count begins at
        while end < n:
            overlap, spliced = self.overlap, False
            here = boundaries(left, base)
            while not spliced and end - overlap > start:
                s = end - overlap
                e = min(n, s + self.chunk + overlap)
                right = self.encode(text[s:e])
                there = boundaries(right, s)
                common = [p for p in there if s < p <= end - MARGIN and p > start and p in here]
                if common:
                    p = common[-1]
                    total += here[p] - taken
                    base, end, start, left, taken, spliced = s, e, p, right, there[p], True
                else:
                    overlap *= 2
                    self.widened += 1
            if not spliced:
                base, end = start, min(n, end + 2 * (end - start) + self.chunk)
                left, taken = self.encode(text[base:end]), 0
                self.widened += 1
        return total + len(left.ids) - taken


def _pieces(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of pieces (cut before a space that follows no white space) and the document of each."""
    n = len(data)
    space = data == 0x20
    stop = np.zeros(n, bool)
    if n > 1:
        p1 = data[:-1]
        ok = (p1 > 0x20) & (p1 != 0x7F)
        # beyond ASCII: white space there ends in two bytes after 0xC2, or three after 0xE1 to 0xE3
        ok[1:] &= ~((data[:-2] == 0xC2) & (p1[1:] >= 0x80))
        ok[2:] &= ~((data[:-3] >= 0xE1) & (data[:-3] <= 0xE3) & (p1[2:] >= 0x80))
        stop[1:] = space[1:] & ok
    first = ends[:-1][np.diff(ends) > 0]
    stop[first] = True
    starts = np.flatnonzero(stop)
    return starts, np.searchsorted(ends, starts, "right") - 1


class Counter:
    """Token counts of many texts of at most one chunk each."""

    def __init__(self, tok):
        self.tok, self.known = tok, {}

    def counts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        starts, doc = _pieces(data, ends)
        if not len(starts):
            return np.zeros(len(ends) - 1, np.int64)
        cuts = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.utf8(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        words = coded.dictionary.to_pylist()
        known = self.known
        if len(known) > REMEMBER:
            known.clear()
        new = [w for w in words if w not in known]
        if new:
            known.update(zip(new, (len(e) for e in self.tok.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        each = np.fromiter((known[w] for w in words), np.int64, len(words))
        return np.bincount(doc, each[coded.indices.to_numpy()], len(ends) - 1).astype(np.int64)


def count_tokens(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str = "byte_bpe_50k.json",
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row a document: ``id_col``, n_bytes, n_tokens, n_chunked (characters that went through splicing).

    Null and empty texts have 0 bytes and 0 tokens. Ids may be null or repeat: every input row gives one output
    row. Other columns, whatever their names, aren't read. An empty table gives an empty result. Memory: one
    slice of documents, one chunk and the bounded table of remembered pieces.
    """
    rows = spread(df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")))

    def run(batches):
        tok = tokenizer(tokenizer_file)
        memo, splicer = Counter(tok), Splicer(tok, chunk, overlap)
        for batch in batches:
            data, ends = flat(batch.column(1))
            out = np.zeros(batch.num_rows, np.int64)
            long = np.zeros(batch.num_rows, np.int64)
            for a, b in slices(ends, SLICE_BYTES):
                part, cuts = data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
                size = np.diff(cuts)
                if (size > chunk).any():  # few: bytes bound the characters from above
                    for k in np.flatnonzero(size > chunk):
                        text = part[cuts[k] : cuts[k + 1]].tobytes().decode()
                        if len(text) > chunk:
                            out[a + k], long[a + k] = splicer.count(text), len(text)
                    keep = np.repeat(long[a:b] == 0, size)
                    part, cuts = part[keep], np.concatenate([[0], np.cumsum(np.where(long[a:b] == 0, size, 0))])
                out[a:b] += memo.counts(part, cuts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends)), pa.array(out), pa.array(long)], ["id", "n_bytes", "n_tokens", "n_chunked"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, n_chunked long").withColumnRenamed("id", id_col)
