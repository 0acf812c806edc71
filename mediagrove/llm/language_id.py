"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to ``order`` bytes. In a context seen n times with d distinct next bytes, a
seen byte of count c costs log2((n + d) / c) bits and the escape to the next shorter context log2((n + d) / d) (method C,
without exclusion); below the empty context each byte costs 8 bits. A context that a language has not seen costs
nothing to leave. The statistics are frozen after training, so every context's costs for every next byte are worked out
once: a row of a table. Scoring looks up, for each position and language, the row of the longest context that the language has
seen, and adds one entry of it. The language of the shortest code wins.

The trees are learned from whole texts of a bounded sample: ``per_lang`` training documents a language, those of the
smallest hash of doc_id, and of these as many as ``per_bytes`` allow. A language's tree holds its own bytes and contexts only, so trees grow with the number of languages, not
with its square; they are measured as they are made, and an error beyond ``most_bytes``: that is what tasks receive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import SLICE_BYTES, spread
from .kernel import flat, slices

ORDER, PER_LANG, PER_BYTES, CELLS, SPARE, MOST_BYTES = 3, 400, 4 << 20, 1 << 24, 8, 512 << 20
UNKNOWN = "und"
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True


class Tree:
    """Frozen statistics of one language, over its own bytes. ``rows``: context -> row, that of the longest suffix which the language has seen; ``bits``: (row, byte code) -> cost."""

    def __init__(self, texts: list[bytes], order: int):
        seen = np.zeros(256, bool)
        for t in texts:
            seen[np.frombuffer(t, np.uint8)] = True
        self.code = np.zeros(256, np.int64)  # 0: never seen in this language, and what stands before a text
        self.code[seen] = np.arange(1, seen.sum() + 1)
        size = self.size = int(seen.sum()) + 1
        if size**order > CELLS:
            raise ValueError(f"contexts of {order} of {size} byte values need more than {CELLS} places")
        self.order = order
        count = self._counts(texts, size, order)
        self.rows = np.zeros(1, np.int32)
        tables, offset = [self._costs(count[0].reshape(1, size), np.full((1, size), 8.0))], 1
        for k in range(1, order + 1):
            grams = np.unique(count[k][0] // size)
            place = np.full(size**k, -1, np.int32)
            place[grams] = np.arange(len(grams))
            above = np.concatenate(tables)[self.rows[grams % size ** (k - 1)]]
            c = np.zeros((len(grams), size))
            c[place[count[k][0] // size], count[k][0] % size] = count[k][1]
            self.rows = np.where(place >= 0, place + offset, self.rows[np.arange(size**k) % size ** (k - 1)]).astype(np.int32)
            tables.append(self._costs(c, above))
            offset += len(grams)
        self.bits = np.concatenate(tables).astype(np.float32)

    @property
    def nbytes(self) -> int:
        return self.rows.nbytes + self.bits.nbytes

    def _counts(self, texts: list[bytes], size: int, order: int):
        """Order 0: counts by byte code; order k: (context * size + byte, count)."""
        codes = [self.code[np.frombuffer(t, np.uint8)] for t in texts]
        out = [np.bincount(np.concatenate([*codes, np.zeros(0, np.int64)]).astype(np.int64), minlength=size).astype(float)]
        for k in range(1, order + 1):
            grams = []
            for c in codes:
                if len(c) > k:
                    g = np.zeros(len(c) - k, np.int64)
                    for j in range(k + 1):
                        g = g * size + c[j : len(c) - k + j]
                    grams.append(g)
            out.append(np.unique(np.concatenate([*grams, np.zeros(0, np.int64)]), return_counts=True))
        return out

    @staticmethod
    def _costs(c: np.ndarray, above: np.ndarray) -> np.ndarray:
        n, d = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(n == 0, above, np.where(c > 0, np.log2((n + d) / c), np.log2((n + d) / d) + above))

    def costs(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Bits of each byte; texts begin at ``starts`` and end at ``stops``."""
        codes = self.code[data]
        context = np.zeros(len(codes), np.int64)
        for k in range(self.order, 0, -1):
            before = np.zeros(len(codes), np.int64)
            before[k:] = codes[:-k]
            for j in range(k):  # positions whose k-th byte before lies in another document
                at = starts + j
                before[at[at < stops]] = 0
            context = context * self.size + before
        return self.bits.ravel()[self.rows[context].astype(np.int64) * self.size + codes]


class Trees:
    """The trees of all languages; no larger than ``most_bytes`` together, as every worker gets them."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER, most_bytes: int = MOST_BYTES):
        self.langs, self.order, self.trees, self.nbytes = sorted(texts), order, [], 0
        for x in self.langs:
            self.trees.append(Tree(texts[x], order))
            self.nbytes += self.trees[-1].nbytes
            if self.nbytes > most_bytes:
                raise ValueError(f"the trees of {len(self.trees)} of {len(self.langs)} languages take {self.nbytes} bytes, and {most_bytes} are allowed; learn from fewer bytes a language, or by a lower order")

    def lengths(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code lengths in bits: a row a document, a column a language."""
        full = np.flatnonzero(np.diff(ends))
        out = np.zeros((len(ends) - 1, len(self.langs)))
        if len(full):
            starts, stops = ends[:-1][full], ends[1:][full]
            for x, tree in enumerate(self.trees):
                out[full, x] = np.add.reduceat(tree.costs(data, starts, stops), starts, dtype=np.float64)
        return out

    def predict(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best language of each document (its place in ``langs``, ties to the first; -1: no letter) and its probability."""
        letter = np.zeros(len(ends) - 1, bool)
        full = np.flatnonzero(np.diff(ends))
        if len(full):
            letter[full] = np.logical_or.reduceat(_ASCII[data], ends[:-1][full])
            for k in full[~letter[full]]:
                letter[k] = any(map(str.isalpha, data[ends[k] : ends[k + 1]].tobytes().decode()))
        if not self.langs:
            return np.full(len(letter), -1), np.zeros(len(letter))
        bits = self.lengths(data, ends)
        best = bits.argmin(1)
        share = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1)
        return np.where(letter, best, -1), np.where(letter, share, 0.0)


def learn(df: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, per_bytes: int = PER_BYTES, order: int = ORDER, most_bytes: int = MOST_BYTES) -> Trees:
    """Trees of the training rows' languages, from ``per_lang`` whole texts a language at most.

    Rows without an id, a text or a language teach nothing. The texts are those of the least hashes of the id (ties: of the id, then of the
    text), as long as all so far have ``per_bytes`` together. Rows that repeat an id are texts of their own. Languages are counted first; of a large
    one only hashes below a bound, some ``SPARE`` times as many rows as are wanted, leave the tasks that read them.
    """
    usable = train & df[id_col].isNotNull() & df[text_col].isNotNull() & df[lang_col].isNotNull()
    rows = df.where(usable).select(df[id_col].alias("i"), df[lang_col].cast("string").alias("l"), df[text_col].cast("string").alias("t"))
    rows = rows.withColumns({"h": F.shiftrightunsigned(F.xxhash64("i"), 1), "ht": F.xxhash64("t")})
    counts = rows.groupBy("l").agg(F.count(F.lit(1)).alias("all"))
    bounds = counts.withColumn("bound", F.lit(float(SPARE * per_lang)) / F.col("all") * F.lit(2.0**63))
    below = rows.select("l", "h").join(F.broadcast(bounds), "l").groupBy("l").agg(F.count_if(F.col("h") < F.col("bound")).alias("n"), F.min("all").alias("all"), F.min("bound").alias("bound"))
    enough = F.col("n") >= F.least(F.col("all"), F.lit(per_lang))  # not where a few ids are most of a language's rows
    bounds = below.select("l", F.when(enough, F.col("bound")).otherwise(2.0**64).alias("bound"))
    few = rows.join(F.broadcast(bounds), "l").where(F.col("h") < F.col("bound")).select("i", "l", "h", "ht", F.octet_length("t").cast("long").alias("n"))
    first = Window.partitionBy("l").orderBy("h", "i", "ht", "n")
    few = few.withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_lang)
    few = few.withColumn("sum", F.sum("n").over(first.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("sum") <= per_bytes)
    pick = few.groupBy("i", "l", "ht").agg(F.count(F.lit(1)).alias("times"))
    chosen = rows.join(F.broadcast(pick), ["i", "l", "ht"]).select("i", "l", "ht", "t", "times").distinct().select("l", "t", "times").collect()
    texts: dict[str, list[bytes]] = {}
    for r in sorted(chosen):
        texts.setdefault(r.l, []).extend([r.t.encode()] * r.times)
    return Trees(texts, order, most_bytes)


def identify(df: DataFrame, trees: Trees, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``id_col``, lang_pred, score (the language's share of 2^-bits over all languages; 0 for `und`).

    `und`: null or empty text, or one without a letter; or nothing was learned. Ids may be null or repeat; each row
    gives one row; other columns aren't read.
    """
    rows = spread(df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")))
    sent = df.sparkSession.sparkContext.broadcast(trees)  # of a size checked as they were made

    def run(batches):
        own = sent.value
        names = np.array([*own.langs, UNKNOWN], object)
        for batch in batches:
            data, ends = flat(batch.column(1))
            best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for a, b in slices(ends, SLICE_BYTES):
                best[a:b], score[a:b] = own.predict(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
