"""Benchmark decontamination by one Aho-Corasick automaton over the normalised windows of the test items.

A text is normalised once: A-Z in lower case, words of digits, letters and non-ASCII bytes. The automaton's letters are the
numbers of the benchmark's words, so a window is a path of ``window`` states and a text is read once, a number a word, 0 for words that
the benchmark doesn't have. Numbers come from 64-bit hashes; each match is compared byte for byte. The matched words' first and last
bytes in the original text give the spans.

The automaton grows with the benchmark, not with the corpus: about 13 states a word of it, 1.4 kB in memory (125 MB at ``limit``). One automaton holds ``limit`` bytes of
benchmark words (measured first). A larger benchmark is cut into parts of that size, also inside an item; each part is one automaton and one
more scan, and the words that the parts hit meet again by row. A row's result is the same at any limit.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cuts import cut
from .base import SLICE_BYTES, held, spread
from .kernel import ALNUM, Words, flat, letters, slices

WINDOW, LIMIT, SEGMENT = 13, 1 << 19, 4096
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TABLE = letters(True)


class Machine:
    """The automaton over word numbers, and the hashes of the words in the order of their numbers."""

    def __init__(self, segments: list[tuple[str, str]], window: int):
        import ahocorasick

        every = sorted({w for _, t in segments for w in t.split(" ")})
        data = " ".join(every).encode()
        self.hashes, place = np.unique(Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), ALNUM).hashes(_TABLE), return_inverse=True)
        number = dict(zip(every, (place + 1).tolist(), strict=True))
        of: dict[tuple, dict[bytes, set[str]]] = {}
        for item, t in segments:
            words = t.split(" ")
            n = min(window, len(words))
            for k in range(len(words) - n + 1):
                own = words[k : k + n]
                of.setdefault(tuple(number[w] for w in own), {}).setdefault(" ".join(own).encode(), set()).add(item)
        self.least = min(map(len, of), default=0)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, shown in of.items():
            self.automaton.add_word(key, (len(key), {t: tuple(sorted(ids)) for t, ids in shown.items()}))
        if of:
            self.automaton.make_automaton()

    def scan(self, words: Words) -> list[tuple[int, int, tuple[str, ...]]]:
        """The matches in some documents: (last word, number of words, items)."""
        if not self.least or not len(words.start):
            return []
        h = words.hashes(_TABLE)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = self.hashes[at] == h
        edge = np.flatnonzero(np.diff(np.concatenate([[0], known, [0]]).astype(np.int8)) | np.concatenate([words.doc[:1] >= 0, np.diff(words.doc) > 0, [True]]))
        run = np.diff(edge)  # runs of known words of one document, and what lies between them
        some = np.flatnonzero(known[edge[:-1]] & (run >= self.least))
        if not len(some):
            return []
        place = np.concatenate([x for k in some.tolist() for x in (np.arange(edge[k], edge[k + 1]), [-1])])
        number = np.where(place < 0, 0, at[place] + 1)
        out = []
        for end, (n, shown) in self.automaton.iter(tuple(number.tolist())):
            last = int(place[end])
            items = shown.get(b" ".join(words.data[words.start[k] : words.end[k]].tobytes().lower() for k in range(last - n + 1, last + 1)))
            if items:
                out.append((last, n, items))
        return out


def _machine(segments: list[tuple[str, str]], window: int) -> Machine:
    key = hashlib.sha256(repr((segments, window)).encode()).hexdigest()
    return held("decontaminate", key, lambda: Machine(segments, window))


def _parts(benchmark: DataFrame, item_col: str, item_text_col: str, window: int, limit: int) -> list[list[tuple[str, str]]]:
    """The items' words as segments (id, words) that share ``window`` - 1 words with the next, dealt to parts of about ``limit`` bytes."""
    words = F.regexp_extract_all(F.translate(F.coalesce(benchmark[item_text_col].cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))
    items = benchmark.select(F.coalesce(benchmark[item_col].cast("string"), F.lit("")).alias("i"), words.alias("w")).where("size(w) > 0")
    start = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(SEGMENT))
    segments = items.select("i", "w", F.explode(start).alias("s")).select("i", F.array_join(F.slice("w", F.col("s") + 1, SEGMENT + window - 1), " ").alias("t")).distinct()
    total = segments.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-total // limit))
    dealt = segments.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(parts)))
    return [sorted((r.i, r.t) for r in dealt.where(F.col("part") == k).collect()) for k in range(parts)]


def _hits(machine: Machine, data: np.ndarray, ends: np.ndarray):
    """The words of some documents, whether each is hit, and the items found in each document that has any."""
    words = Words(data, ends, ALNUM)
    hit, seen = np.zeros(len(words.start) + 1, np.int64), {}
    for last, n, items in machine.scan(words):
        hit[last - n + 1] += 1
        hit[last + 1] -= 1
        seen.setdefault(int(words.doc[last]), set()).update(items)
    return words, np.cumsum(hit[:-1]) > 0, seen


def _merged(rows: DataFrame, parts: list, window: int) -> DataFrame:
    """(row, n_words, items, hits: numbers of the hit words) of the rows (row, text) that any part hits; a scan a part."""

    def scan(segments):
        def run(batches):
            machine = _machine(segments, window)
            for batch in batches:
                data, ends = flat(batch.column(1))
                at, count, items, hits = [], [], [], []
                for a, b in slices(ends, SLICE_BYTES):
                    words, hit, seen = _hits(machine, data[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
                    for k in sorted(seen):
                        f, m = int(words.first[k]), int(words.count[k])
                        at.append(a + k)
                        count.append(m)
                        items.append(sorted(seen[k]))
                        hits.append(np.flatnonzero(hit[f : f + m]))
                arrays = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(count, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(hits, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "n_words", "items", "hits"])

        return rows.mapInArrow(run, "row long, n_words long, items array<string>, hits array<int>")

    found = scan(parts[0])
    for segments in parts[1:]:
        found = found.unionByName(scan(segments))
    flat_set = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)  # noqa: E731  at most a list a part
    return found.groupBy("row").agg(F.first("n_words").alias("n_words"), flat_set("items"), flat_set("hits"))


def decontaminate(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, limit: int = LIMIT) -> DataFrame:
    """One row a document: ``id_col``, n_words, n_hit, n_items, items_sha256, contaminated, items (ids, sorted as strings),
    spans (first byte and end of each run of hit words in the UTF-8 text).

    A word is hit inside any occurrence of a window: ``window`` consecutive words of an item, or all of a shorter item. Contaminated:
    n_hit > 0 and 20 * n_hit >= n_words. Null and empty texts have no words; items without words (null, empty) have
    no windows; repeated items count once, by id; null item ids are the string ''. Ids may be null or repeat: each row gives one row.
    Other columns aren't read. An empty benchmark hits nothing.
    """
    parts = _parts(benchmark, item_col, item_text_col, window, limit)
    rows = spread(df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")))
    kind = rows.schema["id"].dataType.simpleString()
    several = len(parts) > 1
    if several:
        rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
        rows = rows.join(_merged(rows.select("row", "text"), parts, window).drop("n_words"), "row", "left").select("id", "text", "items", "hits")
    sha = lambda ids: hashlib.sha256(",".join(ids).encode()).hexdigest()
    segments = [] if several else parts[0]

    def run(batches):
        machine = _machine(segments, window)
        for batch in batches:
            data, ends = flat(batch.column(1))
            n = batch.num_rows
            known, hits = ([x or [] for x in batch.column(c).to_pylist()] if several else [[]] * n for c in (2, 3))
            ids_of, spans, count, n_hit = [()] * n, [()] * n, np.zeros(n, np.int64), np.zeros(n, np.int64)
            for a, b in slices(ends, SLICE_BYTES):
                words, hit, seen = _hits(machine, data[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
                count[a:b] = words.count
                for k in set(seen) | {k for k in range(b - a) if hits[a + k]}:
                    f, m = int(words.first[k]), int(words.count[k])
                    hit[f + np.array(hits[a + k], np.int64)] = True
                    ids_of[a + k] = sorted(seen.get(k, set()) | set(known[a + k]))
                    n_hit[a + k] = hit[f : f + m].sum()
                    edge = np.diff(np.concatenate([[0], hit[f : f + m].astype(np.int8), [0]]))
                    base = int(ends[a + k] - ends[a])
                    spans[a + k] = np.column_stack([words.start[f + np.flatnonzero(edge == 1)] - base, words.end[f + np.flatnonzero(edge == -1) - 1] - base]).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count), pa.array(n_hit), pa.array([len(x) for x in ids_of], pa.int64()), pa.array([sha(x) for x in ids_of], pa.string()),
                 pa.array((n_hit > 0) & (20 * n_hit >= count)), pa.array(ids_of, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"],
            )

    return rows.mapInArrow(run, f"id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<array<long>>").withColumnRenamed("id", id_col)


def keep_clean(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
               window: int = WINDOW, limit: int = LIMIT) -> DataFrame:
    """The rows that aren't contaminated, with all their columns as they were; with one automaton without a shuffle.

    Each row is judged by its own text alone, whatever ``id_col`` holds: ids may be null or repeat, and repeated rows are judged alike. Null
    and empty texts are clean, and so are all rows if the benchmark is empty. Very long texts are read whole; an empty table stays empty.
    """
    parts = _parts(benchmark, item_col, item_text_col, window, limit)
    if len(parts) > 1:
        row = "_".join(["row", *df.columns])  # a name that no column has
        rows = cut(df.withColumn(row, F.monotonically_increasing_id()))
        found = _merged(rows.select(F.col(row).alias("row"), F.col(text_col).cast("string").alias("text")), parts, window)
        return rows.join(found.where("20 * size(hits) >= n_words").select(F.col("row").alias(row)), row, "left_anti").select(df.columns)
    at = df.columns.index(text_col)

    def run(batches):
        machine = _machine(parts[0], window)
        for batch in batches:
            data, ends = flat(batch.column(at).cast(pa.string()))
            keep = np.ones(batch.num_rows, bool)
            for a, b in slices(ends, SLICE_BYTES):
                words, hit, seen = _hits(machine, data[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
                for k in seen:
                    f, m = int(words.first[k]), int(words.count[k])
                    keep[a + k] = 20 * hit[f : f + m].sum() < m
            yield batch.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w"
#: The same for the tables ``documents`` and ``benchmark`` by DuckDB: windows as text, joined.
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} FROM benchmark),
bk AS (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM bk),
dk AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d JOIN (SELECT DISTINCT n FROM bw) ON len(w) >= n),
m AS (SELECT doc_id, k, n, item FROM (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM dk) JOIN bw USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
"""
