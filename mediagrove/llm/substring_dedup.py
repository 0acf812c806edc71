"""Repeated byte strings across documents, found with suffix arrays (see ``suffix_groups``).

A window is ``length`` consecutive bytes of one document. Every window belongs to its anchor, the gram of least hash in it, so equal
windows share an anchor at the same distance, and all texts that must be ordered together meet by anchor:
1. Blocks send their distinct anchors with numbers of documents; those of one document only are done with.
2. For the others a block sends each distinct context (the bytes of all windows of one occurrence) with its least document
   id. All contexts of an anchor form a lane. The suffix array of the lane puts equal windows side by side; the least id
   of each run goes back. A lane of one distinct context has nothing to order: its windows share its least id.
3. Windows of a lane can only be equal if they agree in the bytes next to the anchor: to its right if the anchor stands in the window's
   first half, else to its left. Contexts that share neither with another one of their lane have nothing to meet. A lane of more than
   ``LIMIT`` bytes is split by these bytes, into lanes of half as many windows a context, again and again: so lanes are bounded.
4. An anchor of more than ``HOT`` documents would gather its contexts in one task. Its windows are sent one by one as pairs of 64-bit
   hashes, each distinct one once a block, and dealt by hash: exact but for collisions of 128 bits, bounded whatever the number of copies.
5. A block marks the windows whose least id is smaller than the document's own, and cuts their bytes out.

Contexts of one anchor count as equal if their 64-bit hashes are, so two contexts are taken for one only if they share the gram of
the anchor and collide: about 3e-20 for each pair of contexts of one anchor.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .anchors import GRAM, LENGTH, Anchors
from .base import cut
from .blocks import BLOCK_BYTES, bucket_of, opened, pack, rows_of, texts, unpack
from .kernel import CHUNK, U, _Powers, mix, salts, slices
from .suffix_groups import ranges, suffix_arrays

HOT, LANES, LIMIT, BUCKET_BYTES = 2048, 1 << 19, 1024, 16 << 20
NO_ID = np.iinfo(np.int64).max
_ONE, _TWO = salts(256, 51), salts(256, 52)
ANCHORS, CONTEXTS, WINDOWS = 0, 1, 2


def hashes_at(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], a short string each; read in runs of ``CHUNK`` / 2 bytes."""
    size = end - start
    if 2 * size.sum() < len(data):  # few: leave out what lies between them
        data, end = data[ranges(start, size)], np.cumsum(size)
        start = end - size
    out = np.empty(len(start), U)
    order = None if len(start) < 2 or (start[1:] >= start[:-1]).all() else np.argsort(start, kind="stable")
    if order is not None:
        start, end = start[order], end[order]
    for c in range(0, len(data), CHUNK // 2):
        a, b = np.searchsorted(start, [c, c + CHUNK // 2])
        if a == b:
            continue
        part = data[c : int(end[a:b].max())]
        up, down = _Powers.get(len(part) + 1)
        h = np.zeros(len(part) + 1, U)
        np.cumsum(table[part] * up[: len(part)], out=h[1:])
        s, e = start[a:b] - c, end[a:b] - c
        out[a:b] = mix((h[e] - h[s]) * down[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))
    if order is not None:
        back = np.empty_like(out)
        back[order] = out
        out = back
    return out


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of their keys, where each run of equal keys begins in it, and the number of each row's run."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number


def _least(values: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.minimum.reduceat(values[order], first) if len(first) else np.zeros(0, np.int64)


class _Block:
    """Anchors of a block: distinct ``keys``, and for each occurrence its key's number, its document and its slice."""

    def __init__(self, row: dict, length: int, gram: int):
        self.length = length
        self.data, self.ends = opened(row)
        self.ids = np.array([NO_ID if x is None else x for x in row["ids"]], np.int64)
        found = Anchors(self.data, self.ends, length, gram)
        self.doc, self.first, self.last, self.place = found.doc, found.first, found.last, found.place
        self.keys, self.number = np.unique(found.key, return_inverse=True)

    def counts(self) -> np.ndarray:
        n = max(1, len(self.ids))
        pairs = self.number * n + self.doc
        pairs.sort()
        return np.bincount(pairs[np.diff(pairs, prepend=-1) > 0] // n, minlength=len(self.keys)).astype(np.uint32)

    def contexts(self, total: np.ndarray, hot: int):
        """Of anchors in several documents: the distinct contexts, and for hot anchors the distinct windows.

        ((key, first, end, place of the gram in it, least id) of each distinct context, place of each occurrence in them, first, last,
        doc), and the same of windows with (hash, second hash, least id), place, first, doc.
        """
        many = total[self.number]
        cold, warm = (many >= 2) & (many <= hot), many > hot
        first, last, doc = self.first[cold], self.last[cold], self.doc[cold]
        end, key = last + self.length, self.number[cold]  # numbers are in the order of keys
        order, at, where = grouped(key, hashes_at(self.data, first, end, _ONE))
        pick = order[at]
        cold_out = (self.keys[key[pick]], first[pick], end[pick], self.place[cold][pick] - first[pick], _least(self.ids[doc], order, at)), where, first, last, doc

        first, n = self.first[warm], self.last[warm] - self.first[warm] + 1
        start, doc_w = ranges(first, n), np.repeat(self.doc[warm], n)
        one, two = (hashes_at(self.data, start, start + self.length, t) for t in (_ONE, _TWO))
        order, at, where = grouped(one, two)
        return cold_out, ((one[order[at]], two[order[at]], _least(self.ids[doc_w], order, at)), where, start, doc_w)


def _totals(group: pa.Table) -> pa.Table:
    """For each pack of ascending keys with counts: the sums of the counts over all packs."""
    packs = [(np.cumsum(unpack(k, U), dtype=U), unpack(c, np.uint32)) for k, c in zip(group["x"].to_pylist(), group["y"].to_pylist(), strict=True)]
    same, place = np.unique(np.concatenate([k for k, _ in packs]), return_inverse=True)
    total = np.bincount(place, np.concatenate([c for _, c in packs]), len(same)).astype(np.uint32)
    edge = np.cumsum([0, *(len(k) for k, _ in packs)])
    return _answer(group, [(pack(total[place[a:b]]), b"") for a, b in zip(edge[:-1], edge[1:], strict=True)])


def _answer(group: pa.Table, packs: list[tuple[bytes, bytes]]) -> pa.Table:
    return pa.table({"block": group["block"], "bucket": group["bucket"], "kind": group["kind"], "x": pa.array([x for x, _ in packs], pa.binary()), "y": pa.array([y for _, y in packs], pa.binary())})


def _ordered(out: np.ndarray, text: np.ndarray, lane: np.ndarray, begin: np.ndarray, n: np.ndarray, off: np.ndarray, length: int) -> None:
    """Orders the contexts of each lane by a suffix array and writes the least id of equal windows to ``out``. ``lane``: ascending;
    a context has ``n`` windows; its bytes begin at ``begin`` in ``text``, its windows' ids at ``off`` in ``out``."""
    if not len(lane):
        return
    size = n + length - 1
    edge = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1], [True]]))
    width = np.add.reduceat(size + 1, edge[:-1])
    many = np.argsort(width, kind="stable")  # lanes of like size together
    width = width[many]
    step = 8 if length >= 8 else 1
    for a, b in slices(np.concatenate([[0], np.cumsum(width)]), LANES):
        context = ranges(edge[many[a:b]], np.diff(edge)[many[a:b]])
        own = size[context]
        raw = np.zeros(int(width[a:b].sum()) + 8, np.uint8)  # each context, then a separator
        put = np.cumsum(own + 1) - (own + 1)
        raw[ranges(put, own)] = text[ranges(begin[context], own)]
        symbols = raw[:-8].astype(np.int16) + 2
        symbols[put + own] = 1
        symbols[np.cumsum(width[a:b]) - 1] = 0
        order = suffix_arrays(symbols, width[a:b])
        # the windows in the order of their suffixes
        offset = np.full(len(symbols), -1)
        offset[ranges(put, n[context])] = ranges(off[context], n[context])
        order = order[offset[order] >= 0]
        lane_of = np.repeat(np.arange(b - a), width[a:b])[order]
        same = np.flatnonzero(lane_of[1:] == lane_of[:-1])
        words = np.lib.stride_tricks.as_strided(raw.view(np.uint8), (len(raw) - 7, 8), (1, 1)).view(np.uint64)[:, 0] if step == 8 else raw
        for k in sorted({*range(0, length - step + 1, step), length - step}):  # bytes of neighbours, as far as they agree
            same = same[words[order[same + 1] + k] == words[order[same] + k]]
        new = np.ones(len(order), bool)
        new[same + 1] = False
        first = np.flatnonzero(new)
        to = offset[order]
        least = np.minimum.reduceat(out[to], first)
        out[to] = np.repeat(least, np.diff(np.append(first, len(order))))


def least_ids(lane: np.ndarray, text: np.ndarray, begin: np.ndarray, size: np.ndarray, at: np.ndarray, ids: np.ndarray, length: int, gram: int, limit: int = LIMIT) -> np.ndarray:
    """For every window of every context, context after context: the least id of a context of its lane that has that window.

    Contexts of a lane differ and hold the lane's gram at ``at``; their bytes are the ``size`` bytes at ``begin`` in ``text``.
    """
    span = length - gram
    n = size - length + 1
    off = np.cumsum(n) - n
    out = np.repeat(ids, n)
    copies = []
    lo, hi = np.zeros(len(n), np.int64), np.full(len(n), span)  # where the gram stands in an item's windows
    while len(lane):
        middle = (lo + hi) >> 1
        halves = []
        for a, b in ((lo, middle), (middle + 1, hi)):
            first, last = np.maximum(at - b, 0), np.minimum(at - a, n - 1)
            item = np.flatnonzero((a <= b) & (first <= last))  # those that have such windows
            core = hashes_at(text, (begin + at - a)[item], (begin + at + gram + span - b)[item], _ONE)  # what all such windows of a lane must share
            _, runs, number = grouped(lane[item], core)
            shared = np.bincount(number, minlength=len(runs))[number] > 1
            halves.append((item[shared], number[shared], first[item[shared]], last[item[shared]], a, b))
        alive = np.zeros(len(lane), bool)
        for half in halves:
            alive[half[0]] = True
        _, runs, number = grouped(lane)
        small = alive & (np.bincount(number, np.where(alive, n + length, 0), len(runs)) <= limit)[number]
        of = np.flatnonzero(small)
        of = of[np.argsort(number[of], kind="stable")]
        _ordered(out, text, number[of], begin[of], n[of], off[of], length)
        parts, base = [], 0
        for item, sub, first, last, a, b in halves:
            go = ~small[item]
            i, f, m = item[go], first[go], (last - first + 1)[go]
            parts.append((sub[go] + base, begin[i] + f, m, at[i] - f, off[i] + f, a[i], b[i]))
            base += len(lane)
        lane, begin, n, at, off, lo, hi = (np.concatenate(c) for c in zip(*parts, strict=True))
        if not len(lane):
            break
        order, runs, number = grouped(lane, hashes_at(text, begin, begin + n + length - 1, _ONE))  # equal ones become one
        pick = order[runs]
        least = _least(out[off], order, runs)
        out[ranges(off[pick], n[pick])] = np.repeat(least, n[pick])
        twin = np.flatnonzero(pick[number] != np.arange(len(number)))
        copies.append((off[twin], off[pick[number[twin]]], n[twin]))
        _, runs, number = grouped(lane[pick])
        pick = pick[np.bincount(number, minlength=len(runs))[number] > 1]
        lane, begin, n, at, off, lo, hi = (c[pick] for c in (lane, begin, n, at, off, lo, hi))
    for to, source, m in reversed(copies):
        out[ranges(to, m)] = out[ranges(source, m)]
    return out


def _order(group: pa.Table, length: int, gram: int) -> pa.Table:
    """Answers packs of contexts or windows with least ids."""
    x, y = group["x"].to_pylist(), group["y"].to_pylist()
    if group["kind"][0].as_py() == WINDOWS:
        packs = [(unpack(a, U).reshape(2, -1), unpack(b, np.int64)) for a, b in zip(x, y, strict=True)]
        both = np.concatenate([a for a, _ in packs], 1)
        ids = np.concatenate([b for _, b in packs])
        order, first, number = grouped(both[0], both[1])
        least = _least(ids, order, first)[number]
        edge = np.cumsum([0, *(len(b) for _, b in packs)])
        return _answer(group, [(pack(least[a:b]), b"") for a, b in zip(edge[:-1], edge[1:], strict=True)])
    key, size, place, ids, text = [], [], [], [], []
    for a, b in zip(x, y, strict=True):
        head = unpack(a, U).reshape(4, -1)
        key.append(np.cumsum(head[0], dtype=U))
        size.append(head[1].astype(np.int64))
        place.append(head[2].astype(np.int64))
        ids.append(head[3].view(np.int64))
        text.append(np.frombuffer(unpack(b), np.uint8))
    edge = np.cumsum([0, *map(len, key)])
    key, size, place, ids, text = map(np.concatenate, (key, size, place, ids, text))
    begin = np.cumsum(size) - size
    order, first, number = grouped(key, hashes_at(text, begin, begin + size, _ONE))
    pick = order[first]
    least = _least(ids, order, first)
    _, runs, lane = grouped(key[pick])
    many = np.flatnonzero(np.bincount(lane, minlength=len(runs))[lane] > 1)
    chosen = pick[many]
    every = least_ids(lane[many], text, begin[chosen], size[chosen], place[chosen], least[many], length, gram)
    n = size[chosen] - length + 1
    at = np.zeros(len(pick), np.int64)
    at[many] = np.cumsum(n) - n
    high = least.copy()
    low = least.copy()
    if len(many):
        low[many], high[many] = np.minimum.reduceat(every, at[many]), np.maximum.reduceat(every, at[many])
    n = size[pick] - length + 1
    out = []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        k = number[a:b]
        mixed = low[k] != high[k]
        out.append((pack(np.concatenate([low[k], mixed.astype(np.int64)])), pack(every[ranges(at[k[mixed]], n[k[mixed]])])))
    return _answer(group, out)


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, full: bool = True, block_bytes: int = 3 * BLOCK_BYTES // 4,
                   bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row an input row: ``id_col``, n_bytes, n_removed, n_spans, kept_sha256, and with ``full`` kept (bytes) and spans.

    Removed: each byte of the UTF-8 text in a window of ``length`` bytes that also occurs in a row of a smaller id, overlapping or not. Windows
    don't cross documents, and are judged on the input. Ids are integers of any sign (TypeError for other types), below 2^63 - 1; a null id counts as
    greater than all others; rows of equal ids don't remove each other's bytes. Null texts are empty: nothing is removed. Other columns aren't read.
    """
    if not 1 < gram <= length:
        raise ValueError("gram must be between 2 and length")
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be of an integer type")
    spark = df.sparkSession
    docs = cut(texts(rows_of(df, id_col, text_col).select(F.col("id").cast("long").alias("id"), "text"), block_bytes))
    in_all = docs.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-in_all // bucket_bytes))  # a bucket is what a task holds at once
    packed = "block string, bucket int, kind int, x binary, y binary"
    names = ["block", "bucket", "kind", "x", "y"]

    def table(out: list[tuple]) -> pa.Table:
        types = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    def anchors_out(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row, length, gram)
                count = block.counts()
                edge = np.searchsorted(bucket_of(block.keys, buckets), np.arange(buckets + 1))
                out = [(row["block"], b, ANCHORS, pack(np.diff(block.keys[edge[b] : edge[b + 1]], prepend=U(0))), pack(count[edge[b] : edge[b + 1]])) for b in np.flatnonzero(np.diff(edge)).tolist()]
                yield from table(out).combine_chunks().to_batches()

    def totals(block: _Block, answers: dict) -> np.ndarray:
        got = answers.get(ANCHORS, {})
        total = np.concatenate([np.zeros(0, np.uint32), *(unpack(got[b][0], np.uint32) for b in sorted(got))])
        if len(total) != len(block.keys):
            raise RuntimeError("answers don't fit the block")
        return total

    def sorted_answers(group: pa.Table) -> dict:
        out: dict[int, dict[int, tuple]] = {}
        for r in group.to_pylist():
            out.setdefault(r["kind"], {})[r["bucket"]] = (r["x"], r["y"])
        return out

    def contexts_out(answers: pa.Table, group: pa.Table) -> pa.Table:
        found, out = sorted_answers(answers), []
        for row in group.slice(0, 1).to_pylist():  # equal blocks ask once
            block = _Block(row, length, gram)
            ((key, first, end, place, least), *_), ((one, two, least_w), *_) = block.contexts(totals(block, found), hot)
            edge = np.searchsorted(bucket_of(key, buckets), np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edge)).tolist():
                p = slice(edge[b], edge[b + 1])
                head = np.stack([np.diff(key[p], prepend=U(0)), (end[p] - first[p]).astype(U), place[p].astype(U), least[p].view(U)])
                out.append((row["block"], b, CONTEXTS, pack(head.ravel()), pack(block.data[ranges(first[p], end[p] - first[p])].tobytes())))
            edge = np.searchsorted(bucket_of(one, buckets), np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edge)).tolist():
                p = slice(edge[b], edge[b + 1])
                out.append((row["block"], b, WINDOWS, pack(np.concatenate([one[p], two[p]])), pack(least_w[p])))
        return table(out)

    def mark(answers: pa.Table, group: pa.Table) -> pa.Table:
        found, out = sorted_answers(answers), []
        for row in group.to_pylist():
            block = _Block(row, length, gram)
            (_, where, first, last, doc), (_, where_w, start, doc_w) = block.contexts(totals(block, found), hot)
            got = found.get(CONTEXTS, {})
            heads = [unpack(got[b][0], np.int64).reshape(2, -1) for b in sorted(got)]
            value, mixed = np.concatenate([np.zeros((2, 0), np.int64), *heads], 1)
            more = np.concatenate([np.zeros(0, np.int64), *(unpack(got[b][1], np.int64) for b in sorted(got))])
            edge = np.zeros(len(block.data) + 1, np.int64)
            own, n = block.ids[doc], last - first + 1
            mixed = mixed[where].astype(bool)
            whole = ~mixed & (value[where] < own)
            edge += np.bincount(first[whole], minlength=len(edge)) - np.bincount(last[whole] + length, minlength=len(edge))
            part = np.flatnonzero(mixed)
            of_context = np.zeros(len(value), np.int64)  # windows of each distinct context whose ids vary
            of_context[where[part]] = n[part]
            at = np.cumsum(of_context) - of_context
            w = ranges(at[where[part]], n[part])
            s = ranges(first[part], n[part])[more[w] < np.repeat(own[part], n[part])]
            got = found.get(WINDOWS, {})
            least = np.concatenate([np.zeros(0, np.int64), *(unpack(got[b][0], np.int64) for b in sorted(got))])
            s = np.concatenate([s, start[least[where_w] < block.ids[doc_w]]])
            edge += np.bincount(s, minlength=len(edge)) - np.bincount(s + length, minlength=len(edge))
            gone = np.cumsum(edge[:-1]) > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            starts = block.ends[:-1][np.diff(block.ends) > 0]
            begins[starts] = gone[starts]
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[block.ends])
            kept = [block.data[a:b][~gone[a:b]].tobytes() for a, b in zip(block.ends[:-1], block.ends[1:], strict=True)]
            columns = {
                "id": pa.array(row["ids"], pa.int64()), "n_bytes": pa.array(np.diff(block.ends)), "n_removed": pa.array(total(gone)), "n_spans": pa.array(total(begins)),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            }
            if full:
                stops = gone.copy()
                stops[:-1] &= ~gone[1:]
                stops[block.ends[1:][np.diff(block.ends) > 0] - 1] = gone[block.ends[1:][np.diff(block.ends) > 0] - 1]
                a, b = np.flatnonzero(begins), np.flatnonzero(stops) + 1
                of = np.searchsorted(block.ends, a, "right") - 1
                cuts = np.searchsorted(of, np.arange(len(kept) + 1))
                pairs = np.column_stack([a - block.ends[of], b - block.ends[of]])
                columns |= {"kept": pa.array(kept, pa.binary()), "spans": pa.array([pairs[x:y].tolist() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.list_(pa.list_(pa.int64())))}
            out.append(pa.table(columns))
        return pa.concat_tables(out) if out else pa.table({f.name: pa.array([], f.type) for f in schema})

    fields = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<array<long>>" * full
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(fields))
    shared = cut(docs.mapInArrow(anchors_out, packed).groupBy("bucket").applyInArrow(_totals, packed))
    asked = shared.groupBy("block").cogroup(docs.groupBy("block")).applyInArrow(contexts_out, packed)
    answered = asked.groupBy("bucket", "kind").applyInArrow(lambda group: _order(group, length, gram), packed)
    return shared.unionByName(answered).groupBy("block").cogroup(docs.groupBy("block")).applyInArrow(mark, fields).withColumnRenamed("id", id_col)
