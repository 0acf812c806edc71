"""Best-fit packing of documents into token sequences, improved by a swap-based local search.

1. Each document's ids are cut into pieces (only documents longer than a sequence are cut, the first piece takes the rest). Pieces as
   long as a sequence are done. The others go on as rows of a few numbers: ids never leave the task that made them.
2. Pieces are dealt by hash to groups of about ``GROUP``. A group packs its own by best fit, longest first, and then searches: a bin gives another one a piece,
   or exchanges one for one, two for one or one for two, whenever that raises the sum of squared fills. The fuller bin of a pair grows, so the emptier ones run out and vanish.
3. Each group is left with a few bins of much room. These go, with their pieces, to groups of their own, which search again; and so on until one group holds them all, a round closes less than a tenth of them, or ``ROUNDS`` are over.
   A sequence of one group can thus be filled up by any other, and no group ever holds more than a bounded number of pieces.

How the search finds an exchange: the emptiest bin is the donor. What it can offer (single pieces, pairs) is sorted; for every other bin and everything it can give
back (nothing, single pieces, pairs) the largest offer that fits is looked up, all at once. Equal lengths are the same offer: a bin of 1,024 tokens has
at most 44 different lengths, and bins of the same lengths are looked at once. Of all exchanges the one of the greatest gain is done. A donor without one rests, with all bins of the same
lengths, until it is changed itself; the search ends when all rest.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, release, spread
from .kernel import flat, slices
from .suffix_groups import ranges
from .token_counts import _pieces, tokenizer

FILE, SEQUENCE, END, GROUP, ROUNDS, SLICE, BATCH, REMEMBER = "byte_bpe_50k.json", 1024, 2, 4096, 4, 4 << 20, 16384, 1_000_000
OPEN = 16  # a bin goes on if it has room for more than SEQUENCE / OPEN tokens


#: Punctuation that the special string doesn't hold and no contraction begins with.
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in '!"#$%&()*+,-./:;=?@[]^_`{}~']] = True
_WORDS = np.zeros(256, bool)
_WORDS[0x30:0x3A] = _WORDS[0x41:0x5B] = _WORDS[0x61:0x7B] = True


def stretches(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the stretches that texts are encoded by, and the document of each: those of ``token_counts``, cut further before punctuation that follows a letter or digit (a run of either ends
    there, whatever comes), and before other white space that follows no white space (a run of it begins there, and goes on in the same stretch)."""
    starts, _ = _pieces(data, ends)
    more = np.zeros(len(data), bool)
    if len(data) > 1:
        here, before = data[1:], data[:-1]
        more[1:] = (_STOPS[here] & _WORDS[before]) | ((here >= 0x09) & (here <= 0x0D) & (before > 0x20) & (before < 0x7F))
        more[starts] = True
    else:
        more[starts] = True
    starts = np.flatnonzero(more)
    return starts, np.searchsorted(ends, starts, "right") - 1


class Encoder:
    """The ids of texts, from those of their stretches; each distinct stretch is encoded once while it's remembered."""

    def __init__(self, tok):
        self.tok, self.forget = tok, 0
        self.clear()

    def clear(self) -> None:
        self.known, self.ids, self.used = {}, np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _room(self, name: str, need: int) -> None:
        a = getattr(self, name)
        if need > len(a):
            setattr(self, name, np.concatenate([a, np.zeros(max(need, 2 * len(a)) - len(a), a.dtype)]))

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and the number of each text's."""
        starts, doc = stretches(data, ends)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(ends) - 1, np.int64)
        cuts = np.append(starts, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.utf8(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) + len(words) > REMEMBER and self.known:
            self.clear()
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            at = len(known)
            known.update(zip(new, range(at, at + len(new)), strict=True))
            for k in range(0, len(new), BATCH):
                got = [e.ids for e in self.tok.encode_batch_fast(new[k : k + BATCH], add_special_tokens=False)]
                size = np.fromiter(map(len, got), np.int64, len(got))
                own = np.fromiter((i for ids in got for i in ids), np.uint32, int(size.sum()))
                a, b = at + k, at + k + len(got)
                for name, need in (("ids", self.used + len(own)), ("start", b), ("size", b)):
                    self._room(name, need)
                self.ids[self.used : self.used + len(own)] = own
                self.start[a:b], self.size[a:b] = self.used + np.cumsum(size) - size, size
                self.used += len(own)
        code = np.fromiter(map(known.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        return self.ids[ranges(self.start[code], self.size[code])], np.bincount(doc, self.size[code], len(ends) - 1).astype(np.int64)


def cut_points(n: int, sequence: int) -> list[int]:
    """Where the pieces of a document of ``n`` ids begin."""
    first = n if n <= sequence else n % sequence or sequence
    return [0, *range(first, n, sequence)]


def pieces(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str = FILE, sequence: int = SEQUENCE, end: int = END) -> DataFrame:
    """(key: its number in the table, id, piece, start, length, ids_crc32) of each piece of each row."""
    rows = spread(df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")))

    def run(batches):
        encoder = Encoder(tokenizer(tokenizer_file, "packing"))
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, ends = flat(batch.column(1))
            for a, b in slices(ends, SLICE):
                ids, count = encoder.encode(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
                at, owner, number, start, length, crc = 0, [], [], [], [], []
                for k, n in enumerate(count.tolist()):
                    own = np.append(ids[at : at + n], np.uint32(end)).astype("<u4")
                    at += n
                    points = cut_points(n + 1, sequence)
                    for p, (x, y) in enumerate(zip(points, [*points[1:], n + 1], strict=True)):
                        owner.append(a + k)
                        number.append(p)
                        start.append(x)
                        length.append(y - x)
                        crc.append(zlib.crc32(own[x:y].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key + np.arange(len(owner))), batch.column(0).take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["key", "id", "piece", "start", "length", "ids_crc32"],
                )
                key += len(owner)

    return rows.mapInArrow(run, f"key long, id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit(length: np.ndarray, sequence: int) -> np.ndarray:
    """The bin of each piece: longest first, each into the fullest bin that has room."""
    at_room: list[list[int]] = [[] for _ in range(sequence + 1)]  # bins by room
    mask, out, bins = 0, np.empty(len(length), np.int64), 0
    for k in np.argsort(-length, kind="stable").tolist():
        n = int(length[k])
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = at_room[room].pop()
            if not at_room[room]:
                mask &= ~(1 << room)
        else:
            room, b, bins = sequence, bins, bins + 1
        out[k] = b
        if room > n:
            at_room[room - n].append(b)
            mask |= 1 << (room - n)
    return out


class Search:
    """Local search over bins. ``lengths`` has the pieces of each bin as {length: [pieces]}."""

    def __init__(self, length: np.ndarray, bin_of: np.ndarray, sequence: int):
        self.sequence, self.length, self.moves = sequence, length, 0
        self.bins: list[dict[int, list[int]]] = [{} for _ in range(int(bin_of.max(initial=-1)) + 1)]
        for k, b in enumerate(bin_of.tolist()):
            self.bins[b].setdefault(int(length[k]), []).append(k)
        self.fill = np.bincount(bin_of, length, len(self.bins)).astype(np.int64)
        self.names: list[tuple] = [()] * len(self.bins)
        self.like: dict[tuple, set[int]] = {}
        self.gives = [self._sums(b) for b in range(len(self.bins))]

    def _sums(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """What a bin can give: (sums of one piece or two, the shorter one of two, 0 for one)."""
        own = self.bins[b]
        size = np.array(sorted(own), np.int64)
        many = np.array([len(own[int(x)]) > 1 for x in size], bool)
        self.like.get(self.names[b], set()).discard(b)
        self.names[b] = tuple((int(x), len(own[int(x)])) for x in size)
        self.like.setdefault(self.names[b], set()).add(b)
        i, j = np.triu_indices(len(size), 1)
        return np.concatenate([size, size[i] + size[j], 2 * size[many]]), np.concatenate([np.zeros(len(size), np.int64), size[i], size[many]])

    def _others(self, donor: int):
        """What bins other than ``donor`` can give back, one bin of each kind, with nothing as one choice: (bin, sum, shorter one of two)."""
        who = [b for name, same in self.like.items() if name and (b := next((b for b in same if b != donor), None)) is not None and self.fill[b] < self.sequence]
        zero = np.zeros(1, np.int64)
        none = np.zeros(0, np.int64)
        given = [self.gives[b] for b in who]
        return np.repeat(np.array(who, np.int64), [len(x) + 1 for x, _ in given]), np.concatenate([none, *(y for x, _ in given for y in (zero, x))]), np.concatenate([none, *(y for _, x in given for y in (zero, x))])

    def find(self, donor: int):
        """The exchange of the greatest gain: (other bin, what the donor offers, what it gets back), each as (sum, shorter one)."""
        offer, pair = self.gives[donor]
        owner, back, back_pair = self._others(donor)
        best, found = 0, None
        room = self.sequence - self.fill
        for one in (True, False):  # single pieces against everything; pairs against nothing and single pieces
            mine = np.flatnonzero((pair == 0) == one)
            if not len(mine):
                continue
            mine = mine[np.argsort(offer[mine], kind="stable")]
            theirs = np.flatnonzero(one | (back_pair == 0))
            at = np.searchsorted(offer[mine], back[theirs] + room[owner[theirs]], "right") - 1
            ok = at >= 0
            theirs, at = theirs[ok], at[ok]
            d = offer[mine[at]] - back[theirs]
            gain = np.where(d > 0, d * (self.fill[owner[theirs]] - self.fill[donor] + d), 0)  # half of what the sum of squares gains
            if len(gain) and gain.max() > best:
                k = int(gain.argmax())
                best = int(gain[k])
                found = int(owner[theirs[k]]), (int(offer[mine[at[k]]]), int(pair[mine[at[k]]])), (int(back[theirs[k]]), int(back_pair[theirs[k]]))
        return found

    def _take(self, b: int, what: tuple[int, int]) -> list[int]:
        total, short = what
        out = []
        for n in ([total] if not short else [short, total - short]) if total else []:
            own = self.bins[b][n]
            out.append(own.pop())
            if not own:
                del self.bins[b][n]
        return out

    def exchange(self, donor: int, other: int, offer: tuple[int, int], back: tuple[int, int]) -> None:
        gone, come = self._take(donor, offer), self._take(other, back)
        for b, got in ((other, gone), (donor, come)):
            for k in got:
                self.bins[b].setdefault(int(self.length[k]), []).append(k)
            self.gives[b] = self._sums(b)
        self.fill[donor] += back[0] - offer[0]
        self.fill[other] += offer[0] - back[0]
        self.moves += 1

    def run(self) -> np.ndarray:
        """Searches until all bins rest; the bin of each piece."""
        rests = np.zeros(len(self.bins), bool)
        none = np.iinfo(np.int64).max
        while len(self.bins):
            order = np.where(rests | (self.fill == 0) | (self.fill == self.sequence), none, self.fill)
            donor = int(order.argmin())
            if order[donor] == none:
                break
            found = self.find(donor)
            if found is None:
                rests[list(self.like[self.names[donor]])] = True
            else:
                self.exchange(donor, *found)
                rests[found[0]] = False
        out = np.empty(len(self.length), np.int64)
        for b, own in enumerate(self.bins):
            for ks in own.values():
                out[ks] = b
        return out


def improve(length: np.ndarray, bin_of: np.ndarray, sequence: int, least_room: int) -> np.ndarray:
    """The bins after a search among those that have more than ``least_room`` left."""
    fill = np.bincount(bin_of, length).astype(np.int64)
    some = np.flatnonzero(sequence - fill[bin_of] > least_room)
    if len(some) < 2:
        return bin_of
    name, own = np.unique(bin_of[some], return_inverse=True)
    out = bin_of.copy()
    out[some] = name[Search(length[some], own, sequence).run()]
    return out


def _placed(group: pa.Table, sequence: int, least_room: int, first: bool) -> pa.Table:
    """The pieces of a group with the key of their bin, its fill and their place in it."""
    key, length = group["key"].to_numpy(), group["length"].to_numpy()
    by = np.argsort(key)
    group, key, length = group.take(pa.array(by)), key[by], length[by]
    own = best_fit(length, sequence) if first else np.unique(group["bin"].to_numpy(), return_inverse=True)[1]
    own = improve(length, own, sequence, least_room)
    order = np.lexsort((key, own))
    new = np.append(True, np.diff(own[order]) != 0)
    begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    before = np.cumsum(length[order]) - length[order]
    name, offset, fill = (np.empty(len(order), np.int64) for _ in range(3))
    name[order], offset[order] = key[order][begin], before - before[begin]
    fill[:] = np.bincount(own, length)[own]
    keep = group.select(["key", "id", "piece", "start", "length", "ids_crc32"])
    for c, x in (("bin", name), ("fill", fill), ("offset", offset)):
        keep = keep.append_column(c, pa.array(x))
    return keep


def pack(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str = FILE, sequence: int = SEQUENCE, end: int = END, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """One row a piece: ``id_col``, piece (from 0), start, length, ids_crc32, sequence_id, offset (gapless from 0 in each sequence of at most ``sequence`` ids).

    A document's ids are the tokenizer's (no added special tokens) and ``end``; null and empty texts have ``end`` alone. Documents of more than ``sequence`` ids
    are cut, from their end, into pieces of that many. Ids of documents may be null or repeat: every row is a document. Very long texts are encoded whole, in stretches between
    proven split positions. Other columns aren't read, whatever their names; an empty table gives an empty result. Writes the pieces, and the packing of each round, when called.
    """
    every = cut(pieces(df, id_col=id_col, text_col=text_col, tokenizer_file=tokenizer_file, sequence=sequence, end=end))
    whole = every.where(F.col("length") == sequence).withColumns({"bin": F.col("key"), "offset": F.lit(0).cast("long")})
    todo, done, open_ = every.where(F.col("length") < sequence), [], None
    kind = f"key long, id {every.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, bin long, fill long, offset long"
    least, n = sequence // OPEN, todo.count()
    for k in range(rounds):
        groups = -(-n // group)
        by = F.pmod(F.xxhash64("bin" if k else "key", F.lit(k)), F.lit(max(groups, 1)))
        first = k == 0
        placed = cut(todo.withColumn("g", by).groupBy("g").applyInArrow(lambda t: _placed(t, sequence, least if first else 0, first), kind))
        release(open_)
        left = placed.where(sequence - F.col("fill") > least)
        before, n = n, left.count()
        if groups <= 1 or k == rounds - 1 or n == 0 or (k and n > 0.9 * before):
            done.append(placed)
            break
        done.append(placed.where(sequence - F.col("fill") <= least))
        todo = left
    out = whole
    for d in done:
        out = out.unionByName(d.drop("fill"))
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
