"""Language-model scores by a weighted backoff automaton.

Tokens are lower-cased words between ASCII white space, then one end token a document. The model is the hierarchical Dirichlet
chain P(w | h) = (c(h w) + mass * P(w | shorter h)) / (c(h) + mass) down to the add-0.1 unigram, from all training
documents. As an automaton: each seen n-gram is a state; a state h has an arc w for each seen h w, of weight log10 P(w | h), and
a failure arc to the shorter context of weight log10(mass / (c(h) + mass)), 0 if h was never seen. Reading a token follows failure
arcs up to the first state with an arc, adds the weights, and moves to the longest seen suffix.

Counts of all n-grams of the corpus don't fit in one machine, so each block of documents gathers just the states and arcs that
its own texts can reach (see ``blocks``): it sends its distinct n-grams with their training counts, buckets add them up over
the corpus, and totals come back. The block builds its automaton and reads its texts once, left to right: many texts in step,
each carrying its state. A long text is read in segments of ``SEGMENT`` tokens, which begin in the state that the tokens
before them lead to: a state holds ``order`` - 1 tokens at most, so reading these from the empty context gives it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut
from .blocks import BLOCK_BYTES, blocks, bucket_of, opened, pack, rows_of, texts, unpack
from .kernel import NOT_WHITE, U, Words, letters, mix

ORDER, MASS, SEGMENT = 2, 8.0, 512
_TABLE = letters(True)
END, BEGIN = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)


class Tokens:
    """Keys of the n-grams of some documents that end at each token, by order, and the token's document."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, order: int):
        words = Words(data, ends, NOT_WHITE)
        docs = len(ends) - 1
        self.count = words.count + 1
        self.first = np.cumsum(self.count) - self.count
        self.doc = np.repeat(np.arange(docs), self.count)
        token = np.full(int(self.count.sum()), END)
        token[np.arange(len(words.start)) + words.doc] = words.hashes(_TABLE)
        self.keys = [token]
        place = np.arange(len(token)) - np.repeat(self.first, self.count)
        key = token
        for k in range(1, order):  # contexts reach back to one begin mark, not beyond
            back = np.full(len(token), BEGIN)
            back[k:] = token[:-k] if k < len(token) else token[:0]
            back[place < k] = BEGIN
            key = np.where(place >= k - 1, mix(key * U(0xD1342543DE82EF95) + back + U(k)), U(0))
            self.keys.append(key)


def grams_of(tokens: Tokens, order: int):
    """By order: (distinct keys in ascending order, place of each token's key in them). The begin mark counts as a unigram; key 0
    stands for no n-gram, where a text's start leaves fewer tokens."""
    out = []
    for n in range(order):
        keys = tokens.keys[n]
        if n == 0:
            keys = np.concatenate([keys, np.full(len(tokens.first), BEGIN)])
        out.append(np.unique(keys, return_inverse=True))
    return out


class Automaton:
    """The states and arcs that the texts of a block can reach. State 0 is the empty context, which has an arc for every word.

    ``totals``: by order, the training counts of the distinct n-grams of ``grams_of``.
    """

    def __init__(self, tokens: Tokens, grams: list, totals: list, order: int, mass: float, train_tokens: int, vocabulary: int, segment: int = SEGMENT):
        m = len(tokens.doc)
        place = np.arange(m) - np.repeat(tokens.first, tokens.count)
        self.tokens, self.order, self.segment = tokens, order, max(segment, order)
        at = [p[:m] for _, p in grams]  # the number of the n-gram that ends at a token, by order
        self.word, self.words = at[0], len(grams[0][0])
        self.base = np.log10((totals[0] + 0.1) / (train_tokens + 0.1 * (vocabulary + 1)))
        begin = grams[0][1][m:][:1]
        state, fail, leave, states = [], [np.zeros(1, np.int64)], [np.zeros(1)], 1
        arcs, weights, nexts = [], [], []
        log_p = self.base
        token_of = None
        for n in range(1, order):  # contexts of n tokens, arcs of n + 1
            known = np.flatnonzero((totals[n - 1] > 0) & (grams[n - 1][0] != 0))
            own = np.zeros(len(totals[n - 1]), np.int64)  # 0: no state
            own[known] = states + np.arange(len(known))
            states += len(known)
            state.append(own)
            fail.append(np.zeros(len(known), np.int64) if n == 1 else state[-2][at[n - 2][token_of[known]]])
            leave.append(np.log10(mass / (totals[n - 1][known] + mass)))
            token_of = np.empty(len(totals[n]), np.int64)  # a token at which each n-gram ends
            token_of[at[n]] = np.arange(m)
            seen = np.flatnonzero((totals[n] > 0) & (grams[n][0] != 0))
            t = token_of[seen]
            before = np.where(place[t] > 0, at[n - 1][t - 1], begin[0] if len(begin) else 0) if n == 1 else at[n - 1][t - 1]
            p = np.log10((totals[n][seen] + mass * 10 ** log_p[at[n - 1][t]]) / (totals[n - 1][before] + mass))
            log_p = np.zeros(len(totals[n]))
            log_p[seen] = p
            arcs.append(own[before] * self.words + self.word[t])
            weights.append(p)
            nexts.append((n, seen, at[n - 1][t]))
        self.start = state[0][begin[0]] if state and len(begin) else 0
        self.fail, self.leave = np.concatenate(fail), np.concatenate(leave)
        to = [state[n][seen] if n < order - 1 else state[n - 1][low] for n, seen, low in nexts]
        self.root = state[0] if state else np.zeros(self.words, np.int64)
        self.arcs, self.weights, self.to = (np.concatenate([np.zeros(0, d), *x]) for x, d in ((arcs, np.int64), (weights, float), (to, np.int64)))
        by = np.argsort(self.arcs, kind="stable")
        self.arcs, self.weights, self.to = self.arcs[by], self.weights[by], self.to[by]

    def read(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log10 probabilities of a word each in some states, and the states after it."""
        weight, after, left = np.zeros(len(state)), np.empty(len(state), np.int64), np.arange(len(state))
        while len(left):
            key = state * self.words + word
            at = np.minimum(np.searchsorted(self.arcs, key), max(0, len(self.arcs) - 1))
            found = (self.arcs[at] == key) & (state > 0) if len(self.arcs) else np.zeros(len(left), bool)
            weight[left[found]] += self.weights[at[found]]
            after[left[found]] = self.to[at[found]]
            root = state == 0
            weight[left[root]] += self.base[word[root]]
            after[left[root]] = self.root[word[root]]
            on = ~found & ~root  # no arc: the failure arc to the shorter context
            left, state, word = left[on], state[on], word[on]
            weight[left] += self.leave[state]
            state = self.fail[state]
        return weight, after

    def walk(self) -> np.ndarray:
        """The weight of every token, read left to right."""
        tokens, step = self.tokens, self.segment
        n = -(-tokens.count // step)
        doc = np.repeat(np.arange(len(n)), n)
        rank = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        first = tokens.first[doc] + rank * step
        size = np.minimum(step, tokens.first[doc] + tokens.count[doc] - first)
        order = np.argsort(-size, kind="stable")
        first, size, later = first[order], size[order], rank[order] > 0
        state = np.where(later, 0, self.start)
        for k in range(self.order - 1, 0, -1):  # segments inside a text: the state of the tokens before
            state[later] = self.read(state[later], self.word[first[later] - k])[1]
        out = np.empty(len(tokens.doc))
        active = np.searchsorted(-size, -np.arange(size.max(initial=0)), "left")  # segments longer than each step
        for k, a in enumerate(active.tolist()):
            out[first[:a] + k], state[:a] = self.read(state[:a], self.word[first[:a] + k])
        return out


def score(df: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, mass: float = MASS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: ``id_col``, train (its flag), n_tokens, n_known, train_tokens, base_score, score (log10).

    ``train`` says which rows the model learns from; null counts as no. Null and empty texts have the end token alone. Without
    training rows every probability is that of the smoothed unigram over no counts. Ids may be null or repeat; each
    row gives one row. Other columns aren't read. N-grams are known by 64-bit hashes.
    """
    if order < 1:
        raise ValueError("order: 1 or more")
    spark = df.sparkSession
    rows = rows_of(df, id_col, text_col, F.coalesce(train, F.lit(False)).alias("train"))
    kind = rows.schema["id"].dataType.simpleString()
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def keys_out(batches):
        for name, own, data, ends in blocks(batches, block_bytes):
            flag = own.column(2).to_numpy(zero_copy_only=False)
            tokens = Tokens(data, ends, order)
            learns = flag[tokens.doc]
            out = []
            for n, (keys, place) in enumerate(grams_of(tokens, order)):
                count = np.bincount(place, np.concatenate([learns, flag]) if n == 0 else learns, len(keys)).astype(np.uint32)
                edge = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(edge)).tolist():
                    part = slice(edge[b], edge[b + 1])
                    out.append((b, n + 1, name, pack(np.diff(keys[part], prepend=U(0))), pack(count[part])))
            bucket, size, block, keys, counts = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(size, pa.int32()), pa.array(block), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["bucket", "n", "block", "keys", "counts"])

    def add_up(group: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpack(x, U), dtype=U) for x in group["keys"].to_pylist()]
        counts = [unpack(x, np.uint32) for x in group["counts"].to_pylist()]
        same, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts), len(same)).astype(np.uint32)
        edge = np.cumsum([0, *map(len, keys)])
        unigrams = group["n"][0].as_py() == 1
        known = int(((total > 0) & (same != BEGIN)).sum()) if unigrams else 0
        tokens = int(total[same != BEGIN].sum(dtype=np.int64)) if unigrams else 0
        first = np.arange(len(keys)) == 0
        return pa.table({
            "block": group["block"], "bucket": group["bucket"], "n": group["n"],
            "totals": pa.array([pack(total[place[a:b]]) for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary()),
            "known": pa.array(np.where(first, known, 0)), "tokens": pa.array(np.where(first, tokens, 0)),
        })

    totals = cut(
        rows.mapInArrow(keys_out, "bucket int, n int, block string, keys binary, counts binary")
        .groupBy("bucket", "n")
        .applyInArrow(add_up, "block string, bucket int, n int, totals binary, known long, tokens long")
    )
    whole = totals.agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    vocabulary, train_tokens = int(whole[0]), int(whole[1])

    def walk(answers: pa.Table, docs: pa.Table) -> pa.Table:
        found: dict[int, dict[int, bytes]] = {}
        for r in answers.to_pylist():
            found.setdefault(r["n"], {})[r["bucket"]] = r["totals"]
        out = []
        for row in docs.to_pylist():
            data, ends = opened(row)
            tokens = Tokens(data, ends, order)
            grams, totals = grams_of(tokens, order), []
            for n, (keys, _) in enumerate(grams):
                totals.append(np.concatenate([unpack(found[n + 1][b], np.uint32) for b in sorted(found[n + 1])]).astype(float))
                if len(totals[-1]) != len(keys):
                    raise RuntimeError("a block was cut differently when it was read again")
            machine = Automaton(tokens, grams, totals, order, mass, train_tokens, vocabulary)
            seen, base, weight = totals[0][machine.word], machine.base[machine.word], machine.walk()
            add = lambda x: np.add.reduceat(x, tokens.first)  # noqa: E731  each document has its end token
            out.append(pa.table({
                "id": pa.array(row["ids"], docs.schema.field("ids").type.value_type), "train": pa.array(unpack(row["flags"], np.uint8).astype(bool)),
                "n_tokens": pa.array(tokens.count.astype(np.int64)), "n_known": pa.array(add((seen > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(tokens.count), train_tokens)), "base_score": pa.array(add(base)), "score": pa.array(add(weight)),
            }))
        return pa.concat_tables(out) if out else pa.table({f.name: pa.array([], f.type) for f in schema})

    fields = f"id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(fields))
    return totals.select("block", "bucket", "n", "totals").groupBy("block").cogroup(texts(rows, block_bytes, "train").groupBy("block")).applyInArrow(walk, fields).withColumnRenamed("id", id_col)
