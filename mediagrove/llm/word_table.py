"""BPE encoding and decoding through a table of distinct words.

Words are what ASCII white space separates. The tokenizer's normaliser keeps such white space apart from its neighbours, its
splitter never crosses it and yields nothing for it, so the ids of a text are those of its words, one after another.
Each block of documents sends its distinct words once (see ``blocks``); the bucket that a word's hash falls in encodes
each distinct word of the corpus once; ids return to the block and are joined back by position. Decoding joins
ids to the vocabulary's pieces by id (a dense table of the vocabulary's size) and puts one space between pieces, as the
tokenizer without a decoder does.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .base import held
from .blocks import BLOCK_BYTES, blocks, bucket_of, opened, pack, rows_of, texts, unpack
from .kernel import NOT_WHITE, Words, letters
from .token_counts import tokenizer

FILE, BATCH = "word_bpe_49k.json", 4096
_TABLE = letters(False)


def distinct_words(data: np.ndarray, ends: np.ndarray, buckets: int):
    """The block's distinct words by bucket, most frequent first; each word's code; words by document.

    Codes count words of rank 0 of all buckets, then those of rank 1, and so on: frequent words have small codes, and the
    sizes of the buckets alone say which code a word of a bucket has.
    """
    words = Words(data, ends, NOT_WHITE)
    n = len(words.start)
    raw = pa.py_buffer(np.ascontiguousarray(data))
    edge = np.empty(2 * n + 1, np.int32)
    edge[0:-1:2], edge[1::2], edge[-1] = words.start, words.end, words.end[-1] if n else 0
    every = pa.Array.from_buffers(pa.utf8(), 2 * n, [None, pa.py_buffer(edge), raw]).take(pa.array(np.arange(0, 2 * n, 2))) if n else pa.array([], pa.utf8())
    coded = every.dictionary_encode()
    index, names = coded.indices.to_numpy(), coded.dictionary
    times = np.bincount(index, minlength=len(names))
    first = np.zeros(len(names), np.int64)
    first[index[::-1]] = np.arange(n - 1, -1, -1)
    bucket = bucket_of(words.hashes(_TABLE)[first], buckets) if n else np.zeros(0, np.int64)
    order = np.lexsort((first, -times, bucket))
    size = np.bincount(bucket, minlength=buckets)
    rank = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
    code = np.empty(len(order), np.int64)
    code[order[np.lexsort((bucket[order], rank))]] = np.arange(len(order))
    return names.take(pa.array(order)), size, code[index], words.count


def places(size: np.ndarray) -> np.ndarray:
    """The codes of the words in bucket order, from the buckets' sizes."""
    rank = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out = np.empty(len(rank), np.int64)
    out[np.lexsort((np.repeat(np.arange(len(size)), size), rank))] = np.arange(len(rank))
    return out


def pieces(file: str) -> pa.Array:
    """The piece of every id, by id; '' for ids that the vocabulary leaves out."""

    def load():
        tok = tokenizer(file, "word_table")
        return pa.array([tok.id_to_token(k) or "" for k in range(tok.get_vocab_size(with_added_tokens=True))], pa.large_utf8())

    return held("word_table", f"pieces of {file}", load)


def encode_decode(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str = FILE, full: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: ``id_col``, n_tokens, ids_sha256, decoded_sha256, and with ``full`` also ids (array<int>) and decoded.

    Ids as the tokenizers library gives them without added special tokens (special strings in texts are taken as it takes
    them); the decoded text as its decode(ids, skip_special_tokens=False). Null and empty texts, and texts of white space, have
    no ids and decode to ''. Ids of documents may be null or repeat; each row gives one row. Other columns aren't read.
    """
    spark = df.sparkSession
    rows = rows_of(df, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def words_out(batches):
        for name, _, data, ends in blocks(batches, block_bytes):
            names, size, _, _ = distinct_words(data, ends, buckets)
            at = np.cumsum(size) - size
            full_at = np.flatnonzero(size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(full_at.astype(np.int32)), pa.array([name] * len(full_at), pa.string()),
                 pa.array([pack(" ".join(names.slice(at[k], size[k]).to_pylist()).encode()) for k in full_at], pa.binary())],
                ["bucket", "block", "words"],
            )

    def encode(group: pa.Table) -> pa.Table:
        tok = tokenizer(tokenizer_file, "word_table")
        known: dict[str, int] = {}
        lists = [np.fromiter((known.setdefault(w, len(known)) for w in unpack(x).decode().split(" ")), np.int32) for x in group["words"].to_pylist()]
        words = list(known)
        got = [[e.ids for e in tok.encode_batch_fast(words[k : k + BATCH], add_special_tokens=False)] for k in range(0, len(words), BATCH)]  # each distinct word once
        count = np.fromiter((len(e) for part in got for e in part), np.int64, len(words))
        ids = np.fromiter((i for part in got for e in part for i in e), np.uint32, int(count.sum()))
        del known, words, got
        start = np.cumsum(count) - count
        out = []
        for k in lists:
            n = count[k]
            out.append((pack(n.astype(np.uint32)), pack(ids[np.repeat(start[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())])))
        return pa.table({"block": group["block"], "bucket": group["bucket"], "counts": pa.array([c for c, _ in out], pa.binary()), "ids": pa.array([i for _, i in out], pa.binary())})

    def codes_out(batches):
        for name, own, data, ends in blocks(batches, block_bytes):
            _, size, code, count = distinct_words(data, ends, buckets)
            ids = pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), own.column(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), ids, *(pa.array([pack(x.astype(np.uint32))], pa.binary()) for x in (count, size, code))],
                ["block", "ids", "per_doc", "sizes", "codes"],
            )

    def assemble(answers: pa.Table, docs: pa.Table) -> pa.Table:
        found = {r["bucket"]: r for r in answers.to_pylist()}
        out = []
        for row in docs.to_pylist():
            size, code, per_doc = (unpack(row[c], np.uint32).astype(np.int64) for c in ("sizes", "codes", "per_doc"))
            own = [found[k] for k in np.flatnonzero(size).tolist()]
            count = np.concatenate([np.zeros(0, np.uint32), *(unpack(r["counts"], np.uint32) for r in own)]).astype(np.int64)
            flat_ids = np.concatenate([np.zeros(0, np.uint32), *(unpack(r["ids"], np.uint32) for r in own)])
            if len(count) != size.sum():
                raise RuntimeError("a block was cut differently when it was read again")
            where = np.empty(len(count), np.int64)  # code -> place in bucket order
            where[places(size)] = np.arange(len(count))
            edge = pa.array(np.concatenate([[0], np.cumsum(count)]))
            table = pa.LargeListArray.from_arrays(edge, pa.array(flat_ids))
            shown = pc.binary_join(pa.LargeListArray.from_arrays(edge, pieces(tokenizer_file).take(pa.array(flat_ids))), pa.scalar(" ", pa.large_utf8()))
            at = where[code]
            doc = np.repeat(np.arange(len(per_doc)), per_doc)
            n_ids = count[at]
            tokens = np.bincount(doc, n_ids, len(per_doc)).astype(np.int64)
            ids = table.take(pa.array(at)).flatten().to_numpy().astype("<u4")
            some = n_ids > 0
            by_doc = np.concatenate([[0], np.cumsum(np.bincount(doc[some], minlength=len(per_doc)))])
            decoded = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(by_doc), shown.take(pa.array(at[some]))), pa.scalar(" ", pa.large_utf8()))
            id_edge = np.concatenate([[0], np.cumsum(tokens)])
            raw = ids.tobytes()
            text = [x.as_buffer() for x in decoded]
            columns = {
                "id": pa.array(row["ids"], docs.schema.field("ids").type.value_type),
                "n_tokens": pa.array(tokens),
                "ids_sha256": pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(id_edge[:-1], id_edge[1:], strict=True)], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in text], pa.string()),
            }
            if full:
                columns |= {"ids": pa.ListArray.from_arrays(pa.array(id_edge.astype(np.int32)), pa.array(ids.astype(np.int32))), "decoded": decoded.cast(pa.string())}
            out.append(pa.table(columns))
        return pa.concat_tables(out) if out else pa.table({f.name: pa.array([], f.type) for f in schema})

    fields = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(fields))
    answers = rows.mapInArrow(words_out, "bucket int, block string, words binary").groupBy("bucket").applyInArrow(encode, "block string, bucket int, counts binary, ids binary")
    coded = rows.mapInArrow(codes_out, f"block string, ids array<{kind}>, per_doc binary, sizes binary, codes binary")
    return answers.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(assemble, fields).withColumnRenamed("id", id_col)
