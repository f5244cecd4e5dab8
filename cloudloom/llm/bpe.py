"""Byte-level BPE encoding and decoding around a global shuffle of distinct words.

1. Texts are cut into blocks of bounded bytes. In a block every pre-token gets a local number; the block's
   distinct pre-tokens are dealt by hash into buckets, and each document keeps its sequence of local numbers,
   that is, the positions of its pre-tokens.
2. A shuffle by bucket brings all copies of a word together. Each distinct word is encoded once there, and its
   ids join back to every block that holds the word.
3. A shuffle by block brings ids and positions together, and each document's ids are put in order.

A row of the first shuffle is one (block, bucket) with all its words packed, so a very common word costs one
entry a block. Buckets grow in number with the distinct words, which are far fewer than words, so a row stays a pack of many.

Decoding joins ids to the token-byte table, which is as large as the vocabulary and sent to each task.

Defined results: a null or empty text has no ids and decodes to no bytes; an empty table gives an empty table;
repeated rows are each encoded; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy

# White space as the pattern sees it, and what Python and RE2 might take for it: texts with two such
# characters side by side, one of them a space, are matched as a whole.
_WS = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_IRREGULAR = f"{_WS} | {_WS}"
# Pieces of plain letters with closing marks are split without the full pattern. It holds for patterns
# that match ` ?letters` and runs of other marks separately; checked in _plain_holds.
_PLAIN = r"^(?P<a> ?[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<b>[.,;:!?]*)$"


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


@functools.lru_cache(maxsize=4)
def _regex(pattern: str):
    import regex

    return regex.compile(pattern)


@functools.lru_cache(maxsize=4)
def _plain_holds(pattern: str) -> bool:
    find = _regex(pattern).findall
    return find(" ab") == [" ab"] and find("éb.,!") == ["éb", ".,!"] and find(" x?! y") == [" x", "?!", " y"]


def pre_tokens(texts: pa.Array, pattern: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pre-tokens of texts, the sequence of their numbers, and where each text begins in it.

    A space between two characters that aren't white space always begins a match, so texts are cut there
    first; only distinct pieces are matched.
    """
    find = _regex(pattern).findall
    odd = pc.match_substring_regex(texts, _IRREGULAR).to_numpy(zero_copy_only=False)
    if odd.any():
        lists = pa.array([find(t) if o else None for t, o in zip(texts.to_pylist(), odd)], pa.list_(pa.string()))
        split = pc.if_else(pa.array(odd), lists, pc.split_pattern(texts, " "))
    else:
        split = pc.split_pattern(texts, " ")
    offsets = split.offsets.to_numpy().astype(np.int64)
    flat = split.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    # Verbatim: the first piece of a text, and all pieces of the texts matched as a whole.
    verbatim = np.zeros(len(codes), dtype=bool)
    verbatim[offsets[:-1][np.diff(offsets) > 0]] = True
    for i in np.flatnonzero(odd):
        verbatim[offsets[i] : offsets[i + 1]] = True
    used, back = np.unique(codes[verbatim], return_inverse=True)
    codes[verbatim] = len(words) + back
    pieces = pa.concat_arrays([pc.binary_join_element_wise(" ", words, ""), words.take(pa.array(used))])

    # Ragged table: the pre-tokens of each piece.
    if _plain_holds(pattern):
        match = pc.extract_regex(pieces, _PLAIN)
        plain = match.is_valid().to_numpy(zero_copy_only=False)
        head, tail = match.field("a").filter(pa.array(plain)), match.field("b").filter(pa.array(plain))
    else:
        plain = np.zeros(len(pieces), dtype=bool)
        head = tail = pa.array([], pa.string())
    marked = pc.greater(pc.binary_length(tail), 0).to_numpy(zero_copy_only=False).astype(bool)
    rest = [find(p) for p in pieces.filter(pa.array(~plain)).to_pylist()]
    many = np.zeros(len(pieces), dtype=np.int64)
    many[plain] = 1 + marked
    many[~plain] = [len(r) for r in rest]
    begin = np.concatenate(([0], np.cumsum(many)))
    tokens = pa.concat_arrays([head, tail.filter(pa.array(marked)), pa.array([x for r in rest for x in r], pa.string())])
    tokens = tokens.dictionary_encode()
    number = tokens.indices.to_numpy().astype(np.int32)
    table = np.empty(begin[-1], dtype=np.int32)
    at = begin[:-1][plain]
    table[at] = number[: len(at)]
    table[at[marked] + 1] = number[len(at) : len(at) + marked.sum()]
    table[ragged(begin[:-1][~plain], many[~plain])] = number[len(at) + marked.sum() :]
    sequence = table[ragged(begin[:-1][codes], many[codes])]
    ends = np.concatenate(([0], np.cumsum(many[codes])))
    return tokens.dictionary, sequence, ends[offsets]


def flat_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary array without nulls."""
    wide = np.int64 if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else np.int32
    offsets = np.frombuffer(values.buffers()[1], dtype=wide)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = values.buffers()[2]
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... lengths[0] numbers; then the same for starts[1], ..."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return np.zeros(0, dtype=np.int64)
    return np.arange(ends[-1], dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def _pack(parts: list[np.ndarray | bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts))


def _unpack(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _blocks(batches, block_bytes: int):
    """(number, ids, texts) of blocks of about block_bytes; the number is the same whenever the task is run again."""
    part, serial = TaskContext.get().partitionId(), 0
    for batch in batches:
        texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
        if not len(texts):
            continue
        upto = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64) + 16)
        cut = np.flatnonzero(np.diff(upto // block_bytes)) + 1
        for lo, hi in zip([0, *cut], [*cut, len(texts)]):
            yield (part << 24) + serial, batch.column(0).slice(lo, hi - lo), texts.slice(lo, hi - lo)
            serial += 1


def _local(texts: pa.Array, pattern: str, buckets: int):
    """The block's words in the order of their buckets, each bucket's first place, and the sequence in that order."""
    import pandas as pd

    words, sequence, offsets = pre_tokens(texts, pattern)
    bucket = (pd.util.hash_array(np.array(words.to_pylist(), dtype=object), categorize=False) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return words, order, starts, place[sequence] if len(sequence) else sequence, offsets


def encode(
    docs: DataFrame,
    ranks: bytes,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = 6 << 20,
    bucket_words: int = 20_000,
) -> DataFrame:
    """(id, ids) for each row of docs. ranks: the bytes of a .tiktoken file; pattern: its pre-token pattern.

    bucket_words: distinct words to a bucket; their number is estimated over all texts, words taken at blanks.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    distinct = rows.select(F.explode(F.split("text", " ")).alias("w")).agg(F.approx_count_distinct("w", 0.05)).first()[0] or 0
    buckets = int(max(16, distinct // bucket_words))
    id_type = rows.schema["id"].dataType
    table = spark.sparkContext.broadcast(ranks)  # bounded by the vocabulary

    def words_of(batches):
        for block, _, texts in _blocks(batches, block_bytes):
            words, order, starts, _, _ = _local(texts, pattern, buckets)
            words = words.take(pa.array(order)).cast(pa.binary())
            ends, data = flat_bytes(words)
            out = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(starts, starts[1:])) if hi > lo]
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([block] * len(out), pa.int64()),
                    "bucket": pa.array([b for b, _, _ in out], pa.int32()),
                    "n": pa.array([hi - lo for _, lo, hi in out], pa.int32()),
                    "words": pa.array([_pack([np.diff(ends[lo : hi + 1]).astype(np.int32), data[ends[lo] : ends[hi]]]) for _, lo, hi in out], pa.binary()),
                }
            )
        tidy()

    def positions_of(batches):
        for block, ids, texts in _blocks(batches, block_bytes):
            words, _, _, sequence, offsets = _local(texts, pattern, buckets)
            # Three planes of bytes, which pack better than whole numbers.
            planes = sequence.view(np.uint8).reshape(-1, 4)
            blobs = [_pack([np.ascontiguousarray(planes[lo:hi, k]) for k in range(4)]) for lo, hi in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([block] * len(ids), pa.int64()),
                    "n_words": pa.array([len(words)] * len(ids), pa.int32()),
                    "id": ids,
                    "places": pa.array(blobs, pa.binary()),
                }
            )
        tidy()

    def encode_bucket(group: pa.Table) -> pa.Table:
        own = _encoding_of(table.value, pattern)
        done: dict[bytes, bytes] = {}
        out = []
        for n, blob in zip(group["n"].to_pylist(), group["words"].to_pylist()):
            raw = _unpack(blob)
            ends = np.concatenate(([0], np.cumsum(np.frombuffer(raw, dtype=np.int32, count=n)))) + 4 * n
            many, ids = np.empty(n, dtype=np.int32), []
            for i, (lo, hi) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
                word = raw[lo:hi]
                got = done.get(word)
                if got is None:
                    got = done[word] = np.array(own._encode_single_piece(word), dtype=np.int32).tobytes()
                many[i] = len(got) >> 2
                ids.append(got)
            out.append(_pack([many, b"".join(ids)]))
        return pa.table({"block": group["block"], "bucket": group["bucket"], "n": group["n"], "ids": pa.array(out, pa.binary())})

    def reassemble(places: pa.Table, encoded: pa.Table) -> pa.Table:
        encoded = encoded.sort_by("bucket")
        many, flat = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for n, blob in zip(encoded["n"].to_pylist(), encoded["ids"].to_pylist()):
            raw = np.frombuffer(_unpack(blob), dtype=np.int32)
            many.append(raw[:n])
            flat.append(raw[n:])
        many, flat = np.concatenate(many), np.concatenate(flat)
        starts = np.cumsum(many) - many
        if set(places["n_words"].to_pylist()) - {len(many)}:
            raise RuntimeError("a block's words and positions differ: the input gave other rows when read again")
        sequences = [np.frombuffer(_unpack(b), dtype=np.uint8) for b in places["places"].to_pylist()]
        sequences = [np.ascontiguousarray(s.reshape(4, -1).T).view(np.int32).ravel() for s in sequences]
        sequence = np.concatenate(sequences) if sequences else np.zeros(0, np.int32)
        ids = flat[ragged(starts[sequence], many[sequence].astype(np.int64))]
        ends = np.concatenate(([0], np.cumsum(many[sequence], dtype=np.int64)))
        offsets = ends[np.concatenate(([0], np.cumsum([len(s) for s in sequences])))]
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
        del sequences, sequence, ids, flat, starts, many, ends
        tidy()
        return pa.table({"id": places["id"], "ids": lists})

    words = rows.mapInArrow(words_of, "block long, bucket int, n int, words binary")
    encoded = words.groupBy("bucket").applyInArrow(encode_bucket, "block long, bucket int, n int, ids binary")
    schema = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("n_words", T.IntegerType()), T.StructField("id", id_type), T.StructField("places", T.BinaryType())]
    )
    places = rows.mapInArrow(positions_of, schema)
    out = T.StructType([T.StructField("id", id_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    joined = places.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(reassemble, out)
    return joined.withColumnRenamed("id", id_col)


@functools.lru_cache(maxsize=2)
def _encoding_of(ranks: bytes, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(ranks), special_tokens={})


def decode(encoded: DataFrame, ranks: bytes, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with the bytes of each row's ids. An id outside the vocabulary is an error."""
    table = encoded.sparkSession.sparkContext.broadcast(ranks)
    names = encoded.columns

    def run(batches):
        ordered = sorted(load_ranks(table.value).items(), key=lambda x: x[1])
        most = ordered[-1][1] + 1 if ordered else 0
        lengths = np.full(most, -1, dtype=np.int64)
        lengths[[r for _, r in ordered]] = [len(b) for b, _ in ordered]
        data = np.frombuffer(b"".join(b for b, _ in ordered), dtype=np.uint8)
        begins = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
        for batch in batches:
            lists = batch.column(names.index(ids_col))
            if lists.null_count:
                lists = pc.fill_null(lists, pa.scalar([], lists.type))
            at = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy()
            out, cut = [], np.searchsorted(at, np.arange(at[0], at[-1] + 1, 1 << 20)[1:])
            for lo, hi in zip([0, *cut], [*cut, len(lists)]):
                own = ids[at[lo] : at[hi]]
                if len(own) and (own.min() < 0 or own.max() >= most or lengths[own].min() < 0):
                    raise ValueError("an id is outside the vocabulary")
                blob = data[ragged(begins[own], lengths[own])].tobytes()
                ends = np.concatenate(([0], np.cumsum(lengths[own])))[at[lo : hi + 1] - at[lo]]
                out += [blob[a:b] for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*names, out_col])
            del out
        tidy()

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(out_col, T.BinaryType())]))
