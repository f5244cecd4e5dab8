"""Suffix-array dedup with a logarithmic index family.

A byte goes when a string of ``length`` bytes that covers it starts in a second place, in the same document or another.
So the question is, for each window of that length, whether its bytes occur twice. Beside that, passages of ``passage`` words that
recur in another document are reported, by the same steps over words instead of bytes: such passages may be shorter than
``length`` bytes, and nothing is removed for them.

1. Every window has an anchor: of its substrings of ``anchor`` bytes the one with the least hash, the leftmost at ties. The
   windows of a text fall into runs with one anchor. Equal windows have equal anchors, so only runs whose anchor occurs
   twice matter.
2. Runs that are equal as a whole are counted and become one, in each task before anything is shuffled; if there were several, all
   their windows occur twice. One of each stays for comparison with other runs of the same anchor, if there are any.
3. Anchors are dealt to buckets. In a bucket, batches of runs arrive one after the other. Each gets a suffix array (its windows
   in order of their bytes), is scanned against the arrays of the existing levels in a merge for matches, and becomes a
   level; levels of equal size merge, so there are logarithmically many.
4. An anchor with very many different runs (a passage that a third of all documents quote, cut differently) is not
   given to one task: its windows are counted by 64-bit hashes of the window, combined in each task and dealt by hash.

What was found joins back to each document's runs; that join has no group behind it, so one common run can be split among tasks.
Words are compared by 64-bit hashes. Of equal word windows of one text only the first takes part.

Defined results: a null text is an empty one; texts shorter than ``length`` lose nothing; repeated rows are copies of each
other; an empty table gives an empty table; extra columns are ignored. Ids are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _pack, _unpack, flat_bytes
from .common import discard, materialize
from .shingles import byte_codes, mix, powers_for, slices, word_hashes

_PLACE_BITS = 28


class IndexFamily:
    """Suffix arrays over windows of a fixed length in bytes, in levels that double in size. Windows start every ``unit`` bytes.

    ``add`` takes a batch of texts and returns nothing; ``repeated`` tells for every window added so far, by text,
    whether its bytes occur twice. Only the first ``length`` bytes of a suffix matter, so the order ends there.
    An array keeps one of several equal windows.
    """

    def __init__(self, length: int, unit: int = 1):
        self.length, self.unit = length, unit
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # batches, windows in order, their numbers
        self.twice: list[np.ndarray] = []
        self.first: list[np.ndarray] = []  # of each text, the number of its first window
        self.n = 0

    def add(self, texts: list[bytes]) -> None:
        size = np.array([max(0, (len(t) - self.length) // self.unit + 1) for t in texts], dtype=np.int64)
        self.first.append(self.n + np.cumsum(size) - size)
        number = np.arange(self.n, self.n + size.sum(), dtype=np.int64)
        self.n += len(number)
        self.twice.append(np.zeros(len(number), dtype=bool))
        if not len(number):
            return
        # A view of the joined texts as overlapping strings of the given length.
        joined = np.frombuffer(b"".join(texts), dtype=np.uint8)
        view = np.ndarray((len(joined) - self.length) // self.unit + 1, dtype=f"S{self.length}", buffer=joined, strides=(self.unit,))
        at = (np.cumsum([len(t) for t in texts]) - [len(t) for t in texts]) // self.unit
        starts = np.repeat(at, size) + (number - np.repeat(self.first[-1], size))
        keys = view[starts]
        order = np.argsort(keys, kind="stable")
        level = self._unique(1, keys[order], number[order])
        for _, there, names in self.levels:
            self._scan(level, there, names)
        self.levels.append(level)
        while len(self.levels) > 1 and self.levels[-1][0] >= self.levels[-2][0]:
            self._merge()

    def _mark(self, numbers: np.ndarray) -> None:
        ends = np.cumsum([len(t) for t in self.twice])
        part = np.searchsorted(ends, numbers, side="right")
        for p in np.unique(part):
            own = numbers[part == p]
            self.twice[p][own - (ends[p] - len(self.twice[p]))] = True

    def _unique(self, batches: int, keys: np.ndarray, names: np.ndarray):
        same = keys[1:] == keys[:-1]
        self._mark(np.concatenate((names[1:][same], names[:-1][same])))
        fresh = np.concatenate(([True], ~same))
        return batches, keys[fresh], names[fresh]

    def _scan(self, level, there: np.ndarray, names: np.ndarray) -> None:
        """One ordered pass over two arrays: equal windows are marked in both."""
        _, keys, own = level
        at = np.minimum(np.searchsorted(there, keys), len(there) - 1)
        hit = np.flatnonzero(there[at] == keys)
        self._mark(np.concatenate((own[hit], names[at[hit]])))

    def _merge(self) -> None:
        (b, y, v), (a, x, u) = self.levels.pop(), self.levels.pop()
        place = np.searchsorted(x, y) + np.arange(len(y))
        keys = np.empty(len(x) + len(y), dtype=x.dtype)
        names = np.empty(len(keys), dtype=np.int64)
        rest = np.ones(len(keys), dtype=bool)
        rest[place] = False
        keys[place], names[place], keys[rest], names[rest] = y, v, x, u
        fresh = np.concatenate(([True], keys[1:] != keys[:-1]))
        self.levels.append((a + b, keys[fresh], names[fresh]))

    def repeated(self) -> list[np.ndarray]:
        """Of each text in order of arrival, for each of its windows."""
        flat = np.concatenate([np.zeros(0, bool), *self.twice])
        first = np.concatenate([np.zeros(0, np.int64), *self.first])
        return np.split(flat, first[1:]) if len(first) else []


def _prefix(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a sequence of codes, sums by which any stretch of it is hashed, and the factors for that."""
    power, inverse = powers_for(len(codes) + 1)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * power[: len(codes)], dtype=np.uint64))), inverse


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if width > have else values


def _runs(codes: np.ndarray, offsets: np.ndarray, length: int, anchor: int, once: bool):
    """(text, start, windows, key, hash) of the runs of texts that follow one another in codes. once: equal windows of a text take part once."""
    if len(codes) < length:
        return None
    prefix, inverse = _prefix(codes)
    grams = mix((prefix[anchor:] - prefix[:-anchor]) * inverse[: len(codes) - anchor + 1])
    packed = ((grams >> np.uint64(_PLACE_BITS)) << np.uint64(_PLACE_BITS)) | np.arange(len(grams), dtype=np.uint64)
    place = (_least(packed, length - anchor + 1) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
    p = np.flatnonzero(np.arange(len(place)) + length <= offsets[1:][of])
    if once and len(p):
        own = mix((prefix[p + length] - prefix[p]) * inverse[p])
        order = np.lexsort((p, own, of[p]))
        again = np.concatenate(([False], (np.diff(own[order]) == 0) & (np.diff(of[p][order]) == 0)))
        p = np.sort(p[order[~again]])
    if not len(p):
        return None
    place, of = place[p], of[p]
    cut = np.concatenate(([0], np.flatnonzero((np.diff(place) != 0) | (np.diff(of) != 0) | (np.diff(p) != 1)) + 1, [len(p)]))
    first, n = cut[:-1], np.diff(cut)
    start = p[first]
    end = start + n - 1 + length
    whole = mix((prefix[end] - prefix[start]) * inverse[start] + n.astype(np.uint64))
    return of[first], start - offsets[of[first]], n, grams[place[first]].astype(np.int64), whole.astype(np.int64)


def runs(texts: pa.Array, length: int, anchor: int, words: bool = False):
    """(text, start, windows, key, hash) arrays of the runs of each slice of texts, over their bytes or their words."""
    for lo, hi in slices(texts):
        own = texts.slice(lo, hi - lo)
        if words:
            codes, offsets = word_hashes(own)
        else:
            offsets, data = flat_bytes(own)
            codes, offsets = byte_codes()[data[offsets[0] : offsets[-1]]], offsets - offsets[0]
        found = _runs(codes, offsets, length, anchor, words)
        if found is not None:
            yield lo + found[0], *found[1:]


def _windows(codes: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each window of a text's codes."""
    prefix, inverse = _prefix(codes)
    n = max(0, len(codes) - length + 1)
    return mix((prefix[length:] - prefix[:n]) * inverse[:n])


def _spans(flags: np.ndarray) -> bytes:
    edge = np.diff(flags.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.stack((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)), axis=1).astype(np.int32).tobytes()


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 400,
    anchor: int = 144,
    passage: int = 50,
    passage_anchor: int = 12,
    hot: int = 256,
    bucket_windows: int = 60_000,
    batch_windows: int = 4_000,
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, n_passage_words) for each row of docs.

    kept: the bytes that stay. n_passage_words: words within stretches of ``passage`` words that occur in another document too.
    hot: different runs of one anchor from which its windows are counted by hash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    # One number for a row; rows that share it are equal, and what holds for one holds for the other.
    rows = rows.select("id", "text", F.xxhash64("id", "text").alias("h"))
    # By unit, in bytes: the length of a window and of an anchor in units. 1: a byte of the text; 8: the hash of a word.
    units = {1: (length, anchor), 8: (passage, passage_anchor)}

    def cut(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.string())
            for unit, (width, own) in units.items():
                for of, start, n, key, whole in runs(texts, width, own, unit == 8):
                    at = pa.array(of)
                    if unit == 8:
                        key = key ^ np.int64(0x5DEECE66D)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(2).take(at), pa.array(np.full(len(of), unit, np.int8)), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(key), pa.array(whole)],
                        names=["h", "unit", "start", "n", "key", "whole"],
                    )

    every = materialize(rows.mapInArrow(cut, "h long, unit byte, start int, n int, key long, whole long"))
    kinds = every.groupBy("key", "whole").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("h", "unit", "start", "n")).alias("r"))
    kinds = materialize(kinds.select("key", "whole", "copies", "r.*"))
    per_key = kinds.groupBy(F.col("key").alias("k")).agg(F.sum("copies").alias("times"), F.count(F.lit(1)).alias("different")).where("times > 1")
    kinds, old = materialize(kinds.join(per_key, F.col("key") == F.col("k")).drop("k", "times")), kinds
    discard(old)
    wanted = kinds.where("different > 1").withColumn("hot", F.col("different") > hot)
    plain, dealt = wanted.agg(F.sum(F.when(~F.col("hot"), F.col("n"))), F.sum(F.when(F.col("hot"), F.col("n")))).first()
    buckets, hash_buckets = int(max(8, (plain or 0) // bucket_windows)), int(max(8, (dealt or 0) // (8 * bucket_windows)))
    by_row = wanted.groupBy(F.col("h").alias("r")).agg(F.collect_list(F.struct("unit", "start", "n", "key", "whole", "hot")).alias("cuts"))
    taken = rows.join(by_row, F.col("h") == F.col("r")).select("text", "cuts")

    def take(batches):
        serial = TaskContext.get().partitionId() << 32
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("kind", "unit", "bucket", "block", "key", "whole", "data")}

            def put(*row):
                for c, v in zip(out, row):
                    out[c].append(v)

            keys, wholes, counts, hashes = [], [], [], []
            seen: set[tuple[int, int]] = set()
            texts = batch.column(0).cast(pa.string())
            for i, cuts in enumerate(batch.column(1).to_pylist()):
                codes, prints = {}, {}
                for c in cuts:
                    name, unit = (c["key"], c["whole"]), c["unit"]
                    if name in seen:
                        continue
                    seen.add(name)
                    if unit not in codes:
                        raw = texts[i].as_py().encode() if unit == 1 else None
                        codes[unit] = np.frombuffer(raw, dtype=np.uint8) if unit == 1 else word_hashes(texts.slice(i, 1))[0]
                    width = units[unit][0]
                    if c["hot"]:
                        if unit not in prints:
                            prints[unit] = _windows(byte_codes()[codes[1]] if unit == 1 else codes[8], width) ^ np.uint64(unit)
                        keys.append(c["key"])
                        wholes.append(c["whole"])
                        counts.append(c["n"])
                        hashes.append(prints[unit][c["start"] : c["start"] + c["n"]])
                    else:
                        put(0, unit, c["key"] % buckets, 0, c["key"], c["whole"], codes[unit][c["start"] : c["start"] + c["n"] - 1 + width].tobytes())
            if keys:
                n = np.array(counts, dtype=np.int32)
                flat = np.concatenate(hashes)
                put(2, 0, 0, serial, None, None, _pack([np.array(keys, dtype=np.int64), np.array(wholes, dtype=np.int64), n]))
                bucket = (flat % np.uint64(hash_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable").astype(np.int32)
                there, first = np.unique(bucket[order], return_index=True)
                for b, lo, hi in zip(there.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
                    put(1, 0, b, serial, None, None, _pack([flat[order[lo:hi]], order[lo:hi]]))
                serial += 1
            types = {"kind": pa.int32(), "unit": pa.int32(), "bucket": pa.int64(), "block": pa.int64(), "key": pa.int64(), "whole": pa.int64(), "data": pa.binary()}
            yield pa.RecordBatch.from_pydict({c: pa.array(v, types[c]) for c, v in out.items()})

    parts = materialize(taken.mapInArrow(take, "kind int, unit int, bucket long, block long, key long, whole long, data binary"))

    def search(table: pa.Table) -> pa.Table:
        """The bucket's index families, fed batch by batch."""
        names, by_unit = set(), {u: [] for u in units}
        for i, (unit, *name) in enumerate(zip(table["unit"].to_pylist(), table["key"].to_pylist(), table["whole"].to_pylist())):
            if tuple(name) not in names:
                names.add(tuple(name))
                by_unit[unit].append(i)
        spans, order = [], []
        for unit, own in by_unit.items():
            texts, family, batch, many = table["data"].take(pa.array(own, pa.int64())).to_pylist(), IndexFamily(units[unit][0] * unit, unit), [], 0
            for t in texts:
                batch.append(t)
                many += len(t) // unit - units[unit][0] + 1
                if many >= batch_windows:
                    family.add(batch)
                    batch, many = [], 0
            family.add(batch)
            spans += [_spans(f) for f in family.repeated()]
            order += own
        table = table.take(pa.array(order, pa.int64()))
        return pa.table({"key": table["key"], "whole": table["whole"], "spans": pa.array(spans, pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        raws = [np.frombuffer(_unpack(b), dtype=np.uint8) for b in table["data"].to_pylist()]
        sizes = [len(r) // 12 for r in raws]
        hashes = np.concatenate([r[: 8 * n].view(np.uint64) for r, n in zip(raws, sizes)])
        _, back, times = np.unique(hashes, return_inverse=True, return_counts=True)
        hit = times[back] > 1
        out, at = [], 0
        for r, n in zip(raws, sizes):
            out.append(_pack([r[8 * n :].view(np.int32)[hit[at : at + n]]]))
            at += n
        return pa.table({"block": table["block"], "data": pa.array(out, pa.binary())})

    def unite(own: pa.Table, hits: pa.Table) -> pa.Table:
        out = {"key": [], "whole": [], "spans": []}
        for blob in own["data"].to_pylist():
            raw = np.frombuffer(_unpack(blob), dtype=np.uint8)
            m = len(raw) // 20
            keys, wholes, n = raw[: 8 * m].view(np.int64), raw[8 * m : 16 * m].view(np.int64), raw[16 * m :].view(np.int32)
            flags = np.zeros(int(n.sum()), dtype=bool)
            for b in hits["data"].to_pylist():
                flags[np.frombuffer(_unpack(b), dtype=np.int32)] = True
            out["key"] += keys.tolist()
            out["whole"] += wholes.tolist()
            out["spans"] += [_spans(f) for f in np.split(flags, np.cumsum(n)[:-1])]
        return pa.table({"key": pa.array(out["key"], pa.int64()), "whole": pa.array(out["whole"], pa.int64()), "spans": pa.array(out["spans"], pa.binary())})

    found = "key long, whole long, spans binary"
    by_index = parts.where("kind = 0").groupBy("bucket").applyInArrow(search, found)
    counted = parts.where("kind = 1").select("bucket", "block", "data").groupBy("bucket").applyInArrow(count, "block long, data binary")
    blocks = parts.where("kind = 2").select("block", "data")
    by_hash = blocks.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(unite, found)
    spans = by_index.unionByName(by_hash).groupBy(F.col("key").alias("sk"), F.col("whole").alias("sw")).agg(F.first("spans").alias("spans"))

    # A run that occurs several times is repeated as a whole, whatever else shares its anchor.
    known = kinds.join(spans, (F.col("key") == F.col("sk")) & (F.col("whole") == F.col("sw")), "left").where("copies > 1 or length(spans) > 0")
    known = materialize(known.select(F.col("key").alias("kk"), F.col("whole").alias("kw"), F.when(F.col("copies") == 1, F.col("spans")).alias("spans")))
    marks = every.join(known, (F.col("key") == F.col("kk")) & (F.col("whole") == F.col("kw"))).select(F.col("h").alias("m"), "unit", "start", "n", "spans")
    marks = marks.groupBy("m").agg(F.collect_list(F.struct("unit", "start", "n", "spans")).alias("marks"))
    marked = rows.join(marks, F.col("h") == F.col("m"), "left").select("id", "text", "marks")

    def covered(size: int, marks, width: int) -> np.ndarray:
        """Which of ``size`` places lie in a window that is marked."""
        gone = np.zeros(size + 1, dtype=np.int32)
        for m in marks:
            parts = [(0, m["n"])] if m["spans"] is None else np.frombuffer(m["spans"], dtype=np.int32).reshape(-1, 2).tolist()
            for lo, hi in parts:
                gone[m["start"] + lo] += 1
                gone[m["start"] + hi - 1 + width] -= 1
        return np.cumsum(gone[:-1]) > 0

    def strip(batches):
        for batch in batches:
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": [], "n_passage_words": []}
            texts = batch.column(1).cast(pa.string())
            for i, marks in enumerate(batch.column(2).to_pylist()):
                raw, marks = texts[i].as_py().encode(), marks or ()
                cover = covered(len(raw), [m for m in marks if m["unit"] == 1], length)
                quoted = [m for m in marks if m["unit"] == 8]
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(int(cover.sum()))
                out["n_spans"].append(int((np.diff(cover.view(np.int8), prepend=np.int8(0)) == 1).sum()))
                out["kept"].append(np.frombuffer(raw, dtype=np.uint8)[~cover].tobytes() if marks else raw)
                last = max((m["start"] + m["n"] - 1 + passage for m in quoted), default=0)
                out["n_passage_words"].append(int(covered(last, quoted, passage).sum()))
            long = pa.int64()
            types = {"n_bytes": long, "n_removed": long, "n_spans": long, "kept": pa.binary(), "n_passage_words": long}
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, types[c]) for c, v in out.items()]], names=["id", *out])

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept binary, n_passage_words long"
    return marked.mapInArrow(strip, schema).withColumnRenamed("id", id_col)
