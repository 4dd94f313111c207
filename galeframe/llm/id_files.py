"""Token-id files: all documents' ids as one concatenated array, with Elias-Fano coded document boundaries.

write_ids() encodes documents with a byte-level BPE file of the tokenizers library, appends the end id and writes the
ids of ascending documents one after the other. The array is cut into segments of whole documents (about SEGMENT ids; a
longer document is a segment of its own) that Spark's writer stores as rows, so that a lost task is written again and any
store will do. A segment holds

* ids: little-endian unsigned numbers of `width` bytes, the least that hold every id of the vocabulary,
* ends: the Boundaries of its documents, an Elias-Fano code of about 2 + log2(ids / documents) bits a document,
* names: the document ids in ascending order, an Elias-Fano code as well (those without an id come first, as a count),
* shard and begin: its place; a second small table gives the first id of every shard.

Boundaries.select(i) finds the i-th value from samples of the upper bits; no table of 64-bit offsets is kept anywhere.
read_ids() gives documents back, offsets() their places.

A null or empty text holds the end id alone. Repeated ids are documents of their own, in the order of their texts' hashes; no row
is dropped. Special strings inside texts are tokens, as the library has it. Empty tables give files without rows.
Extra columns are left out.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from galeframe.llm.text import flat, slices, spans_hash
from galeframe.llm.token_counts import ENDS_PART, SPACE

SEGMENT = 1 << 18       # ids of a segment that is not one long document
SAMPLE = 64             # values between two samples of the upper bits
KEPT_IDS = 4 << 20      # ids of known parts a worker keeps
SHARD_ROWS = "shard long, segment long, begin long, documents long, nameless long, width int, ids binary, ends binary, names binary"


class Boundaries:
    """Elias-Fano code of a non-decreasing list of unsigned numbers.

    The lower bits of each number are packed one after the other; the upper parts are a bit string in which
    number i is the one bit at place (upper part + i). Every SAMPLE-th one bit's place is kept, so that select reads only
    the bytes between two samples.
    """

    HEAD = np.dtype([("count", "<u8"), ("low", "<u8"), ("high_bytes", "<u8")])

    def __init__(self, code: bytes):
        self.code = code
        head = np.frombuffer(code, self.HEAD, 1)[0]
        self.count, self.low = int(head["count"]), int(head["low"])
        at = self.HEAD.itemsize
        self.high = np.frombuffer(code, np.uint8, int(head["high_bytes"]), at)
        at += len(self.high)
        self.samples = np.frombuffer(code, "<u4", -(-self.count // SAMPLE), at)
        self.lows = np.frombuffer(code, np.uint8, (self.count * self.low + 7) // 8, at + self.samples.nbytes)

    @classmethod
    def of(cls, values: np.ndarray) -> Boundaries:
        values = np.asarray(values, np.uint64)
        n = len(values)
        last = int(values[-1]) if n else 0
        low = max(0, (last // n).bit_length() - 1) if n else 0
        places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(places[-1]) >> 3) + 1 if n else 0, np.uint8)
        np.bitwise_or.at(high, places >> 3, (1 << (places & 7)).astype(np.uint8))
        bits = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        head = np.zeros(1, cls.HEAD)
        head["count"], head["low"], head["high_bytes"] = n, low, len(high)
        return cls(head.tobytes() + high.tobytes() + places[::SAMPLE].astype("<u4").tobytes()
                   + np.packbits(bits.ravel(), bitorder="little").tobytes())

    def _lower(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        bit = i[:, None] * self.low + np.arange(self.low)
        found = (self.lows[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
        return (found.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The i-th number, from the sample before it on."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        start = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, start >> 3
        word = int(self.high[byte]) >> (start & 7) << (start & 7)
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1  # the lowest one bit goes
        place = (byte << 3) + (word & -word).bit_length() - 1
        return (place - i) << self.low | int(self._lower(np.array([i]))[0])

    def all(self) -> np.ndarray:
        """All numbers."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        upper = (places - np.arange(self.count)).astype(np.uint64)
        return upper << np.uint64(self.low) | self._lower(np.arange(self.count))


class Encoder:
    """Ids of whole texts as the library gives them. Texts are cut where a run of white space begins, which no pre-token
    crosses; distinct parts, known by their 64-bit hashes, are encoded once, and a bounded number of ids is kept for the
    next slices. A text that holds an added token is encoded whole."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec.get("normalizer") or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only byte-level pre-tokens without normaliser are known")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t["content"].encode() for t in spec.get("added_tokens", [])]
        # every letter of a byte-level token stands for one byte
        self.bytes = np.zeros(self.library.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in spec["model"]["vocab"].items():
            self.bytes[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)                                        # of known parts, ascending
        self.first, self.many = np.zeros(0, np.int64), np.zeros(0, np.int64)        # where their ids stand in the pool
        self.pool = np.zeros(0, np.int32)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, alone: np.ndarray) -> None:
        """Encodes new parts. Those that begin with white space and end without it are put together to one text, in which the
        cuts between them are again such that no pre-token crosses; the lengths of the tokens in bytes tell them apart."""
        together = ~alone & SPACE[data[starts]] & ENDS_PART[data[ends - 1]]
        order = np.concatenate([np.flatnonzero(together), np.flatnonzero(~together)])
        size = (ends - starts)[together]
        upto = np.cumsum(size)
        text = data[np.repeat(starts[together] - (upto - size), size) + np.arange(int(size.sum()))].tobytes().decode()
        ids = np.array(self.library.encode(text, add_special_tokens=False).ids if text else [], np.int32)
        reach = np.cumsum(self.bytes[ids])
        many = np.diff(np.concatenate([[0], np.searchsorted(reach, upto, "right")]))
        if len(ids) and (reach[-1] != upto[-1] or not np.isin(upto, reach).all()):
            raise ValueError("a token crosses a run of white space")
        raw = data.tobytes()
        others = [raw[a:b].decode() for a, b in zip(starts[~together].tolist(), ends[~together].tolist(), strict=True)]
        rest = [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(others, add_special_tokens=False)]
        many = np.concatenate([many, [len(r) for r in rest]]).astype(np.int64)
        first = len(self.pool) + np.cumsum(many) - many
        self.pool = np.concatenate([self.pool, ids, *rest])
        ascending = np.argsort(hashes[order])
        new = order[ascending]
        place = np.searchsorted(self.hashes, hashes[new])
        self.hashes = np.insert(self.hashes, place, hashes[new])
        self.first = np.insert(self.first, place, first[ascending])
        self.many = np.insert(self.many, place, many[ascending])

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        return at, self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each text has."""
        data, off = flat(texts)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        whole = np.zeros(len(texts), bool)
        raw = data.tobytes()
        for word in self.added:
            at = raw.find(word)
            while at >= 0:
                k = int(np.searchsorted(off, at, "right")) - 1
                whole[k] = True
                at = raw.find(word, max(at + 1, int(off[k + 1]) - len(word) + 1))
        cut = np.zeros(len(data), bool)
        cut[1:] = SPACE[data[1:]] & ENDS_PART[data[:-1]]
        for k in np.flatnonzero(whole).tolist():
            cut[off[k]:off[k + 1]] = False
        cut[off[:-1][np.diff(off) > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        hashes, where, which = np.unique(spans_hash(data, starts, ends), return_index=True, return_inverse=True)
        at, known = self._find(hashes)
        if not known.all():
            if len(self.pool) > KEPT_IDS:
                self._forget()
                known[:] = False
            new = where[~known]
            text = np.searchsorted(off, starts[new], "right") - 1
            self._learn(data, starts[new], ends[new], hashes[~known], whole[text])
            at, _ = self._find(hashes)
        begin, many = self.first[at][which], self.many[at][which]
        upto = np.concatenate([[0], np.cumsum(many)])
        ids = self.pool[np.repeat(begin - upto[:-1], many) + np.arange(int(upto[-1]))]
        return ids, np.diff(upto[np.searchsorted(starts, off)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _names(ids: pa.Array) -> tuple[int, bytes]:
    """How many ids are null, and the code of the others: their least one and what is above it."""
    nameless = ids.null_count
    values = ids.drop_null().to_numpy()
    least = values[:1].astype("<i8")
    return nameless, least.tobytes() + Boundaries.of((values - least).view(np.uint64)).code


def _named(nameless: int, code: bytes) -> pa.Array:
    none = pa.nulls(nameless, pa.int64())
    if len(code) < 8 + Boundaries.HEAD.itemsize:  # no document with an id
        return none
    values = np.frombuffer(code, "<i8", 1).view(np.uint64) + Boundaries(code[8:]).all()
    return pa.concat_arrays([none, pa.array(values.view(np.int64), pa.int64())])


def _pack(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Segments from ordered rows (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        width = 2 if max(encode.library.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4
        shard, segment, begin = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

        def told() -> pa.RecordBatch:
            nonlocal segment, begin, held
            ids = np.concatenate([h[0] for h in held])
            ends = np.cumsum(np.concatenate([h[1] for h in held]))
            nameless, names = _names(pa.concat_arrays([h[2] for h in held]))
            row = {"shard": shard, "segment": segment, "begin": begin, "documents": len(ends), "nameless": nameless, "width": width,
                   "ids": ids.astype(f"<u{width}").tobytes(), "ends": Boundaries.of(ends).code, "names": names}
            segment, begin, held = segment + 1, begin + len(ids), []
            kinds = {"width": pa.int32(), "ids": pa.binary(), "ends": pa.binary(), "names": pa.binary()}
            return pa.record_batch([pa.array([v], kinds.get(k, pa.int64())) for k, v in row.items()], names=list(row))

        for batch in batches:
            for part in slices(batch):
                plain, many = encode.encode(part.column("text"))
                upto = np.cumsum(many)
                ids = np.insert(plain, upto, end_id)
                many, upto = many + 1, upto + np.arange(1, len(many) + 1)
                at = 0
                while at < len(many):  # documents that still fit the open segment
                    room = SEGMENT - sum(len(h[0]) for h in held)
                    base = int(upto[at - 1]) if at else 0
                    end = int(np.searchsorted(upto, base + room, "right"))
                    if end <= at:
                        if held:
                            yield told()
                            continue
                        end = at + 1
                    held.append((ids[base:int(upto[end - 1])], many[at:end], part.column("doc_id").slice(at, end - at)))
                    at = end
        if held:
            yield told()

    return run


@dataclass
class IdFiles:
    """Written files: segments (see the module) and shards (shard, first)."""

    segments: DataFrame
    shards: DataFrame


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> IdFiles:
    """Writes the files of docs (doc_id, text) below path. Rows are ordered by doc_id, null first, then by the text's hash; equal
    rows are told apart by their number, so that an id held by very many rows is many tasks."""
    spark = docs.sparkSession
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select(
        "doc_id", "text", order[1].alias("hash"), order[2].alias("nth"))
    by = [order[0], "hash", "nth"]
    packed = keyed.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text").mapInArrow(
        _pack(tokenizer, end_id), SHARD_ROWS)
    packed.write.parquet(f"{path}/segments")
    segments = spark.read.schema(packed.schema).parquet(f"{path}/segments")
    # one number for each task that wrote a shard: no more than the driver keeps of a stage anyway
    sizes = segments.groupBy("shard").agg(F.max("begin").alias("begin"), F.max_by(
        F.octet_length("ids") / F.col("width"), "begin").cast("long").alias("last")).toPandas().sort_values("shard")
    total = (sizes["begin"] + sizes["last"]).to_numpy(np.int64)
    first = pa.table({"shard": pa.array(sizes["shard"].to_numpy(np.int64)), "first": pa.array(np.cumsum(total) - total, pa.int64())})
    spark.createDataFrame(first).coalesce(1).write.parquet(f"{path}/shards")
    return open_ids(spark, path)


def open_ids(spark, path: str) -> IdFiles:
    return IdFiles(spark.read.schema(SHARD_ROWS).parquet(f"{path}/segments"),
                   spark.read.schema("shard long, first long").parquet(f"{path}/shards"))


def _one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _documents(each: Callable[[memoryview, int], object], name: str, kind: pa.DataType):
    """Rows doc_id, shard, place (first id inside the shard), n_tokens and what each() makes of a document's ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _one_by_one(batch):
                ends = Boundaries(row["ends"]).all().astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                ids, width = memoryview(row["ids"]), row["width"]
                made = [each(ids[a * width:b * width], width) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch([
                    _named(row["nameless"], row["names"]), pa.array(np.full(len(ends), row["shard"])),
                    pa.array(starts + row["begin"]), pa.array(ends - starts), pa.array(made, kind)],
                    names=["doc_id", "shard", "place", "n_tokens", name])

    return run


def _read(files: IdFiles, each: Callable[[memoryview, int], object], name: str, kind: pa.DataType, sql: str) -> DataFrame:
    rows = files.segments.mapInArrow(_documents(each, name, kind), f"doc_id long, shard long, place long, n_tokens long, {name} {sql}")
    return rows.join(files.shards, "shard").select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", name)


def read_ids(files: IdFiles) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every document."""
    return _read(files, lambda raw, width: np.frombuffer(raw, f"<u{width}").astype(np.int64), "ids", pa.list_(pa.int64()), "array<long>")


def checksums(files: IdFiles) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, the unsigned CRC-32 of a document's ids as little-endian unsigned 32-bit numbers."""
    def crc(raw: memoryview, width: int) -> int:
        return zlib.crc32(np.frombuffer(raw, f"<u{width}").astype("<u4"))

    return _read(files, crc, "ids_crc32", pa.int64(), "long")


def tokens_at(files: IdFiles, wanted: DataFrame) -> DataFrame:
    """doc_id, nth and ids of the nth documents (from 0) of segments: rows shard, segment, nth; places are found by select."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _one_by_one(batch):
                ends = Boundaries(row["ends"])
                i, width, names = row["nth"], row["width"], row["names"]
                a, b = ends.select(i - 1) if i else 0, ends.select(i)
                above = i - row["nameless"]
                name = int.from_bytes(names[:8], "little", signed=True) + Boundaries(names[8:]).select(above) if above >= 0 else None
                yield pa.record_batch([pa.array([name], pa.int64()), pa.array([i], pa.int64()), pa.array(
                    [np.frombuffer(row["ids"], f"<u{width}", b - a, a * width).astype(np.int64)], pa.list_(pa.int64()))],
                    names=["doc_id", "nth", "ids"])

    return files.segments.join(wanted, ["shard", "segment"]).mapInArrow(run, "doc_id long, nth long, ids array<long>")
