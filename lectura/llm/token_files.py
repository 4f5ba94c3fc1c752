"""Token ids in files of wavelet matrices.

Each row of the file table is a shard: consecutive documents in ascending doc_id order, their ids as one wavelet matrix.
A shard's blob is the magic, the number of ids, the number of bit planes, per plane the number of zero bits, the bits packed
eight to a byte (most significant first) and the ones before each block of 512 bits. Access, counting (rank) and occurrence
lookup (select) need no other file.

A null text is empty, so the document is the end id alone; documents of the same doc_id (or without one) stay in some order,
none is lost; an empty table gives no shard; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .subwords import batches, encoder
from .tables import shared_dir

TOKENIZER, END, MAGIC, BLOCK = "word_bpe_49k.json", 1, b"WMX1", 512


class WaveletMatrix:
    """Bit planes from the most significant bit down; each plane is stably parted by its bits before the next."""

    def __init__(self, n: int, planes: list[tuple[int, np.ndarray, np.ndarray]]):
        self.n, self.planes = n, planes

    @classmethod
    def build(cls, ids: np.ndarray) -> "WaveletMatrix":
        n, planes = len(ids), []
        width = max(1, int(ids.max()).bit_length()) if n else 1
        left = ids.astype(np.uint16 if width <= 16 else np.uint32)
        for k in range(width - 1, -1, -1):
            bits = (left >> left.dtype.type(k) & left.dtype.type(1)).astype(bool)
            packed = np.packbits(bits)
            padded = np.zeros(-(-len(packed) * 8 // BLOCK) * (BLOCK // 8), np.uint8)
            padded[: len(packed)] = packed
            ones = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
            planes.append((n - int(bits.sum()), packed, np.concatenate([[0], np.cumsum(ones)]).astype("<u4")))
            left = np.concatenate([left[~bits], left[bits]])
        return cls(n, planes)

    def dump(self) -> bytes:
        out = [MAGIC, struct.pack("<QB", self.n, len(self.planes))]
        for zeros, packed, ranks in self.planes:
            out += [struct.pack("<QII", zeros, len(packed), len(ranks)), packed.tobytes(), ranks.astype("<u4").tobytes()]
        return b"".join(out)

    @classmethod
    def load(cls, blob: bytes) -> "WaveletMatrix":
        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        (n, width), at, planes = struct.unpack_from("<QB", blob, 4), 13, []
        for _ in range(width):
            zeros, bits, ranks = struct.unpack_from("<QII", blob, at)
            at += 16
            planes.append((zeros, np.frombuffer(blob, np.uint8, bits, at), np.frombuffer(blob, "<u4", ranks, at + bits)))
            at += bits + 4 * ranks
        return cls(n, planes)

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        _, packed, ranks = self.planes[plane]
        block = i // BLOCK
        part = packed[block * BLOCK // 8 : i // 8 + 1].copy()
        if i // 8 < len(packed):
            part[-1] &= 0xFF00 >> (i % 8) & 0xFF
        return int(ranks[block]) + int(np.bitwise_count(part).sum())

    def access(self, i: int) -> int:
        value = 0
        for k, (zeros, packed, _) in enumerate(self.planes):
            bit = int(packed[i // 8]) >> (7 - i % 8) & 1
            ones = self._ones(k, i)
            i = zeros + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def rank(self, value: int, i: int) -> int:
        """How often value stands among the first i ids."""
        if value >> len(self.planes):
            return 0
        low = 0
        for k, (zeros, _, _) in enumerate(self.planes):
            a, b = self._ones(k, low), self._ones(k, i)
            low, i = (zeros + a, zeros + b) if value >> (len(self.planes) - 1 - k) & 1 else (low - a, i - b)
        return i - low

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, j: int) -> int:
        """Where the (j+1)-th occurrence of value stands."""
        if not 0 <= j < self.count(value):
            raise IndexError(j)
        low, high = 0, self.n
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (low, middle) if self.rank(value, middle) > j else (middle, high)
        return low

    def ids(self) -> np.ndarray:
        """All ids, plane by plane from the last: each plane's bits say how its two halves were dealt."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for shift, (zeros, packed, _) in enumerate(reversed(self.planes)):
            bits = np.unpackbits(packed, count=self.n).view(bool)
            back = np.empty_like(values)
            back[~bits] = values[:zeros]
            back[bits] = values[zeros:] | kind(1 << shift)
            values = back
        return values


#: Bytes of text of a part, about, which is a task's work.
PART_BYTES = 128 << 20
#: So many shards' starts, of 20 bytes or so, are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
FILE = "first_id long, part int, shard int, doc_ids array<long>, lengths array<int>, n_ids long, matrix binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end: int = END, shard_ids: int = 1 << 21) -> None:
    """Range-partitions the documents by doc_id, encodes them in order and writes a row per shard of about shard_ids ids."""

    def encode(parts):
        from pyspark import TaskContext

        e, part_no = encoder(tokenizer, "dropped"), TaskContext.get().partitionId()
        keys, flat, lens, shard = [], [], [], 0

        def row(n):
            ids = np.concatenate(flat[:n])
            out = pa.RecordBatch.from_arrays(
                [pa.array([keys[0]], pa.int64()), pa.array([part_no], pa.int32()), pa.array([shard], pa.int32()), pa.array([keys[:n]], pa.list_(pa.int64())), pa.array([lens[:n]], pa.list_(pa.int32())), pa.array([len(ids)], pa.int64()), pa.array([WaveletMatrix.build(ids).dump()], pa.binary())],
                ["first_id", "part", "shard", "doc_ids", "lengths", "n_ids", "matrix"],
            )
            del keys[:n], flat[:n], lens[:n]
            return out

        for part in parts:
            own, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for s in batches(texts):
                for key, ids in zip(own[s], e.encode(texts[s])):
                    keys.append(key)
                    flat.append(np.append(np.frombuffer(ids, "<u4"), np.uint32(end)))
                    lens.append(len(flat[-1]))
                if sum(lens) >= shard_ids:
                    yield row(len(keys))
                    shard += 1
        if keys:
            yield row(len(keys))

    # a doc_id of many rows (or none) spreads over ranges by the rows' numbers
    numbered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    ordered = numbered.repartitionByRange(n, "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    ordered.mapInArrow(encode, FILE).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """A row per document from the files: its ids (little-endian uint32) and start, the ids of all documents before it.

    Only the parts' sizes are ordered in one place, a row for gigabytes of text; shards are ordered within their part.
    """
    shards = spark.read.schema(FILE).parquet(path)
    sizes = shards.select("part", "shard", "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("ahead"))
    within = sizes.select("part", "shard", before(Window.partitionBy("part").orderBy("shard")).alias("inside"))
    starts = within.join(parts, "part").select("part", "shard", (F.col("ahead") + F.col("inside")).alias("before"))

    def decode(parts):
        for part in parts:
            for r in part.to_pylist():
                ids, at = WaveletMatrix.load(r["matrix"]).ids().astype("<u4"), 0
                starts, blobs = [], []
                for n in r["lengths"]:
                    starts.append(r["before"] + at)
                    blobs.append(ids[at : at + n].tobytes())
                    at += n
                crc = [zlib.crc32(b) for b in blobs]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(r["lengths"], pa.int64()), pa.array(crc, pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    if shards.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    return shards.select("part", "shard", "doc_ids", "lengths", "matrix").join(starts, ["part", "shard"]).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def token_files(docs: DataFrame, path: str | None = None, tokenizer: str = TOKENIZER, end: int = END, shard_ids: int = 1 << 21) -> DataFrame:
    """Writes the files below path (of the shared folder, where none is given) and reads every document back from them."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer, end, shard_ids)
    return read_token_files(spark, path)
