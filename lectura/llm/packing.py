"""Packing of documents into sequences of a fixed length: cutting stock by column generation.

Documents are token ids with an end id; a document longer than a sequence is cut into whole sequences and a rest, and a rest of
over half a sequence is cut there, since pieces of up to a half leave little room unused. Pieces are dealt to groups of a bounded
size. A group's rests are binned by length, rounded up to a multiple of `grain`. A linear program over patterns (multisets of bins
that fit a sequence) is solved by column generation, each new pattern priced by a knapsack dynamic program; patterns are used the
rounded-down number of times, and what rounding leaves is packed best-fit. A piece's rank in its bin, by doc_id and start, says
which sequence and slot it takes.

A null text is empty, so the document is the end id alone; repeated rows are packed one by one; an empty table packs into
nothing; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import shards
from .subwords import encoder, lean, release

TOKENIZER, END = "byte_bpe_50k.json", 1
#: Bytes of text that are encoded together, and units that a worker keeps: the executor's heap needs the rest.
ENCODE_BYTES, CACHE = 3 << 20, 400_000
#: Bytes of text whose pieces are packed together, about.
GROUP_BYTES = 24 << 20
PIECES = "part long, doc_id long, start long, doc_tokens long, ids binary"
SEQUENCES = "sequence_id long, pieces array<struct<offset:long,doc_id:long,start:long,length:long,doc_tokens:long>>, ids binary"


def narrow(tokenizer: str, end: int) -> str:
    """The type that ids travel in: two bytes where every id fits them."""
    return "<u2" if max(encoder(tokenizer, "space").tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else "<u4"


def pieces(docs: DataFrame, groups: int, length: int, tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """Every document's pieces, dealt to groups: whole sequences first, then the rest, in halves. One scan, no shuffle.

    The deal hashes the piece, its task and how often the task has met its like: equal pieces spread, and a task that is run
    again deals alike in whatever order its rows come.
    """

    kind = narrow(tokenizer, end)

    def cut(parts):
        from pyspark import TaskContext

        e, task, met = encoder(tokenizer, "space", CACHE), TaskContext.get().partitionId(), {}
        for part in parts:
            for s in shards(part.column(1), ENCODE_BYTES):
                rows = []
                for key, ids in zip(part.column(0)[s].to_pylist(), e.encode(part.column(1)[s].to_pylist())):
                    ids = np.append(np.frombuffer(ids, "<u4"), end).astype(kind)
                    edges = [*range(0, len(ids), length), len(ids)]
                    if edges[-1] - edges[-2] > length // 2:
                        edges.insert(-1, edges[-2] + length // 2)
                    for at, stop in zip(edges, edges[1:]):
                        own = ids[at:stop].tobytes()
                        like = hash((key or 0, at, zlib.crc32(own)))
                        met[like] = again = met.get(like, 0) + 1
                        deal = zlib.crc32(struct.pack("<qqq", like, again, task))
                        rows.append((deal * groups >> 32, key, at, len(ids), own))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["part", "doc_id", "start", "doc_tokens", "ids"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lean(cut, tokenizers=True), PIECES)


def best_pattern(price: np.ndarray, weight: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the multiset of bins of the highest price that fits. Dynamic program over capacities."""
    value, last = [0.0] * (capacity + 1), [-1] * (capacity + 1)
    # a bin that another of at most its weight beats in price is in no best pattern
    better = np.maximum.accumulate(np.concatenate([[0.0], price[:-1]]))
    items = [(int(w), float(p), k) for k, (w, p) in enumerate(zip(weight, price)) if p > better[k]]
    for w, p, k in items:
        for c in range(w, capacity + 1):
            if (v := value[c - w] + p) > value[c] + 1e-12:
                value[c], last[c] = v, k
    pattern, c = np.zeros(len(weight), np.int64), capacity
    while c > 0:
        k = last[c]
        if k < 0:
            c -= 1
        else:
            pattern[k] += 1
            c -= int(weight[k])
    return float(price @ pattern), pattern


def cutting_stock(weight: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3) -> list[tuple[np.ndarray, int]]:
    """Patterns with how often each is used, covering every demand exactly.

    The restricted master is min sum x, A x = demand, x >= 0, solved by the revised simplex method: its basis has a column
    per bin, the duals price the knapsack, the best pattern enters and the ratio test says which leaves. It ends when the best
    pattern is worth at most 1 + gap, which bounds the program's value to within that share of the optimum. Rounding errors in the
    inverse can only cost padding: patterns are whole numbers and every demand is met from what is left.
    """
    m = len(weight)
    if not m:
        return []
    basis = np.diag(np.maximum(1, capacity // weight)).astype(float)  # a bin alone, as often as it fits
    x = demand / np.diag(basis)
    inverse = np.diag(1 / np.diag(basis))
    while True:
        value, pattern = best_pattern(inverse.sum(axis=0), weight, capacity)
        if value <= 1 + gap:
            break
        d = inverse @ pattern
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(0, x - step * d)
        x[out] = step
        basis[:, out] = pattern
        row = inverse[out] / d[out]
        inverse -= np.outer(d, row)
        inverse[out] = row
    used, left = [], demand.astype(np.int64).copy()
    for j in np.argsort(-x):
        pattern = np.rint(basis[:, j]).astype(np.int64)
        has = pattern > 0
        n = min(int(x[j] + 1e-9), int((left[has] // pattern[has]).min())) if has.any() else 0
        if n > 0:
            used.append((pattern, n))
            left -= n * pattern
    for pattern, n in best_fit(weight, left, capacity):
        used.append((pattern, n))
    return used


def best_fit(weight: np.ndarray, left: np.ndarray, capacity: int):
    """What rounding leaves: patterns filled from the largest bin down, each used as often as the leftovers allow."""
    left = left.copy()
    while left.any():
        pattern, room = np.zeros(len(weight), np.int64), capacity
        for k in range(len(weight) - 1, -1, -1):
            n = min(int(left[k]), int(room // weight[k]))
            pattern[k], room = n, room - n * weight[k]
        has = pattern > 0
        n = int((left[has] // pattern[has]).min())
        yield pattern, n
        left -= n * pattern


def places(lengths: np.ndarray, rank: np.ndarray, length: int, grain: int) -> tuple[np.ndarray, np.ndarray]:
    """For pieces of a group, ranked: the number of the sequence of each, and its place there."""
    sequence, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    whole = np.flatnonzero(lengths == length)
    sequence[whole] = np.arange(len(whole))
    bins = -(-lengths // grain)
    weight, demand = np.unique(bins[lengths < length], return_counts=True)
    ranked = {b: own[np.argsort(rank[own])] for b in weight.tolist() for own in [np.flatnonzero((bins == b) & (lengths < length))]}
    taken, at = Counter(), len(whole)
    for pattern, n in cutting_stock(weight, demand, length // grain):
        before = 0
        for k in np.flatnonzero(pattern)[::-1].tolist():
            b, per = int(weight[k]), int(pattern[k])
            own = ranked[b][taken[b] : taken[b] + per * n]
            sequence[own], place[own] = at + np.arange(per * n) // per, before + np.arange(per * n) % per
            taken[b] += per * n
            before += per
        at += n
    return sequence, place


def packed_sequences(docs: DataFrame, length: int = 2048, tokenizer: str = TOKENIZER, end: int = END, grain: int = 16, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """A row per sequence: sequence_id, its pieces (offset, doc_id, start, length, doc_tokens) and its ids as little-endian uint32.

    The pieces are shuffled once, to groups of a bounded size, as many as the texts need; each group has its own histogram and
    linear program. A sequence_id is the group's number times 2^32 plus the sequence's. Nothing but the texts' size reaches the driver.
    """
    size, n = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    cut = pieces(docs, max(1, -(-(size + n) // group_bytes)), length, tokenizer, end)

    kind = narrow(tokenizer, end)

    def pack_group(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        release()
        group = group.combine_chunks()
        start, tokens, ids = group.column("start").to_numpy(), group.column("doc_tokens"), group.column("ids").chunk(0)
        lengths = np.diff(np.frombuffer(ids.buffers()[1], "<i4", len(ids) + 1, 4 * ids.offset)).astype(np.int64) // int(kind[-1])
        known = group.column("doc_id").is_valid().to_numpy()
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((start, group.column("doc_id").fill_null(0).to_numpy(), known))] = np.arange(len(ids))
        sequence, place = places(lengths, rank, length, grain)
        order = np.lexsort((place, sequence))
        stops = np.cumsum(lengths[order])
        first = np.flatnonzero(np.diff(sequence[order], prepend=-1))
        edges = np.append(first, len(order))
        heads = (stops - lengths[order])[first]
        offset = stops - lengths[order] - np.repeat(heads, np.diff(edges))
        taken = ids.take(pa.array(order))
        flat = np.frombuffer(taken.buffers()[2], kind, stops[-1]).astype("<u4")
        told = pa.StructArray.from_arrays([pa.array(offset), group.column("doc_id").chunk(0).take(pa.array(order)), pa.array(start[order]), pa.array(lengths[order]), tokens.chunk(0).take(pa.array(order))], ["offset", "doc_id", "start", "length", "doc_tokens"])
        spots = pa.py_buffer((4 * np.append(heads, stops[-1])).astype("<i4").tobytes())
        return pa.table(
            {
                "sequence_id": pa.array((key[0].as_py() << 32) + sequence[order][first]),
                "pieces": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), told),
                "ids": pa.Array.from_buffers(pa.binary(), len(first), [None, spots, pa.py_buffer(flat)]),
            }
        )

    return cut.groupBy("part").applyInArrow(pack_group, SEQUENCES)


def pack(docs: DataFrame, length: int = 2048, tokenizer: str = TOKENIZER, end: int = END, grain: int = 16, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """A row per piece with its sequence_id, its offset and its ids, all three read from the packed sequences."""
    own = lambda p: F.substring(F.col("ids"), (4 * p["offset"] + 1).cast("int"), (4 * p["length"]).cast("int"))
    rows = packed_sequences(docs, length, tokenizer, end, grain, group_bytes).select(
        "sequence_id", F.inline(F.transform("pieces", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["doc_tokens"].alias("doc_tokens"), p["offset"].alias("offset"), own(p).alias("ids"))))
    )
    n = F.floor(F.octet_length("ids") / 4).cast("long")
    return rows.select("doc_id", "start", n.alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "ids", "sequence_id", "offset")
