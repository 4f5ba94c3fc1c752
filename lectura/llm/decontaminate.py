"""Benchmark decontamination with suffix arrays of the training documents.

Every task takes documents in shards and sorts the shard's word suffixes; the benchmark's suffixes are binary-searched in
that array. A search gives the range of training suffixes that share a window of words with a benchmark suffix; windows that
follow each other in a document and in an item are one longest verbatim match, with its place in both. Words that the benchmark
doesn't have end every match, so only suffixes made of benchmark words enter the array; that drops no match.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A benchmark item's windows are its runs of
`window` words; an item with fewer words is one window, an item without words has none. A null text has no words. Repeated
documents are judged alike; items that share an item_id count as one item; an item without item_id contaminates like others, but
has no id to list or count; empty tables give no matches (and an empty documents table no rows). Columns beside doc_id, text and
item_id are not read.

A benchmark of up to BENCHMARK_BYTES goes to every executor; a larger one is worked through in parts of that size, one after the
other, each with a scan of its own, so neither driver nor executors ever hold more than a part.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .subwords import lean
from .tables import byte_size, written

#: Lower case for A-Z, a space for whatever isn't part of a word; bytes of non-ASCII characters stay.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of text whose suffixes are sorted together; a worker takes some twenty times as much meanwhile.
SHARD_BYTES = 2 << 20
#: Bytes of a part of the benchmark.
BENCHMARK_BYTES = 32 << 20


def split_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and where each text's words start."""
    clean = pa.array([t.translate(WORD_BYTES).strip(b" ") for t in texts], pa.large_binary()).cast(pa.large_string())
    lists = pc.ascii_split_whitespace(clean)
    words, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
    empty = pc.equal(words, "").to_numpy(zero_copy_only=False)  # an empty text gives one empty word
    if empty.any():
        owner = np.repeat(np.arange(len(texts)), sizes)
        sizes, words = np.bincount(owner[~empty], minlength=len(texts)), words.filter(pa.array(~empty))
    return words, np.concatenate([[0], np.cumsum(sizes)])


class Benchmark:
    """Item words as numbers, and the distinct windows, sorted, with the items that hold them and where."""

    def __init__(self, items: list[tuple[int | None, str]], window: int):
        words, starts = split_words([(t or "").encode() for _, t in items])
        self.vocabulary = pc.unique(words)
        ids = pc.index_in(words, self.vocabulary).to_numpy(zero_copy_only=False).astype(np.int32)
        self.item_ids = [None if i is None else str(i) for i, _ in items]
        held: dict[bytes, list[tuple[int, int]]] = {}
        for item, (a, b) in enumerate(zip(starts, starts[1:])):
            own = ids[a:b].astype(">i4")
            n = min(window, len(own))
            for at in range(len(own) - n + 1 if n else 0):
                held.setdefault(own[at : at + n].tobytes(), []).append((item, at))
        #: by length in words: the windows in order as rows of numbers, and their items and places
        self.by_length = {}
        for n in sorted({len(w) // 4 for w in held}):
            keys = sorted(w for w in held if len(w) == 4 * n)
            self.by_length[n] = (keys, [held[w] for w in keys])


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their suffixes' first depth numbers, and the rank of each position; by prefix doubling.

    Numbers have to be 0 or more; behind the end stands a smaller one.
    """
    rank, n, done = ids.astype(np.int64) + 1, len(ids), 1
    order = np.argsort(rank, kind="stable")
    while done < depth:
        step = min(done, depth - done)
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:]
        key = rank * (int(rank.max(initial=0)) + 2) + ahead
        order = np.argsort(key, kind="stable")
        fresh = np.ones(n, bool)
        fresh[1:] = key[order][1:] != key[order][:-1]
        rank[order] = np.cumsum(fresh)
        done += step
    return order, rank


def search(ids: np.ndarray, order: np.ndarray, keys: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The range in the suffix array of each key of n numbers: one binary search, all keys at a time."""
    padded = np.concatenate([ids, np.full(n, -1, np.int32)])
    wanted = np.frombuffer(b"".join(keys), ">i4").reshape(-1, n).astype(np.int64)
    steps = np.arange(n)

    def bound(strict: bool) -> np.ndarray:
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order), np.int64)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            there = padded[order[np.minimum(middle, len(order) - 1)][:, None] + steps]
            unequal = there != wanted
            first = unequal.argmax(axis=1)
            rows = np.arange(len(wanted))
            less = np.where(unequal.any(axis=1), there[rows, first] < wanted[rows, first], strict)
            low = np.where(open_ & less, middle + 1, low)
            high = np.where(open_ & ~less, middle, high)
        return low

    return bound(False), bound(True)


def shard_matches(texts: list[bytes], bench: Benchmark):
    """For a shard of texts: word counts, and (text, item's number, item start, text start, words) of every longest match."""
    words, starts = split_words(texts)
    ids = pc.index_in(words, bench.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    # a run of benchmark words ends at an unknown word or at the text's end
    known = ids >= 0
    cut = np.ones(len(ids) + 1, bool)
    cut[1:-1] = ~known[1:] | ~known[:-1] | (owner[1:] != owner[:-1])
    edges = np.flatnonzero(cut)
    room = np.repeat(edges[1:], np.diff(edges)) - np.arange(len(ids))
    found = []
    shortest = min(bench.by_length, default=0)
    at = np.flatnonzero(known & (np.repeat(np.diff(edges), np.diff(edges)) >= shortest)) if shortest else np.zeros(0, int)
    if len(at):
        # the runs that are left, one after the other, with a smaller number between them
        gap = np.ones(len(at), bool)
        gap[1:] = (np.diff(at) > 1) | cut[at[1:]]
        place = np.arange(len(at)) + np.cumsum(gap)
        joined = np.zeros(place[-1] + 1, np.int32)
        joined[place] = ids[at] + 1
        back = np.full(len(joined), -1, np.int64)
        back[place] = at
        order, _ = suffix_array(joined, max(bench.by_length))
        for n, (keys, held) in bench.by_length.items():
            shifted = [(np.frombuffer(k, ">i4") + 1).astype(">i4").tobytes() for k in keys]
            low, high = search(joined, order, shifted, n)
            hits = []
            for w in np.flatnonzero(high > low).tolist():
                places = back[order[low[w] : high[w]]]
                hits += [(places, item, q) for item, q in held[w]]
            if hits:
                found.append(longest(np.concatenate([h[0] for h in hits]), *(np.repeat([h[k] for h in hits], [len(h[0]) for h in hits]) for k in (1, 2)), owner, n))
    if not found:
        return np.diff(starts), []
    doc, item, q, p, n = (np.concatenate(c) for c in zip(*found))
    return np.diff(starts), list(zip(doc.tolist(), item.tolist(), q.tolist(), (p - starts[doc]).tolist(), n.tolist()))


def longest(p: np.ndarray, item: np.ndarray, q: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """text, item, place in the item, place in the text, words: windows of n words that move on together, as one match."""
    order = np.lexsort((p, p - q, item))
    p, item, q = p[order], item[order], q[order]
    new = np.ones(len(p), bool)
    new[1:] = (item[1:] != item[:-1]) | (p[1:] - q[1:] != p[:-1] - q[:-1]) | (p[1:] != p[:-1] + 1) | (owner[p[1:]] != owner[p[:-1]])
    first = np.flatnonzero(new)
    return owner[p[first]], item[first], q[first], p[first], np.diff(np.append(first, len(p))) + n - 1


MATCH = "struct<item:string,item_start:long,start:long,words:long>"
FOUND = f"n_words long, matches array<{MATCH}>"


def found_in(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """docs (a first column of any kind, bytes) with n_words and matches in place of bytes; items fit the driver. One scan."""
    collected = sorted(((r["item_id"], r["text"]) for r in items.collect()), key=lambda r: (r[0] is None, str(r[0]), r[1]))
    bench = docs.sparkSession.sparkContext.broadcast(Benchmark(collected, window))
    name, kind = docs.dtypes[0]
    types = pa.list_(pa.struct([("item", pa.string()), ("item_start", pa.int64()), ("start", pa.int64()), ("words", pa.int64())]))

    def judge(parts):
        for part in parts:
            texts = part.column(1)
            for rows in shards(texts):
                matches = [[] for _ in range(rows.stop - rows.start)]
                n_words, found = shard_matches([t.as_py() or b"" for t in texts[rows]], bench.value)
                for doc, item, q, p, n in found:
                    matches[doc].append({"item": bench.value.item_ids[item], "item_start": q, "start": p, "words": n})
                yield pa.RecordBatch.from_arrays([part.column(0)[rows], pa.array(n_words, pa.int64()), pa.array(matches, types)], [name, "n_words", "matches"])

    return docs.mapInArrow(lean(judge), f"{name} {kind}, {FOUND}")


def contamination(docs: DataFrame, bench: DataFrame, window: int = 13, share: int = 20, carry: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (ids that occur), matches (item, item_start, start, words), contaminated.

    contaminated: some word is hit, and share times the hit words is at least all words. With carry, the columns of docs as
    one struct, row, stand in doc_id's place.
    """
    items = bench.select("item_id", "text").filter(F.col("text").isNotNull())
    n = max(1, -(-byte_size(items, "text") // BENCHMARK_BYTES))
    key = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if carry else F.col("doc_id")
    text = F.coalesce("text", F.lit("")).cast("binary")
    given = docs.select(key, text.alias("bytes"))
    if n == 1:
        told = found_in(given, items, window)
    else:  # equal texts have equal matches, so these are joined back by the text
        part = F.pmod(F.xxhash64("text"), F.lit(n))
        texts = docs.select(F.xxhash64("text").alias("text_hash"), text.alias("bytes"))
        each = [written(found_in(texts, items.filter(part == k), window).filter("size(matches) > 0").dropDuplicates(["text_hash"])) for k in range(n)]
        matches = reduce(DataFrame.unionByName, each).groupBy("text_hash").agg(F.flatten(F.collect_list("matches")).alias("more"))
        counted = found_in(docs.select(F.struct(key, F.xxhash64("text").alias("text_hash")).alias("of"), text.alias("bytes")), items.limit(0), window)
        name = given.columns[0]
        told = counted.join(matches, F.col("of.text_hash") == F.col("text_hash"), "left").select(f"of.{name}", "n_words", F.coalesce("more", "matches").alias("matches"))
    name = given.columns[0]
    covered = F.aggregate(
        F.array_sort(F.transform("matches", lambda m: F.struct(m["start"].alias("a"), (m["start"] + m["words"]).alias("b")))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda s, m: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), m["b"] - F.greatest(m["a"], s["end"]))).alias("n"), F.greatest(m["b"], s["end"]).alias("end")),
        lambda s: s["n"],
    )
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item"]), lambda i: i.isNotNull())))
    judged = told.withColumn("n_hit", covered).withColumn("items", ids)
    return judged.select(name, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "matches", ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def shards(texts: pa.Array, size: int = SHARD_BYTES):
    held = start = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        held += n
        if held >= size:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
