"""Exact top-k inner products by the three-phase uniform threshold.

The dimensions are dealt into `lists`; a vector's score is the sum of one partial score per list, and each list holds partial
scores of all vectors, spread over the tasks.
  1. Every task reports, per query and list, its k best partial scores and its least; the k best of each list are scored
     exactly, which gives each query a k-th score that the answer can't fall below.
  2. That cutoff, less the lists' least scores and divided evenly among the lists, goes back out; a list offers the vectors
     whose partial score reaches its even share. A vector that no list offers scores below the cutoff, so none is lost.
  3. Offered vectors are resolved exactly from all lists, and those at or over the cutoff are ranked.

Vectors that are null or hold a null, NaN or infinity take no part, nor do rows without vec_id. Rows of one vec_id are rows like
others: each is a query or a candidate of its own, and of the others' lists; a query's own row alone is left out. Only vectors of
the same length are compared. Ties go to the smaller vec_id, then to the row that comes first. An empty table gives
no row; columns beside vec_id and embedding are not read. Scores have to fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import Scratch, written

SCALE = 1024
#: Bytes of packed queries up to which they are broadcast; more are shuffled to the chunks of candidates by block.
BROADCAST = 32 << 20
PARTIALS = "query long, list int, least double, rows array<long>, scores array<long>"


def integers(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """row, vec_id, v: floor(scale * x) of every component, for whole and finite vectors, with a number for each row."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    sound = embeddings.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    return sound.select(F.monotonically_increasing_id().alias("row"), "vec_id", v.alias("v"))


def chunked(vectors: DataFrame, rows: int) -> DataFrame:
    """Candidates as rows of (dims, rows, ids, matrix), so that a task multiplies whole matrices."""

    def pack(parts):
        for part in parts:
            row, ids, lists = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            flat, starts = lists.flatten().to_numpy(), np.cumsum(sizes) - sizes
            for d in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == d)
                for i in range(0, len(own), rows):
                    at = own[i : i + rows]
                    matrix = flat[starts[at][:, None] + np.arange(d)]
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *(pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (row[at], ids[at], matrix))], ["dims", "rows", "ids", "matrix"])

    return vectors.select("row", "vec_id", "v").mapInArrow(pack, "dims int, rows binary, ids binary, matrix binary")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers; by floating point where no sum can leave its exact range."""
    reach = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if reach < 2**52 else a @ b.T


def matrices(pair: dict, lists: int):
    """A joined row's candidate rows and ids, its queries' rows and ids, and per list the partial scores (queries by candidates)."""
    d = pair["dims"]
    rows, ids = np.frombuffer(pair["rows"], "<i8"), np.frombuffer(pair["ids"], "<i8")
    left = np.frombuffer(pair["matrix"], "<i8").reshape(len(ids), d)
    asked = pair["queries"]
    right = np.array([q["v"] for q in asked], np.int64).reshape(len(asked), d)
    edges = [d * j // lists for j in range(lists + 1)]
    return rows, ids, [(q["row"], q["vec_id"]) for q in asked], [product(right[:, a:b], left[:, a:b]) for a, b in zip(edges, edges[1:])]


def meet(chunks: DataFrame, blocks: DataFrame, n_blocks: int, small: bool) -> DataFrame:
    """Every chunk with every block of queries: the stated query set against all rows, in blocks."""
    each = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    return each.join(F.broadcast(blocks) if small else blocks, ["block", "dims"])


def top_k(embeddings: DataFrame, is_query, k: int = 10, lists: int = 2, chunk: int = 2048, block: int = 512, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query over all other rows. is_query is a condition on vec_id."""
    with Scratch(embeddings.sparkSession) as tables:
        return written(_top_k(tables.written(integers(embeddings, scale)), is_query, k, lists, chunk, block))


def _top_k(vectors: DataFrame, is_query, k: int, lists: int, chunk: int, block: int) -> DataFrame:
    asked = vectors.filter(is_query)
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_blocks, small = max(1, -(-n // block)), n * (width + 4) * 8 <= BROADCAST
    keyed = asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int")).withColumn("dims", F.size("v"))
    chunks = chunked(vectors, chunk)

    def local_lists(parts):
        for part in parts:
            for pair in part.to_pylist():
                rows, _, asked_ids, partial = matrices(pair, lists)
                for q, (query, _) in enumerate(asked_ids):
                    others = rows != query
                    for j, scores in enumerate(partial):
                        own, own_rows = scores[q][others], rows[others]
                        if len(own):
                            best = np.argpartition(-own, min(k, len(own)) - 1)[:k]
                            yield pa.RecordBatch.from_pylist([{"query": query, "list": j, "least": float(own.min()), "rows": own_rows[best].tolist(), "scores": own[best].tolist()}], schema=SCHEMA)

    SCHEMA = pa.schema([("query", pa.int64()), ("list", pa.int32()), ("least", pa.float64()), ("rows", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64()))])
    blocks = keyed.groupBy("block", "dims").agg(F.collect_list(F.struct("row", "vec_id", "v")).alias("queries"))
    gathered = meet(chunks, blocks, n_blocks, small).mapInArrow(local_lists, PARTIALS)
    least = gathered.groupBy("query", "list").agg(F.min("least").alias("least")).groupBy("query").agg(F.sum("least").alias("floor"), F.map_from_entries(F.collect_list(F.struct("list", "least"))).alias("leasts"))
    entries = gathered.select("query", "list", F.inline(F.arrays_zip(F.col("rows").alias("row"), F.col("scores").alias("score"))))
    best = Window.partitionBy("query", "list").orderBy(F.desc("score"), "row")
    seen = entries.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k).select("query", "row").distinct()
    exact = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    scored = seen.join(vectors, "row").join(asked.select(F.col("row").alias("query"), F.col("v").alias("w")), "query").select("query", exact.alias("score"))
    by_score = Window.partitionBy("query").orderBy(F.desc("score"))
    cutoffs = scored.withColumn("at", F.row_number().over(by_score)).filter(F.col("at") == k).select("query", F.col("score").alias("cutoff")).join(least, "query")

    def resolve(parts):
        for part in parts:
            for pair in part.to_pylist():
                rows, ids, asked_ids, partial = matrices(pair, lists)
                told_of = {q["row"]: q for q in pair["queries"]}
                for q, (query, query_id) in enumerate(asked_ids):
                    told = told_of[query]
                    offered = rows != query
                    if told["cutoff"] is not None:  # fewer than k others: all are offered
                        share = told["cutoff"] - told["floor"]
                        leasts = dict(told["leasts"])
                        offered &= np.any([lists * (s[q] - leasts[j]) >= share for j, s in enumerate(partial)], axis=0)
                    at = np.flatnonzero(offered)
                    score = sum(s[q][at] for s in partial)
                    if told["cutoff"] is not None:
                        at, score = at[score >= told["cutoff"]], score[score >= told["cutoff"]]
                    order = np.lexsort((rows[at], ids[at], -score))[:k]  # of one chunk no more can be among the k
                    if len(order):
                        at, score = at[order], score[order]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), query)), pa.array(np.full(len(at), query_id)), pa.array(rows[at]), pa.array(ids[at]), pa.array(score)], ["query", "query_id", "row", "vec_id", "score"])

    informed = keyed.join(cutoffs.withColumnRenamed("query", "row"), "row", "left")
    told = informed.groupBy("block", "dims").agg(F.collect_list(F.struct("row", "vec_id", "v", "cutoff", "floor", "leasts")).alias("queries"))
    found = meet(chunks, told, n_blocks, small).mapInArrow(resolve, "query long, query_id long, row long, vec_id long, score long")
    final = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
