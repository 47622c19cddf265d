"""Exact nearest neighbours by cosine, best k of each query and collection.

Queries are a block of bounded size, held by every task; a task multiplies its
rows, a batch at a time, by a part of the block at a time and keeps the batch's best
k, so a shuffle carries k rows a query, collection and batch of 10,000 rows.  ``top_k`` takes one block and
refuses more than ``BLOCK_QUERIES``; ``top_k_of_all`` deals any number of queries
into blocks and unites their results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.params import RequestError
from ..sources.scratch import settle

BLOCK_QUERIES = 4096
CELLS = 1 << 20  # similarities that a task holds at a time
_TIE = 10  # decimals within which similarities count as equal


def _matrix(column, dim: int) -> np.ndarray:
    """Vectors of an Arrow list column; a null or another dimension raises."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    if column.null_count or not (size == dim).all():
        raise RequestError(400, f"a stored vector's dimension is not the query's {dim}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; rows without a direction become NaN."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(1, keepdims=True))


def _best(groups: list[np.ndarray], score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the best k of each group of places, ties by id; scores that are not
    finite are left out.  Only what reaches a group's k-th score is sorted."""
    out = []
    for places in groups:
        own = score[places]
        if len(own) > k:
            places = places[own >= np.partition(own, len(own) - k)[len(own) - k]]
        places = places[np.isfinite(score[places])]
        out.append(places[np.lexsort((ids[places], -score[places]))[:k]])
    return np.concatenate(out)


def best_batches(batches: Iterable[pa.RecordBatch], wanted: np.ndarray, query_ids: pa.Array, k: int) -> Iterator[pa.RecordBatch]:
    """(id, collection, vector) batches to the best k of each query and collection in
    each batch.  At most ``CELLS`` similarities are held, or those of one query."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        names = batch.column(1).dictionary_encode()
        group = names.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        by = np.argsort(group, kind="stable")
        groups = np.split(by, np.flatnonzero(np.diff(group[by])) + 1)
        rows = _unit(_matrix(batch.column(2), wanted.shape[1])).T
        width = max(1, CELLS // len(ids))
        for first in range(0, len(wanted), width):
            score = np.round(wanted[first : first + width] @ rows, _TIE)
            score[~np.isfinite(score)] = -np.inf
            best = [_best(groups, own, ids, k) for own in score]
            at = np.concatenate(best)
            if not len(at):
                continue
            q = np.repeat(np.arange(len(best)), [len(own) for own in best])
            columns = [query_ids.take(pa.array(first + q)), batch.column(1).take(pa.array(at)).cast(pa.string()), pa.array(ids[at]), pa.array(score[q, at])]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "collection", "id", "cosine"])


def top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """rows (id long, collection, vector) x queries (query_id, vector) to the best
    k by (query_id, collection): query_id, collection, id, cosine, rank from 1.

    A vector without a direction (all zeros, or not finite) is no neighbour.
    Similarities equal to ten decimals are tied and ordered by id."""
    block = _first_block(queries)
    if block.num_rows > BLOCK_QUERIES:
        raise RequestError(413, f"more than {BLOCK_QUERIES} queries in one block")
    return _top_k_of_block(rows, queries, block, k)


def _first_block(queries: DataFrame) -> pa.Table:
    """A block of queries, and one more where there are more."""
    return queries.select("query_id", "vector").limit(BLOCK_QUERIES + 1).toArrow()


def _top_k_of_block(rows: DataFrame, queries: DataFrame, block: pa.Table, k: int) -> DataFrame:
    k = max(1, int(k))
    query_type = rows.sparkSession.createDataFrame([], queries.select("query_id").schema).schema["query_id"].dataType
    schema = f"query_id {query_type.simpleString()}, collection string, id long, cosine double"
    if not block.num_rows:
        return rows.sparkSession.createDataFrame([], schema + ", rank int")
    vectors = block["vector"].combine_chunks()
    wanted = _unit(_matrix(vectors, len(vectors[0])))
    query_ids = block["query_id"].combine_chunks()

    def run(batches):
        return best_batches(batches, wanted, query_ids, k)

    found = rows.select(F.col("id").cast("long"), F.col("collection").cast("string"), "vector").mapInArrow(run, schema)
    window = Window.partitionBy("query_id", "collection").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _blocks(queries: DataFrame) -> tuple[DataFrame, int]:
    """The queries, written with a block number each, and how many blocks there
    are; none has more than ``BLOCK_QUERIES``.  Rows are dealt, not ids, so equal
    queries spread too."""
    numbered = settle(queries.withColumn("__row", F.monotonically_increasing_id()), "knn-queries")
    blocks = -(-numbered.count() // BLOCK_QUERIES) + 1
    while True:
        dealt = numbered.withColumn("__block", F.pmod(F.xxhash64("__row"), F.lit(blocks)))
        if dealt.groupBy("__block").count().agg(F.max("count")).first()[0] <= BLOCK_QUERIES:
            return dealt.drop("__row"), blocks
        blocks += -(-blocks // 4)


def top_k_of_all(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``top_k`` for any number of queries.  Several blocks are run one after
    another and written, so the driver holds one block at a time."""
    block = _first_block(queries)
    if block.num_rows <= BLOCK_QUERIES:
        return _top_k_of_block(rows, queries, block, k)
    queries, blocks = _blocks(queries.select("query_id", "vector"))
    parts = [settle(top_k(rows, queries.where(F.col("__block") == b), k), "knn-block") for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)
