"""Exact top-k search by whole-number inner products: distributed histogram selection.

Vectors are quantised (floor of `SCALE` times each component) and packed into blocks: rows
holding up to `BLOCK` vectors as one matrix. Blocks of the queries meet every block of the
candidates by an equi-join on a part number, one row per pair of blocks, and a pair is
scored as one matrix product; scores are never stored. A round counts, for each query, the
scores in `BINS` equal bins of the interval that holds its k-th highest score; the counts,
added up over all parts, name the bin that holds it, which is the next round's interval. A
few rounds (7 bits each) leave the k-th score itself. The last round keeps scores at or above
it; a task passes on at most k rows of a query (ties beyond the first k by vec_id cannot be
wanted), and ranks by (score descending, vec_id) settle the rest.

The query set is stated (every `every`-th id) and grows with the table, so work is queries
times candidates, in blocks, whatever the data: hot vectors and ties change nothing. Queries
reach every part once per `PART` candidates. The driver sees counts and two maxima.

Products are exact: in doubles while norms bound them below 2^53, in 64-bit integers below
2^63; vectors whose scores could be larger raise an error instead of a wrong score.

Defined results: a vector that is null or has a null or non-finite component takes no part; a
query meets candidates of its own length only; rows with the query's vec_id are the query's
own; repeated rows are candidates each, and a repeated query row has its results each time; a
null vec_id is a candidate, after all others among ties, and never a query; with fewer than
k candidates all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import stored

SCALE, EVERY, K = 1024, 100, 10
#: Vectors in a block of candidates and of queries; candidates in a part, about.
BLOCK, QUERY_BLOCK, PART = 2048, 512, 1 << 17
#: Bits of the score that a round settles.
BITS = 7
BINS = 1 << BITS
#: Query blocks whose counts a task holds before it passes them on.
HELD = 16

PACKED = "block long, dim int, n int, norm double, ids binary, null_ids binary, vectors binary"
PAIR = ["query_block", "q_dim", "q_ids", "q_vectors", "lows", "ids", "null_ids", "vectors"]


def _pack(size: int):
    """Blocks of up to `size` vectors of one length from rows of vec_id, embedding."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            vectors = batch.column("embedding")
            lengths = pc.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False)
            parents = pc.list_parent_indices(vectors).to_numpy(zero_copy_only=False)
            flat = np.floor(pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
            bad = np.bincount(parents[~np.isfinite(flat)], minlength=len(lengths)) > 0
            null_ids = np.asarray(batch.column("vec_id").is_null())
            ids = batch.column("vec_id").fill_null(0).to_numpy()
            starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
            for dim in np.unique(lengths[(lengths >= 0) & ~bad]):
                rows = np.flatnonzero((lengths == dim) & ~bad)
                for at in range(0, len(rows), size):
                    chosen = rows[at:at + size]
                    matrix = flat[starts[chosen][:, None] + np.arange(dim)] if dim else np.zeros((len(chosen), 0))
                    norm = float(np.sqrt((matrix ** 2).sum(axis=1)).max())
                    values = [
                        (part << 33) + made, int(dim), len(chosen), norm, ids[chosen].astype("<i8").tobytes(),
                        null_ids[chosen].tobytes(), matrix.astype("<f8").tobytes(),
                    ]
                    types = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], t) for v, t in zip(values, types)],
                        ["block", "dim", "n", "norm", "ids", "null_ids", "vectors"],
                    )
                    made += 1

    return run


def packed(vectors: DataFrame, size: int) -> DataFrame:
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    return stored(rows.where("embedding IS NOT NULL").mapInArrow(_pack(size), PACKED), "vectors", "none")


def _scored(wide: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(query block, ids, lows, candidates' ids, null ids, scores, the query's own) of each pair of blocks."""
    for batch in batches:
        for row in range(batch.num_rows):
            block, dim, q_ids, q_vectors, lows, ids, null_ids, vectors = (
                batch.column(name)[row].as_py() for name in PAIR
            )
            q_ids, ids = np.frombuffer(q_ids, "<i8"), np.frombuffer(ids, "<i8")
            null_ids = np.frombuffer(null_ids, bool)
            q = np.frombuffer(q_vectors, "<f8").reshape(len(q_ids), dim)
            c = np.frombuffer(vectors, "<f8").reshape(len(ids), dim)
            if wide:
                q, c = q.astype(np.int64), c.astype(np.int64)
            scores = (q @ c.T).astype(np.int64)
            own = (q_ids[:, None] == ids) & ~null_ids
            yield block, q_ids, np.array(lows, dtype=np.int64), ids, null_ids, scores, own


def _histogram(wide: bool, shift: int):
    """Counts of scores by (query, bin) in the queries' intervals."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for block, counts in held.items():
                query, place = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(query), block)), pa.array(query.astype(np.int32)),
                     pa.array(place.astype(np.int32)), pa.array(counts[query, place])],
                    ["query_block", "query", "bin", "n"],
                )
            held.clear()

        for block, q_ids, lows, _, _, scores, own in _scored(wide, batches):
            place = (scores - lows[:, None]) >> shift
            query, column = np.nonzero((place >= 0) & (place < BINS) & ~own)
            if block not in held and len(held) >= HELD:
                yield from flush()
            counts = np.bincount(query * BINS + place[query, column], minlength=len(q_ids) * BINS)
            held[block] = held.get(block, 0) + counts.reshape(len(q_ids), BINS)
        yield from flush()

    return run


def _best(k: int, rows: list[np.ndarray]) -> list[np.ndarray]:
    """Of rows (query, score, null id, id) the first k of each query."""
    query, score, null_id, vec_id = (np.concatenate(x) for x in zip(*rows))
    order = np.lexsort((vec_id, null_id, -score, query))
    query = query[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    first = order[place < k]
    return [query[place < k], score[first], null_id[first], vec_id[first]]


def _select(wide: bool, k: int):
    """The rows at or above each query's k-th score, at most k of a query from a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = defaultdict(list)
        names: dict[int, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for block, rows in held.items():
                query, score, null_id, vec_id = _best(k, rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(query), block)), pa.array(query.astype(np.int32)), pa.array(names[block][query]),
                     pa.array(vec_id, mask=null_id), pa.array(score)],
                    ["query_block", "query", "query_id", "vec_id", "score"],
                )
            held.clear()
            names.clear()

        for block, q_ids, lows, ids, null_ids, scores, own in _scored(wide, batches):
            query, column = np.nonzero((scores >= lows[:, None]) & ~own)
            if block not in held and len(held) >= HELD:
                yield from flush()
            names[block] = q_ids
            held[block].append([query, scores[query, column], null_ids[column], ids[column]])
            if len(held[block]) > 1:
                held[block] = [_best(k, held[block])]
        yield from flush()

    return run


def _narrowed(counts: DataFrame, states: DataFrame, shift: int) -> DataFrame:
    """The states after a round: `low` moves up to the bin of the k-th score, `need` is what is still missing in it."""
    down = Window.partitionBy("query_block", "query").orderBy(F.col("bin").desc())
    summed = counts.groupBy("query_block", "query", "bin").agg(F.sum("n").alias("n"))
    reached = summed.withColumn("upto", F.sum("n").over(down))
    joined = reached.join(states, ["query_block", "query"])
    # The first bin, from above, with which enough is reached; if all are too few, everything is wanted.
    found = joined.where(F.col("upto") >= F.col("need")).groupBy("query_block", "query").agg(
        F.max("bin").alias("bin"), F.min(F.col("upto") - F.col("n")).alias("above")
    )
    kept = states.join(found, ["query_block", "query"], "left")
    return kept.select(
        "query_block", "query",
        (F.col("low") + F.coalesce(F.col("bin"), F.lit(0)).cast("long") * F.lit(1 << shift)).alias("low"),
        (F.col("need") - F.coalesce("above", F.lit(0))).alias("need"),
    )


def search(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    candidates = packed(vectors, BLOCK)
    asked = vectors.where(F.col("vec_id") % every == 0)
    n_blocks = asked.count() // QUERY_BLOCK + 1
    queries = packed(asked.repartition(n_blocks), QUERY_BLOCK).select(
        F.col("block").alias("query_block"), F.col("dim").alias("q_dim"), F.col("n").alias("q_n"),
        F.col("norm").alias("q_norm"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"),
    )
    # No product is larger than that of the norms; one more for their own rounding.
    norms = [x or 0.0 for x in (queries.agg(F.max("q_norm")).first()[0], candidates.agg(F.max("norm")).first()[0])]
    limit = int(norms[0] * norms[1] * (1 + 1e-6)) + 1
    if limit >= 1 << 62:
        raise ValueError("vectors this long have inner products beyond 64 bits")
    wide = limit >= 1 << 53

    total = candidates.agg(F.sum("n")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, total // PART + 1)
    dealt = candidates.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)))
    sent = queries.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def pairs(states: DataFrame) -> DataFrame:
        # At most QUERY_BLOCK states of a block.
        lows = states.groupBy("query_block").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("query", "low"))), lambda s: s["low"]).alias("lows")
        )
        return dealt.join(sent.join(lows, "query_block"), "part").where("dim = q_dim").select(*PAIR)

    states = queries.select(
        "query_block", F.explode(F.sequence(F.lit(0), F.col("q_n") - 1)).alias("query"),
        F.lit(-limit).alias("low"), F.lit(k).cast("long").alias("need"),
    )
    rounds = -(-(2 * limit).bit_length() // BITS)
    for shift in range((rounds - 1) * BITS, -1, -BITS):
        counts = pairs(states).mapInArrow(_histogram(wide, shift), "query_block long, query int, bin int, n long")
        states = stored(_narrowed(counts, states, shift), "kth")
    found = pairs(states).mapInArrow(
        _select(wide, k), "query_block long, query int, query_id long, vec_id long, score long"
    )
    best = Window.partitionBy("query_block", "query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
