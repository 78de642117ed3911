"""Importance resampling towards a target text collection, with bit-sliced weights.

Features of a text are its words (runs of ASCII letters and digits and of everything beyond
ASCII, A-Z lower-cased) and its pairs of neighbouring words; a feature's bucket is the CRC-32
of its UTF-8 bytes modulo `N_BUCKETS`. Two aggregations count every bucket over all documents
and over all target texts; a bucket's gain is a whole number of thousandths of the log ratio.

A document's weight is bit-sliced: its bucket counts become planes of N_BUCKETS bits, plane j
holding bit j of every count; the gains, split by sign, become planes in the same way. AND of
a count plane and a gain plane, the number of bits left, and the power of two the planes
stand for, summed over all pairs of planes, is exactly the sum of count times gain. The mean
over the features, rounded down, is the weight; noise hashed from the identifier (Gumbel)
makes the highest scores a sample without replacement in proportion to the weights.

What is gathered is a row per bucket (`N_BUCKETS` at most). Texts are read twice, in the
order they are stored, and never shuffled. Ranks come from one sort by ranges of (score,
doc_id): a row's rank is the size of the ranges before its own plus its place inside.

Defined results: a null or empty text has no features, weight 0 and is not drawn; without
target texts or documents the counts are 0 and the gains follow from the formula; a null
doc_id hashes as the empty text and sorts first; repeated rows get equal scores and one rank
each; an empty table gives an empty result; other columns are ignored, except in `selected`,
which passes them on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import stored

N_BUCKETS = 10_000
#: Documents with fewer words are not drawn; the share drawn of the others; the salt of the noise.
MIN_WORDS, SHARE_PERCENT, SALT = 20, 25, "7"

#: Texts are worked through in slices of so many bytes (one text at least).
SLICE_BYTES = 1 << 21
#: Words up to this length go through the vectorised CRC, longer ones through zlib.
LONG_WORD = 48
#: Documents whose planes are laid out at once, and words of 64 bits in a plane.
ROWS, WORDS_64 = 64, -(-N_BUCKETS // 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_IN_WORD = np.zeros(256, dtype=bool)
for first, last in (("0", "9"), ("a", "z")):
    _IN_WORD[ord(first):ord(last) + 1] = True
_IN_WORD[0x80:] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def _crc_over(crc: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 carried on from `crc` over the bytes of each word."""
    order = np.argsort(-sizes, kind="stable")
    begins, left = starts[order], sizes[order]
    state = ~crc[order]
    # The longest words come first: those still running are a shrinking head.
    running = np.searchsorted(-left, -np.arange(1, LONG_WORD + 1), side="right")
    n_long = int(np.searchsorted(-left, -LONG_WORD, side="left"))
    for i, n in enumerate(running):
        if n <= n_long:
            break
        head = state[n_long:n]
        state[n_long:n] = _CRC[(head ^ data[begins[n_long:n] + i]) & 255] ^ (head >> 8)
    state = ~state
    for k in range(n_long):
        word = data[begins[k]:begins[k] + left[k]].tobytes()
        state[k] = zlib.crc32(word, int(crc[order[k]]))
    done = np.empty_like(state)
    done[order] = state
    return done


def _slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of texts, UTF-8 bytes, offsets of the texts in them), slice by slice."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        yield upto - at, data[offsets[at]:offsets[upto]], offsets[at:upto + 1] - offsets[at]
        at = upto


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and (text, bucket) of each feature."""
    n = len(offsets) - 1
    data = _LOWER[data]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _IN_WORD[data]
    # A word neither reaches into the next text nor back into the one before.
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    sizes = ends - starts
    owner = np.searchsorted(offsets, starts, side="right") - 1
    words = np.bincount(owner, minlength=n)
    crc = _crc_over(np.zeros(len(starts), dtype=np.uint32), data, starts, sizes)
    pairs = np.flatnonzero(owner[1:] == owner[:-1])
    spaced = ~crc[pairs]
    spaced = ~(_CRC[(spaced ^ 32) & 255] ^ (spaced >> 8))
    joined = _crc_over(spaced, data, starts[pairs + 1], sizes[pairs + 1])
    return (
        words, np.concatenate([owner, owner[pairs]]),
        np.concatenate([crc, joined]).astype(np.int64) % N_BUCKETS,
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(N_BUCKETS, dtype=np.int64)
    for batch in batches:
        for _, data, offsets in _slices(batch.column("text")):
            counts += np.bincount(_features(data, offsets)[2], minlength=N_BUCKETS)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["bucket", "n"])


def bucket_counts(texts: DataFrame) -> DataFrame:
    """bucket, n: features of all texts in each bucket that has any; a task sends a row per bucket."""
    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> DataFrame:
    """bucket, gain of every bucket, from the bucket counts of both sides."""
    spark = source.sparkSession
    # Both counts of a bucket, 0 where it does not occur.
    both = (
        spark.range(N_BUCKETS).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"),
                                      F.lit(0).cast("long").alias("t"))
        .unionByName(source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")))
        .unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
        .groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    )
    # N_BUCKETS rows.
    sums = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    s, t = (F.lit(float(x or 0)) for x in (sums["s"], sums["t"]))
    ratio = ((F.col("t").cast("double") + 1) * (s + N_BUCKETS)) / ((F.col("s").cast("double") + 1) * (t + N_BUCKETS))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def gain_planes(values: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(signed power of two, plane of bits) whose sum is `values`."""
    planes = []
    for sign in (1, -1):
        sizes = np.where(values * sign > 0, values * sign, 0)
        for i in range(int(sizes.max(initial=0)).bit_length()):
            planes.append((sign << i, _packed((sizes >> i) & 1)))
    return planes


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of N_BUCKETS bits, 64 to a word."""
    packed = np.packbits(bits.astype(np.uint8), axis=-1)
    room = np.zeros((*packed.shape[:-1], WORDS_64 * 8), dtype=np.uint8)
    room[..., :packed.shape[-1]] = packed
    return room.view(np.uint64)


def weigh_counts(counts: np.ndarray, planes: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Sum of count times gain of each row of `counts`, from planes of bits alone."""
    sums = np.zeros(len(counts), dtype=np.int64)
    for j in range(int(counts.max(initial=0)).bit_length()):
        plane = _packed((counts >> j) & 1)
        for power, gain in planes:
            sums += (power << j) * np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64)
    return sums


def _weigh(values: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = gain_planes(np.array(values, dtype=np.int64))
        for batch in batches:
            n_words, n_features, sums = [], [], []
            for n, data, offsets in _slices(batch.column("text")):
                words, owner, bucket = _features(data, offsets)
                order = np.argsort(owner, kind="stable")
                owner, bucket = owner[order], bucket[order]
                cuts = np.searchsorted(owner, np.arange(0, n + ROWS, ROWS))
                for first, a, b in zip(range(0, n, ROWS), cuts, cuts[1:]):
                    rows = min(ROWS, n - first)
                    cells = (owner[a:b] - first) * N_BUCKETS + bucket[a:b]
                    counts = np.bincount(cells, minlength=rows * N_BUCKETS).reshape(rows, N_BUCKETS)
                    n_features.append(counts.sum(axis=1))
                    sums.append(weigh_counts(counts, planes))
                n_words.append(words)
            if not n_words:
                continue
            features, total = np.concatenate(n_features), np.concatenate(sums)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (
                    np.concatenate(n_words), features, total // np.maximum(features, 1)))],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    return run


def weigh(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_features, weight."""
    rows = gains(bucket_counts(docs), bucket_counts(benchmark)).collect()  # N_BUCKETS rows
    values = [gain for _, gain in sorted((r["bucket"], r["gain"]) for r in rows)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _weigh(values), "doc_id long, n_words long, n_features long, weight long"
    )


def with_score(weighed: DataFrame, salt: str = SALT) -> DataFrame:
    """Adds the score: the weight and Gumbel noise hashed from salt and identifier."""
    name = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise)


def ranked(rows: DataFrame) -> DataFrame:
    """Adds rank 1, 2, 3... by score descending, then doc_id: sorted by ranges, no range alone knows.

    Rows equal in both (repeated rows) are dealt by a third key, so that one of them with a
    third of the table still falls into many ranges.
    """
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("row")]
    dealt = stored(
        rows.withColumn("row", F.xxhash64(F.monotonically_increasing_id()))
        .repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
        # Range in the upper bits, place inside the range in the lower 33.
        .withColumn("place", F.monotonically_increasing_id()), "ranked",
    )
    part = F.shiftright("place", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row per range, as many as there were tasks.
    starts = dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    place = F.col("place").bitwiseAND((1 << 33) - 1)
    return dealt.withColumn("part", part).join(starts, "part").withColumn(
        "rank", F.col("start") + place + 1
    ).drop("part", "start", "place")


def resample(
    docs: DataFrame, benchmark: DataFrame, percent: int = SHARE_PERCENT, min_words: int = MIN_WORDS, salt: str = SALT
) -> DataFrame:
    """Per row of `docs`: doc_id, n_features, weight, score, and rank if it is drawn.

    Drawn are floor(percent * N / 100) of the N rows with at least `min_words` words, by
    score descending, then doc_id.
    """
    scored = stored(with_score(weigh(docs, benchmark), salt), "scored")
    able = scored.where(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return ranked(able.select(*columns)).select(*columns, rank.alias("rank")).unionByName(
        scored.where(F.col("n_words") < min_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    )


def selected(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that are drawn, with all their columns, once per drawn row of a doc_id."""
    drawn = resample(docs, benchmark, **options).where("rank IS NOT NULL").select("doc_id").distinct()
    return docs.join(drawn, docs["doc_id"].eqNullSafe(drawn["doc_id"]), "left_semi")
