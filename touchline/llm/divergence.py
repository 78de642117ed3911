"""Audit of how sources of a language diverge: recount through minimal perfect hashes.

Terms are runs of ASCII letters and of everything beyond ASCII, A-Z lower-cased. A first pass
counts in how many documents of a language each term occurs, exactly, and keeps those with
`MIN_DOCUMENTS` or more. The kept terms of a language are split by hash into shards of
about `shard` terms; each shard becomes a minimal perfect hash in a task of its own
(buckets of a few terms, the largest first, each with the first displacement that finds
only free slots; buckets of one term name their slot). With the terms stored beside their
slots, a lookup is one displacement, one slot and one comparison, and a term that was not
kept is recognised by the comparison. The second pass counts again, now into dense arrays,
one slot per kept term and one array per (language, source), and sends on what is not zero.

Shards are broadcast in rounds of at most `round_bytes` of terms, each round a pass over the
texts: one for vocabularies up to that size, more beyond it, so memory is bounded and
nothing is left out. A task passes its counts on and starts anew whenever they fill
`task_bytes` (first pass) or `task_slots` (second).

A group's distribution over the V kept terms of its language, in units of 1e-9 and smoothed,
is p = 1 + floor(10^9 (count + 5) / (N + 5 V)), with N the sum of its counts. Distances
between sources are summed over tiles of (`sources` sources, `sources` sources, `terms`
terms): terms of a hot language spread over many tiles, and no tile grows with the input.
All arithmetic is on whole numbers.

Defined results: null text, lang and source count as ''; a group without terms takes part with
counts of 0; a language without kept terms has pairs of value 0 and no terms; a source
alone in its language has no pairs; repeated rows and rows without doc_id count like
others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import stored, whole_text

MIN_DOCUMENTS = 30
#: Smoothing added to every count, the unit of shares, ranks reported of terms.
SMOOTHING, UNIT, TOP_TERMS = 5, 1_000_000_000, 50
#: Terms in an average bucket of a perfect hash.
PER_BUCKET = 4


@dataclass(frozen=True)
class Limits:
    """What tasks hold; results do not depend on it."""

    #: Terms in a shard, about, and bytes of terms broadcast at once.
    shard: int = 1 << 12
    round_bytes: int = 64 << 20
    #: What a task holds before it passes counts on: bytes of terms, slots.
    task_bytes: int = 32 << 20
    task_slots: int = 1 << 23
    #: Sources and terms of a tile.
    sources: int = 256
    terms: int = 512


LIMITS = Limits()

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MASK = (1 << 64) - 1


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _mixed(hashes: np.ndarray, displacement: np.ndarray | int) -> np.ndarray:
    """64-bit hashes, each scrambled by its displacement."""
    x = hashes ^ (np.asarray(displacement, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Slots 0 to n - 1 of n distinct terms; -1 for any other."""

    def __init__(self, seed: int, displacements: np.ndarray, keys: list[bytes]):
        self.seed, self.displacements = seed, displacements
        self.keys = np.empty(len(keys), dtype=object)
        self.keys[:] = keys

    @staticmethod
    def _hashes(keys: list[bytes], seed: int) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(k, seed) for k in keys), dtype=np.uint64, count=len(keys))

    @classmethod
    def build(cls, keys: list[bytes]) -> PerfectHash:
        seed = 0
        while len(set((hashes := cls._hashes(keys, seed)).tolist())) < len(keys):
            seed += 1  # two terms with one 64-bit hash
        n = len(keys)
        n_buckets = n // PER_BUCKET + 1
        bucket = (hashes % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=n_buckets)
        begins = np.cumsum(sizes) - sizes
        slots = np.full(n, -1, dtype=np.int64)
        free = np.ones(n, dtype=bool)
        displacements = np.zeros(n_buckets, dtype=np.int64)
        by_size = np.argsort(-sizes, kind="stable")
        for b in by_size[:np.count_nonzero(sizes > 1)]:
            members = order[begins[b]:begins[b] + sizes[b]]
            first = 1
            while True:
                tried = np.arange(first, first + 64)
                found = (_mixed(hashes[members][None, :], tried[:, None]) % np.uint64(n)).astype(np.int64)
                apart = np.sort(found, axis=1)
                fits = free[found].all(axis=1) & (apart[:, 1:] != apart[:, :-1]).all(axis=1)
                if fits.any():
                    at = int(np.argmax(fits))
                    displacements[b] = first + at
                    slots[members] = found[at]
                    free[found[at]] = False
                    break
                first += 64
        for b, slot in zip(np.flatnonzero(sizes == 1), np.flatnonzero(free)):
            displacements[b] = -slot - 1
            slots[order[begins[b]]] = slot
        stored_keys: list[bytes] = [b""] * n
        for key, slot in zip(keys, slots):
            stored_keys[slot] = key
        return cls(seed, displacements, stored_keys)

    def find(self, words: list[bytes]) -> np.ndarray:
        n = len(self.keys)
        if not n or not words:
            return np.full(len(words), -1, dtype=np.int64)
        hashes = self._hashes(words, self.seed)
        d = self.displacements[(hashes % np.uint64(len(self.displacements))).astype(np.int64)]
        slots = np.where(d < 0, -d - 1, (_mixed(hashes, np.maximum(d, 0)) % np.uint64(n)).astype(np.int64))
        asked = np.empty(len(words), dtype=object)
        asked[:] = words
        return np.where(self.keys[slots] == asked, slots, -1)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, list[bytes]]]:
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text"))):
            yield lang.as_py(), source.as_py(), terms(text.as_py())


def _document_frequency(limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string()),
                     pa.array(list(counts.values()), pa.int64())], ["lang", "term", "n"],
                )
            held.clear()

        for lang, _, words in _texts(batches):
            counts = held[lang]
            before = len(counts)
            once = set(words)
            counts.update(once)
            if len(counts) > before:
                # About 100 bytes for each new term beside its own.
                size += (len(counts) - before) * (100 + sum(map(len, once)) // len(once))
            if size > limits.task_bytes:
                yield from flush()
                size = 0
        yield from flush()

    return run


def _grouped(docs: DataFrame) -> DataFrame:
    return docs.select(*[whole_text(c).cast("string").alias(c) for c in ("lang", "source", "text")])


def kept_terms(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, limits: Limits = LIMITS) -> DataFrame:
    """lang, term of the terms in at least `min_documents` documents of the language."""
    counted = _grouped(docs).mapInArrow(_document_frequency(limits), "lang string, term string, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_documents).select(
        "lang", "term"
    )


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    """The perfect hash of one shard as one row: its terms in the order of their slots."""
    made = PerfectHash.build([t.encode() for t in rows["term"]])
    return pd.DataFrame({
        "lang": [rows["lang"].iloc[0]], "shard": [rows["shard"].iloc[0]], "shards": [rows["shards"].iloc[0]],
        "n": [len(made.keys)], "size": [sum(map(len, made.keys)) + 48 * len(made.keys)], "seed": [made.seed],
        "displacements": [made.displacements.tobytes()], "terms": [[k.decode() for k in made.keys]],
    })


def shard_of(term: bytes, shards: int) -> int:
    return xxhash.xxh3_64_intdigest(term, _MASK) % shards


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shard = [
            shard_of(term.encode(), shards)
            for term, shards in zip(batch.column("term").to_pylist(), batch.column("shards").to_pylist())
        ]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int64())], [*batch.schema.names, "shard"])


def perfect_hashes(vocabulary: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """One row per shard: lang, shard, shards (of the language), n, size, seed, displacements, terms, start.

    `start` is the language's first slot of the shard, so that its slots run from 0 to V - 1.
    """
    sizes = vocabulary.groupBy("lang").agg((F.count(F.lit(1)) / limits.shard).cast("long").alias("shards"))
    sharded = vocabulary.join(sizes.withColumn("shards", F.col("shards") + 1), "lang").mapInArrow(
        _sharded, "lang string, term string, shards long, shard long"
    )
    built = stored(sharded.groupBy("lang", "shard").applyInPandas(
        _build, "lang string, shard long, shards long, n long, size long, seed long, displacements binary, terms array<string>"
    ), "perfect-hashes")
    before = Window.partitionBy("lang").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = built.select("lang", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return stored(built.join(starts, ["lang", "shard"]), "perfect-hashes")


def _recount(shared, limits: Limits):
    """Counts of the broadcast shards' terms in dense arrays per (lang, source)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, tuple[int, dict]] = {}
        widths: dict[str, int] = defaultdict(int)
        for lang, shard, shards, seed, displacements, keys, start in shared.value:
            made = PerfectHash(seed, np.frombuffer(displacements, dtype=np.int64), keys)
            by_lang.setdefault(lang, (shards, {}))[1][shard] = (made, start, widths[lang])
            widths[lang] += len(keys)
        # A slot of this round, in the language's own numbers.
        numbers = {
            lang: np.concatenate([np.arange(len(made.keys)) + start for made, start, _ in shards.values()])
            for lang, (_, shards) in by_lang.items()
        }
        dense: dict[tuple[str, str], np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in dense.items():
                seen = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(seen), pa.string()), pa.array([source] * len(seen), pa.string()),
                     pa.array(numbers[lang][seen]), pa.array(counts[seen])], ["lang", "source", "slot", "n"],
                )
            dense.clear()

        def add(lang: str, source: str, words: list[bytes]) -> Iterator[pa.RecordBatch]:
            shards, hashes = by_lang[lang]
            if (lang, source) not in dense:
                if (sum(map(len, dense.values())) + widths[lang]) > limits.task_slots:
                    yield from flush()
                dense[lang, source] = np.zeros(widths[lang], dtype=np.int64)
            counts = dense[lang, source]
            often = Counter(words)
            parts: dict[int, list[bytes]] = defaultdict(list)
            if shards == 1:
                parts[0] = list(often)
            else:
                for word in often:
                    parts[shard_of(word, shards)].append(word)
            for shard, wanted in parts.items():
                if shard in hashes:
                    made, _, offset = hashes[shard]
                    slots = made.find(wanted)
                    hit = slots >= 0
                    times = np.fromiter((often[w] for w in wanted), dtype=np.int64, count=len(wanted))
                    counts[offset + slots[hit]] += times[hit]

        # Words of a group are looked up together, some thousands at a time.
        waiting: dict[tuple[str, str], list[bytes]] = defaultdict(list)
        n_waiting = 0
        for lang, source, words in _texts(batches):
            if lang in by_lang:
                waiting[lang, source] += words
                n_waiting += len(words)
            if n_waiting > 1 << 18:
                for (lang, source), words in waiting.items():
                    yield from add(lang, source, words)
                waiting.clear()
                n_waiting = 0
        for (lang, source), words in waiting.items():
            yield from add(lang, source, words)
        yield from flush()

    return run


def _rounds(hashes: DataFrame, limits: Limits) -> list[list[tuple[str, int]]]:
    """First and last shard of each round of at most `round_bytes`, in order of (lang, shard)."""
    rounds, size = [], 0
    for row in hashes.select("lang", "shard", "size").orderBy("lang", "shard").toLocalIterator():
        shard = (row["lang"], row["shard"])
        size += row["size"]
        if not rounds or size > limits.round_bytes:
            rounds.append([shard, shard])
            size = row["size"]
        rounds[-1][1] = shard
    return rounds


def recount(docs: DataFrame, hashes: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """lang, source, slot, n: occurrences of every kept term in every group that has it."""
    spark = docs.sparkSession
    texts = _grouped(docs)
    schema = "lang string, source string, slot long, n long"
    counted = []
    for bounds in _rounds(hashes, limits):
        first, last = (F.struct(F.lit(lang).alias("lang"), F.lit(shard).cast("long").alias("shard"))
                       for lang, shard in bounds)
        rows = hashes.where(F.struct("lang", "shard").between(first, last)).collect()  # round_bytes at most
        shared = spark.sparkContext.broadcast([
            (r["lang"], r["shard"], r["shards"], r["seed"], bytes(r["displacements"]), [t.encode() for t in r["terms"]],
             r["start"]) for r in rows
        ])
        found = texts.mapInArrow(_recount(shared, limits), schema).groupBy("lang", "source", "slot").agg(F.sum("n").alias("n"))
        counted.append(stored(found, "recount"))
        shared.destroy()
    if not counted:
        return spark.createDataFrame([], schema)
    for more in counted[1:]:
        counted[0] = counted[0].unionByName(more)
    return counted[0]


def _share(count, n, v):
    """p, exactly: the quotient is taken three digits at a time, so that a language may hold
    2^63 / 1000 occurrences."""
    rest, whole, p = count + SMOOTHING, n + SMOOTHING * v, 0
    for _ in range(3):
        rest = rest * 1000
        p = p * 1000 + rest // whole
        rest = rest % whole
    return p + 1


def _share_column(count, n, v):
    """`_share` of columns."""
    whole = F.col(n) + F.col(v) * SMOOTHING
    # Decimals of 38 digits hold the product; `div` of them is exact.
    product = ((F.col(count) + SMOOTHING).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")).cast("decimal(38,0)")
    return F.call_function("div", product, whole.cast("decimal(38,0)")) + 1


def _tile(limits: Limits):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Sums of |p - q| over one tile's terms, for its sources of the first block against those of the second.

        Rows with slot -1 name a source and its N; the others its count of a term.
        """
        v, first, second = int(rows["v"].iloc[0]), int(rows["first"].iloc[0]), int(rows["second"].iloc[0])
        named = rows[rows["slot"] < 0]
        place = dict(zip(named["member"], range(len(named))))
        totals = named["n"].to_numpy()
        counts = rows[rows["slot"] >= 0]
        term_at = int(rows["tile"].iloc[0]) * limits.terms
        width = min(limits.terms, v - term_at)
        table = np.zeros((len(named), width), dtype=np.int64)
        table[counts["member"].map(place).to_numpy(dtype=np.int64), counts["slot"].to_numpy() - term_at] = counts["n"].to_numpy()
        p = _share(table, totals[:, None], v)
        members = named["member"].to_numpy()
        left, right = (np.flatnonzero(members // limits.sources == block) for block in (first, second))
        sums = np.zeros((len(left), len(right)), dtype=np.int64)
        for i, source in enumerate(left):
            sums[i] = np.abs(p[right] - p[source]).sum(axis=1)
        a, b = np.nonzero(left[:, None] != right[None, :])
        return pd.DataFrame({
            "lang": rows["lang"].iloc[0], "a": members[left[a]], "b": members[right[b]], "value": sums[a, b],
        })

    return run


def _distances(groups: DataFrame, counts: DataFrame, limits: Limits) -> DataFrame:
    """lang, a, b, value of every two different sources a, b of a language, both ways."""
    blocks = groups.groupBy("lang", "v").agg(F.floor(F.max("member") / limits.sources).alias("last"))
    own = F.floor(F.col("member") / limits.sources)
    # (first, second) of all tiles a source takes part in: its block against each, once per pair of blocks.
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda other: F.struct(
        F.least(own, other).alias("first"), F.greatest(own, other).alias("second")
    ))
    tiles = F.sequence(F.lit(0).cast("long"), F.floor((F.col("v") - 1) / limits.terms))
    columns = ["lang", "v", "tile", "member", "slot", "n", "pair.first", "pair.second"]
    named = (
        groups.join(blocks.select("lang", "last"), "lang").where("v > 0")
        .select("lang", "v", "member", F.lit(-1).cast("long").alias("slot"), "n", F.explode(tiles).alias("tile"),
                pairs.alias("pairs"))
        .withColumn("pair", F.explode("pairs")).select(*columns)
    )
    placed = (
        counts.join(blocks.select("lang", "last"), "lang")
        .select("lang", "v", "member", "slot", F.col("count").alias("n"), F.floor(F.col("slot") / limits.terms).alias("tile"),
                F.explode(pairs).alias("pair")).select(*columns)
    )
    sums = (
        named.unionByName(placed).groupBy("lang", "tile", "first", "second")
        .applyInPandas(_tile(limits), "lang string, a long, b long, value long")
    )
    # Blocks against themselves give both directions, others one.
    return sums.unionByName(
        sums.where(F.floor(F.col("a") / limits.sources) != F.floor(F.col("b") / limits.sources))
        .select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    ).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS, limits: Limits = LIMITS
) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the language's other sources (part `pair`),
    and the terms a source uses more than its language (part `term`)."""
    hashes = perfect_hashes(stored(kept_terms(docs, min_documents, limits), "kept-terms"), limits)
    counts = recount(docs, hashes, limits)
    sizes = hashes.groupBy("lang").agg(F.sum("n").alias("v"))
    occurring = stored(_grouped(docs).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows")), "groups")
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = stored(
        occurring.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").select(
            "lang", "source", numbered.cast("long").alias("member"), F.coalesce("n", F.lit(0)).cast("long").alias("n"),
            F.coalesce("v", F.lit(0)).cast("long").alias("v"),
        ), "groups",
    )
    placed = stored(counts.withColumnRenamed("n", "count").join(groups, ["lang", "source"]), "counts")

    names = groups.select("lang", "member", "source", "v")
    a, b = (names.select("lang", F.col("member").alias(x), F.col("source").alias(f"{x}_source")) for x in "ab")
    by_source = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    measured = _distances(groups, placed, limits).join(a, ["lang", "a"]).join(b, ["lang", "b"]).select(
        "lang", F.col("a_source").alias("source"), F.col("b_source").alias("item"), "value"
    )
    # Languages without kept terms: every two of their sources, at distance 0.
    bare = names.where("v = 0")
    nothing = bare.select("lang", "source").join(
        bare.select("lang", F.col("source").alias("item")), "lang"
    ).where("source != item").withColumn("value", F.lit(0).cast("long"))
    pairs = measured.unionByName(nothing).withColumn("part", F.lit("pair")).withColumn(
        "rank", F.row_number().over(by_source)
    )

    of_lang = placed.groupBy("lang", "slot").agg(F.sum("count").alias("lang_count"))
    whole = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    words = hashes.select("lang", "start", F.posexplode("terms").alias("at", "item")).select(
        "lang", (F.col("start") + F.col("at")).alias("slot"), "item"
    )
    value = _share_column("count", "n", "v") - _share_column("lang_count", "lang_n", "v")
    more = (
        placed.join(of_lang, ["lang", "slot"]).join(whole, "lang")
        .withColumn("value", value.cast("long")).where("value > 0")
        .join(words, ["lang", "slot"]).select("lang", "source", "item", "value")
    )
    top = more.withColumn("rank", F.row_number().over(by_source)).where(F.col("rank") <= top_terms)
    return pairs.unionByName(top.withColumn("part", F.lit("term")).select(*pairs.columns)).select(
        "lang", "source", "part", "item", "value", "rank"
    )
