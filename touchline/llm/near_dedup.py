"""Near-duplicates by HyperMinHash, every link confirmed on the full sets.

1. Each text becomes its set of hashed shingles of `width` words. One pass gives `REGISTERS` registers:
   the smallest hash of each bucket, kept as a count of leading zeros and `MANTISSA` bits
   after the leading one; empty buckets borrow from others along a fixed random order.
   Rows with equal sets form one class; from here on only one row per class takes part.
2. `BANDS` bands of `ROWS` registers are hashed; classes that share a band form a bucket.
   Similarity 0.85 is missed by all 40 bands with a probability below 1e-8, 0.8 with one
   below 1e-5.
3. Every class finds a home: the most central class (most company over all bands) that is
   estimated `NEAR` to it, tried bucket by bucket and, as homes have homes, again for a few
   rounds. Estimates are corrected for register collisions.
4. The pivot of a bucket is the most central home of its members, mostly that of all of them,
   so a family of thousands has one pivot however many buckets it fills. Members within
   `far` of the pivot follow it. Those not near it are dealt to buckets anew, once for each
   pivot however many buckets they share with it, by bands of the registers in another order:
   linked sets meet again, while of unrelated ones, which share a band because they share a
   passage, few do. That repeats until no bucket is left; in each, those at home with the
   pivot are settled.
5. Each follower's full set is compared with its pivot's: that confirms or refutes their link
   and leaves the difference of the two sets. Where some are not linked, the differences are
   turned to those from the group's centre, the member that differs least from the others on
   average. Two members that are not both linked to the centre can only be linked if their
   differences overlap by an amount that their sizes tell; a prefix join on the differences,
   the group's rarest elements first, finds those pairs without listing the pairs of a group,
   and each is confirmed on the full differences. A family that
   follows the pivot of another one differs from it in the same elements throughout: holders
   of an element that more than `CROWD` have are first compared with the most central of them,
   and two that are linked to the same one are no pair.
6. Components of the confirmed links, and one row per input row again.

Large groups are salted: a group is dealt to tasks in shares of `SHARE` members, each with a
copy of the pivot. Copies of one text are one class throughout, so a group of thousands
costs no more than one aggregation. What is emitted before the prefix join is a row per class
and band, and per stray, pivot and band, never a pair of members.

Defined results: words are maximal runs of non-white-space, A-Z lower-cased; texts of fewer
than `width` words are one shingle; null and empty texts have none and are linked to nothing;
a component is named by its smallest doc_id (null after all others); of rows with the same
doc_id and text exactly one stays (`common.first_row`); other columns pass through `keep_one` unchanged; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import first_row, in_parts, stored, whole_text
from touchline.llm.graph import components

BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Words of a shingle, and the limit. Linked means 100 * intersection >= link * union; the
#: symmetric difference of two linked sets is then at most (100 - link) / (100 + link) of the
#: sum of their sizes. These are the query's; callers choose others.
WIDTH, LINK = 3, 85
#: Members estimated below NEAR to a pivot try further ones.
NEAR = 0.6


def far(link: int) -> float:
    """Below this estimate a member cannot be linked to one that is near the pivot.

    Linked sets are at most (100 - link) / 100 further from it, and their two estimates differ in
    the registers they do not share only: 0.13 is more than four standard deviations.
    """
    return NEAR - (100 - link) / 100 - 0.13


#: Rounds in which classes look for a more central home; fewer only mean more pivots.
HOME_ROUNDS = 4
SHARE = 64
#: Elements with more holders in a group are crowded; each holder is compared with so many heads.
CROWD, HEADS = 32, 2

_SKETCH = "row_no long, doc_id long, text_hash long, n_shingles long, digest binary, registers binary"


# --- sets and registers ------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of `width` words."""
    words = text.lower().split()  # of bytes: A-Z and the six white space characters only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))
    n = len(h) - width + 1
    return np.unique(_mix(reduce(lambda mixed, i: _mix(mixed) + h[i:n + i], range(1, width), h[:n])))


@lru_cache(maxsize=1)
def _lenders() -> tuple[np.ndarray, np.ndarray]:
    """For each register, the order in which it asks the others when its bucket is empty, and the
    place of every other in that order."""
    random = np.random.default_rng(20)
    order = np.stack([random.permutation(REGISTERS) for _ in range(REGISTERS)])
    return order, np.argsort(order, axis=1)


def registers(hashes: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of each bucket's smallest hash, as uint16."""
    if not len(hashes):
        return np.zeros(REGISTERS, dtype="<u2")
    bucket = ((hashes >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(bucket, prepend=np.uint64(REGISTERS + 1)))
    smallest = np.minimum.reduceat(hashes & np.uint64(0xFFFFFFFF), first)
    fraction, exponent = np.frexp(smallest.astype(np.float64))
    zeros = np.minimum(32 - exponent, 32)
    mantissa = np.where(smallest > 0, (2 * fraction - 1) * (1 << MANTISSA), 0).astype(np.int64)
    found = np.zeros(REGISTERS, dtype="<u2")
    full = np.zeros(REGISTERS, dtype=bool)
    at = bucket[first].astype(np.int64)
    found[at] = zeros * (1 << MANTISSA) + mantissa
    full[at] = True
    if len(at) <= REGISTERS // 4:
        order, places = _lenders()
        found = np.where(full, found, found[at[places[:, at].argmin(axis=1)]])
    elif len(at) < REGISTERS:
        order, places = _lenders()
        given, asking, asked = found.copy(), np.flatnonzero(~full), 0
        while len(asking):
            lender = order[asking, asked]
            lends = full[lender]
            given[asking[lends]] = found[lender[lends]]
            asking, asked = asking[~lends], asked + 1
        found = given
    return found


def _chance(load_a: np.ndarray, load_b: np.ndarray) -> np.ndarray:
    """Probability that registers of unrelated sets agree, given the hashes per bucket."""
    tail = 2.0 ** -np.arange(33)

    def zeros(load: np.ndarray) -> np.ndarray:
        at_least = 1 - (1 - tail[None, :]) ** np.maximum(load, 1)[:, None]
        at_least[:, 0] = 1
        return at_least[:, :-1] - at_least[:, 1:]

    return (zeros(load_a) * zeros(load_b)).sum(axis=1) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard similarity of rows of registers."""
    agree = (a == b).mean(axis=1)
    chance = _chance(n_a / REGISTERS, n_b / REGISTERS)
    return np.clip((agree - chance) / (1 - chance), 0, 1)


def _sketch_stream(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _SKETCH.split(", ")]
    for batch in in_parts(batches):
        sizes, digests, rows = [], [], []
        for text in batch.column("text").cast(pa.binary()):
            hashes = shingles(text.as_py() or b"", width)
            sizes.append(len(hashes))
            digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
            rows.append(registers(hashes).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row_no"), batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()),
             pa.array(digests, pa.binary()), pa.array(rows, pa.binary())],
            names,
        )


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Identity, set size, set digest and registers of every row. Store it: row numbers are only
    stable once written."""
    return docs.select(
        F.monotonically_increasing_id().alias("row_no"), F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"), whole_text().alias("text"),
    ).mapInArrow(partial(_sketch_stream, width=width), _SKETCH)


# --- buckets and pivots ------------------------------------------------------


def _shared(keys: DataFrame, label: str) -> DataFrame:
    """key, size, node of the keys that several nodes have."""
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return stored(keys.join(sizes, "key"), label)


def _buckets(classes: DataFrame) -> DataFrame:
    """key, size, node of the classes that share a band with another class. `path` is for strays."""
    width = 2 * ROWS
    keys = [F.xxhash64(F.lit(b), F.substring("registers", b * width + 1, width)) for b in range(BANDS)]
    exploded = classes.select("node", F.explode(F.array(*keys)).alias("key"))
    return _shared(exploded, "band-members").withColumn("path", F.lit(0).cast("long"))


def _dealt_anew(strays: DataFrame, classes: DataFrame, level: int) -> DataFrame:
    """Strays of a `path`, the pivots they are not near, in buckets inside it, by bands of the registers in the
    level's own order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.random.default_rng(level).permutation(REGISTERS)
        for batch in in_parts(batches):
            rows = np.frombuffer(b"".join(batch.column("registers").to_pylist()), "<u2").reshape(-1, REGISTERS)
            bands = rows[:, order].reshape(-1, BANDS, ROWS).astype(np.uint64)
            path = batch.column("path").to_numpy()
            mixed = path.view(np.uint64)[:, None] + np.arange(BANDS, dtype=np.uint64)
            for i in range(ROWS):
                mixed = _mix(mixed) + bands[:, :, i]
            yield pa.RecordBatch.from_arrays(
                [pa.array(_mix(mixed).ravel().view(np.int64)), pa.array(np.repeat(path, BANDS)),
                 pa.array(np.repeat(batch.column("node").to_numpy(), BANDS))],
                ["key", "path", "node"],
            )

    registers_of = classes.select("node", "registers")
    dealt = strays.join(registers_of, "node").mapInArrow(run, "key long, path long, node long")
    # Stored: it is read for the sizes and for the members.
    return _shared(stored(dealt, "stray-keys"), "strays")


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """node, pivot, similarity as the registers tell it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS)
                for c in ("registers_a", "registers_b")
            )
            n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("pivot"), pa.array(estimate(a, b, n_a, n_b), pa.float64())],
                ["node", "pivot", "similarity"],
            )

    a = classes.select("node", F.col("registers").alias("registers_a"), F.col("n_shingles").alias("n_a"))
    b = classes.select(
        F.col("node").alias("pivot"), F.col("registers").alias("registers_b"), F.col("n_shingles").alias("n_b")
    )
    return pairs.join(a, "node").join(b, "pivot").mapInArrow(run, "node long, pivot long, similarity double")


def _pivots(members: DataFrame, homes: DataFrame) -> DataFrame:
    """key, node, and the bucket's pivot with its weight: the most central home of the members."""
    best = members.join(homes, "node").groupBy("key").agg(
        F.max(F.struct("weight", (-F.col("home")).alias("minus"))).alias("best")
    )
    return members.select("key", "path", "node").join(best, "key").select(
        "key", "path", "node", (-F.col("best.minus")).alias("pivot"), F.col("best.weight").alias("weight")
    )


def _homes(members: DataFrame, classes: DataFrame) -> DataFrame:
    """node, home, weight: the most central class found near each, itself if there is none."""
    homes = stored(
        members.groupBy("node").agg(F.sum("size").alias("weight")).withColumn("home", F.col("node")), "homes"
    )
    for _ in range(HOME_ROUNDS):
        tried = _pivots(members, homes).select("node", "pivot", F.col("weight").alias("pivot_weight")).distinct()
        more_central = F.struct("pivot_weight", -F.col("pivot")) > F.struct("weight", -F.col("home"))
        pairs = stored(tried.join(homes, "node").where(more_central).select("node", "pivot", "pivot_weight"), "homes-tried")
        near = _estimated(pairs.select("node", "pivot"), classes).where(F.col("similarity") >= NEAR)
        found = pairs.join(near, ["node", "pivot"]).groupBy("node").agg(
            F.max(F.struct("pivot_weight", (-F.col("pivot")).alias("minus"))).alias("best")
        )
        moved = stored(found, "homes-found")
        if moved.isEmpty():
            break
        homes = stored(homes.join(moved, "node", "left").select(
            "node", F.coalesce("best.pivot_weight", "weight").alias("weight"),
            F.coalesce(-F.col("best.minus"), F.col("home")).alias("home"),
        ), "homes")
    return homes


def _groups(members: DataFrame, classes: DataFrame, link: int) -> DataFrame:
    """pivot, node: the followers of each pivot. Any two linked classes are in a group together, or
    one of them is the other's pivot."""
    homes = _homes(members, classes)
    found, level = [], 0
    while True:
        dealt = stored(_pivots(members, homes).select("path", "node", "pivot").distinct(), "followers")
        pairs = dealt.where("node != pivot").select("node", "pivot").distinct()
        estimates = stored(_estimated(pairs, classes), "estimates")
        found.append(estimates.where(F.col("similarity") >= far(link)).select("pivot", "node"))
        strays = dealt.where("node != pivot").join(
            estimates.where(F.col("similarity") < NEAR), ["node", "pivot"], "left_semi"
        ).select(F.xxhash64("path", "pivot").alias("path"), "node")
        level += 1
        members = _dealt_anew(strays, classes, level)
        if members.isEmpty():
            return reduce(DataFrame.unionByName, found).distinct()


# --- full sets ---------------------------------------------------------------


def linked(sizes: int | np.ndarray, difference: int | np.ndarray, link: int = LINK) -> bool | np.ndarray:
    """Whether sets of these summed sizes and this symmetric difference are linked, in integers."""
    return (100 + link) * difference <= (100 - link) * sizes


_DIFFERENCE = "pivot long, share long, node long, n long, n_pivot long, linked boolean, difference array<long>"


def _difference_stream(batches: Iterator[pa.RecordBatch], width: int, link: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (pivot, share), the pivot's own first in each."""
    pivot, at = np.zeros(0, np.uint64), None
    names = [c.split()[0] for c in _DIFFERENCE.split(", ")]
    for batch in in_parts(batches):
        out = [[] for _ in names]
        lists = []
        for p, share, node, is_pivot, text in zip(
            *(batch.column(c).to_pylist() for c in ("pivot", "share", "node", "is_pivot")),
            batch.column("text").cast(pa.binary()),
        ):
            own = shingles(text.as_py() or b"", width)
            if is_pivot:
                pivot, at = own, (p, share)
                continue
            if at != (p, share):
                raise ValueError("a member came before its pivot")
            added = np.setdiff1d(own, pivot, assume_unique=True)
            missing = np.setdiff1d(pivot, own, assume_unique=True)
            size = len(added) + len(missing)
            for column, value in zip(out, (p, share, node, len(own), len(pivot), bool(linked(len(own) + len(pivot), size, link)))):
                column.append(value)
            lists.append(np.concatenate([added, missing]).view(np.int64))
        offsets = np.cumsum([0, *map(len, lists)]).astype(np.int32)
        values = np.concatenate([np.zeros(0, np.int64), *lists])
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in out[:5]), pa.array(out[5], pa.bool_()),
             pa.ListArray.from_arrays(offsets, values)],
            names,
        )


def _differences(docs: DataFrame, classes: DataFrame, groups: DataFrame, width: int, link: int) -> DataFrame:
    """Each member's set against its pivot's, which is the group's centre until `_centred` finds a better one."""
    shares = groups.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))
    members = groups.join(shares, "pivot").select(
        "pivot", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int").alias("share"), "node",
        F.lit(False).alias("is_pivot"),
    )
    pivots = shares.select(
        "pivot", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("pivot").alias("node"),
        F.lit(True).alias("is_pivot"),
    )
    named = classes.select("node", F.struct("doc_id", "text_hash").alias("identity"))
    wanted = stored(members.unionByName(pivots).join(named, "node"), "wanted-texts")
    texts = docs.select(
        F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")).alias("identity"),
        whole_text().alias("text"),
    )
    return (
        texts.join(wanted.hint("merge"), "identity")
        .select("pivot", "share", "node", "is_pivot", "text")
        .repartition("pivot", "share")
        .sortWithinPartitions("pivot", "share", F.col("is_pivot").desc())
        .mapInArrow(partial(_difference_stream, width=width, link=link), _DIFFERENCE)
        .withColumn("centre", F.col("pivot"))
    )


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The lists of a column as views of its elements: as Python's integers they take five times the memory."""
    elements, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return (elements[first:end] for first, end in zip(ends, ends[1:]))


def _verify_stream(batches: Iterator[pa.RecordBatch], link: int) -> Iterator[pa.RecordBatch]:
    for batch in in_parts(batches):
        n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
        both = np.array([
            len(np.setxor1d(a, b, assume_unique=True)) for a, b in zip(_lists(batch.column("d_a")), _lists(batch.column("d_b")))
        ], dtype=np.int64)
        keep = pa.array(linked(n, both, link), pa.bool_())
        names = ["pivot", "a", "b"]
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in names], names)


def _verified(pairs: DataFrame, differences: DataFrame, link: int) -> DataFrame:
    """Of the pairs (pivot, a, b) those that are linked, by their differences from the pivot."""
    def side(name: str) -> DataFrame:
        return differences.select(
            "pivot", F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("difference").alias(f"d_{name}")
        )

    return pairs.join(side("a"), ["pivot", "a"]).join(side("b"), ["pivot", "b"]).select(
        "pivot", "a", "b", "n_a", "n_b", "d_a", "d_b"
    ).mapInArrow(partial(_verify_stream, link=link), "pivot long, a long, b long")


def _with_outsiders(differences: DataFrame) -> DataFrame:
    """The rows of groups that have members not linked to their centre."""
    outside = differences.where(~F.col("linked")).select("pivot").distinct()
    # Met share by share, so that a large group is not gathered.
    shares = differences.select("pivot", "share").distinct().join(outside, "pivot")
    return differences.join(shares, ["pivot", "share"], "left_semi")


def _company(rows: DataFrame) -> DataFrame:
    """pivot, node, shared: (holders in the group, element) of the elements of a member's difference that others of
    the group hold too, the rarest first. Counted share by share, so that an element of all members is no hot key."""
    held = stored(rows.select("pivot", "share", "node", F.explode("difference").alias("element")), "elements")
    in_share = stored(held.groupBy("pivot", "share", "element").agg(F.count(F.lit(1)).alias("holders")), "elements-of-shares")
    sizes = in_share.groupBy("pivot", "element").agg(F.sum("holders").alias("size")).where("size > 1")
    shared = in_share.join(sizes, ["pivot", "element"]).select("pivot", "share", "element", "size")
    return held.join(shared, ["pivot", "share", "element"]).groupBy("pivot", "node").agg(
        F.sort_array(F.collect_list(F.struct("size", "element"))).alias("shared")
    )


def _centred(differences: DataFrame, link: int) -> DataFrame:
    """The differences, in groups with members not linked to the pivot, from the group's most central member.

    That is the one whose difference from the others is smallest on average: an element of its own
    costs it one for each member that lacks it and saves one for each that holds it. A pivot
    with oddities of its own would leave most of its family not linked to it, though linked to
    each other. The pivot becomes a member like the others, and the centre is none any more.
    """
    differences = differences.drop("centre")
    rows = _with_outsiders(differences)
    members = rows.groupBy("pivot").agg((F.count(F.lit(1)) + 1).alias("members"))
    # Of elements that it holds alone a member has as many as are not shared.
    held = F.aggregate("shared", F.lit(0).cast("long"), lambda total, x: total + x["size"])
    saved = 2 * (held + F.size("difference") - F.size("shared")) - F.col("members") * F.size("difference")
    scored = _company(rows).join(rows.select("pivot", "node", "difference"), ["pivot", "node"]).join(
        members, "pivot"
    ).select("pivot", "node", saved.alias("saved"))
    centres = scored.groupBy("pivot").agg(F.max(F.struct("saved", (-F.col("node")).alias("minus"))).alias("best")).where(
        "best.saved > 0"
    ).select("pivot", (-F.col("best.minus")).alias("node"))
    centres = stored(differences.join(centres, ["pivot", "node"]).select(
        "pivot", F.col("node").alias("centre"), F.col("n").alias("n_centre"), "n_pivot", "linked",
        F.col("difference").alias("d_centre"),
    ), "centres")
    shares = differences.select("pivot", "share").distinct().join(
        centres.select("pivot", "centre", "n_centre", "d_centre"), "pivot"
    )
    moved = F.col("centre").isNotNull()
    difference = F.concat(F.array_except("difference", "d_centre"), F.array_except("d_centre", "difference"))
    others = differences.join(shares, ["pivot", "share"], "left").select(
        "pivot", "share", F.coalesce("centre", "pivot").alias("centre"), "node", "n",
        F.coalesce("n_centre", "n_pivot").alias("n_pivot"), "linked", moved.alias("moved"),
        F.when(moved, difference).otherwise(F.col("difference")).alias("difference"),
    ).where("node != centre").withColumn("linked", F.when(
        F.col("moved"), linked(F.col("n") + F.col("n_pivot"), F.size("difference"), link)
    ).otherwise(F.col("linked"))).drop("moved")
    pivots = centres.select(
        "pivot", F.lit(0).cast("long").alias("share"), "centre", F.col("pivot").alias("node"), F.col("n_pivot").alias("n"),
        F.col("n_centre").alias("n_pivot"), "linked", F.col("d_centre").alias("difference"),
    )
    return others.unionByName(pivots)


def _prefixes(differences: DataFrame, link: int) -> tuple[DataFrame, DataFrame]:
    """The elements by which members not linked to the centre look for others, and those by which all are found.

    Sets with sizes a and b and differences x and y from the centre (size p) are linked if
    x + y - 2 * overlap <= r * (a + b). One of the two is not linked to the centre, so the
    overlap is at least 1, and at least half of y - r * (b - p) for the other one.

    Rarest elements come first, so what a whole family shares is in few prefixes; elements that one
    member holds alone are counted, but nobody is found by them.
    """
    r = (100 - link) / (100 + link)
    rows = _with_outsiders(differences).withColumn("size", F.size("difference"))
    rows = stored(
        rows.select("pivot", "node", "linked", "n", "n_pivot", "size").join(_company(rows), ["pivot", "node"]), "rarest-first"
    )
    alone = F.col("size") - F.size("shared")
    index_overlap = F.greatest(F.ceil((F.col("size") - r * (F.col("n") - F.col("n_pivot"))) / 2 - 1e-6), F.lit(1))
    probe_overlap = F.greatest(F.ceil((F.col("size") - r * (F.col("n") + F.col("n_pivot"))) / 2 - 1e-6), F.lit(1))

    def prefix(frame: DataFrame, overlap) -> DataFrame:
        length = (F.col("size") - overlap + 1 - alone).cast("int")
        return frame.where(length > 0).select(
            "pivot", "node", "linked", "n", "size", alone.alias("alone"),
            F.posexplode(F.slice("shared.element", 1, length)).alias("pos", "element"),
        ).withColumn("pos", F.col("pos") + F.col("alone")).drop("alone")

    return prefix(rows.where(~F.col("linked")), probe_overlap), prefix(rows, index_overlap)


def _crowd_links(probes: DataFrame, index: DataFrame, differences: DataFrame, link: int) -> DataFrame:
    """pivot, a, b, weight: the heads of crowded elements that a member is linked to, and how central they are."""
    element = ["pivot", "element"]
    held = probes.select(*element, "node").unionByName(index.select(*element, "node")).distinct()
    sizes = held.groupBy(*element).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > CROWD)
    crowded = stored(held.join(sizes, element), "crowded-elements")
    weights = crowded.groupBy("pivot", "node").agg(F.sum("size").alias("weight"))
    heads = crowded.join(weights, ["pivot", "node"]).groupBy(*element).agg(
        F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("best")
    )
    votes = crowded.join(heads, element).select(
        "pivot", F.col("node").alias("a"), (-F.col("best.minus")).alias("b"), F.col("best.weight").alias("weight")
    ).where("a != b").groupBy("pivot", "a", "b").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("votes"))
    most = F.sort_array(F.collect_list(F.struct("votes", "weight", (-F.col("b")).alias("minus"))), asc=False)
    tested = stored(
        votes.groupBy("pivot", "a").agg(F.slice(most, 1, HEADS).alias("heads"))
        .select("pivot", "a", F.explode("heads").alias("head"))
        .select("pivot", "a", (-F.col("head.minus")).alias("b"), F.col("head.weight").alias("weight")),
        "crowds-tested",
    )
    return _verified(tested.select("pivot", "a", "b"), differences, link).join(tested, ["pivot", "a", "b"])


def _camps(crowd_links: DataFrame, differences: DataFrame) -> DataFrame:
    """pivot, node, camp of members linked to the centre or to a head: the centre, or the head or what that is linked to."""
    best = F.max(F.struct("weight", (-F.col("b")).alias("minus"))).alias("best")
    camps = differences.where("linked").select("pivot", "node", F.col("centre").alias("camp")).unionByName(
        crowd_links.join(
            differences.where("linked").select("pivot", F.col("node").alias("a")), ["pivot", "a"], "left_anti"
        ).groupBy("pivot", F.col("a").alias("node")).agg(best).select("pivot", "node", (-F.col("best.minus")).alias("camp"))
    )
    beyond = camps.select("pivot", F.col("node").alias("camp"), F.col("camp").alias("beyond"))
    # Two heads may be each other's; they have no camp beyond.
    return camps.join(beyond, ["pivot", "camp"], "left").select(
        "pivot", "node", F.when(F.col("beyond") == F.col("node"), F.least("node", "camp"))
        .otherwise(F.coalesce("beyond", "camp")).alias("camp"),
    )


def _candidates(probes: DataFrame, index: DataFrame, camps: DataFrame, link: int) -> DataFrame:
    """pivot, a, b: pairs that may be linked and are not known to be in one camp."""
    def camped(rows: DataFrame) -> DataFrame:
        return rows.join(camps, ["pivot", "node"], "left").withColumn("camp", F.coalesce("camp", "node"))

    def side(rows: DataFrame, suffix: str) -> DataFrame:
        return camped(rows).drop("linked").withColumnsRenamed({
            c: f"{c}_{suffix}" for c in ("node", "n", "size", "pos", "camp")
        })

    allowed = F.floor((100 - link) * (F.col("n_a") + F.col("n_b")) / (100 + link))
    overlap = F.ceil((F.col("size_a") + F.col("size_b") - allowed) / 2)
    return side(probes, "a").join(side(index, "b"), ["pivot", "element"]).where(
        (F.col("node_a") != F.col("node_b")) & (F.col("camp_a") != F.col("camp_b"))
        & (F.col("pos_a") <= F.col("size_a") - overlap) & (F.col("pos_b") <= F.col("size_b") - overlap)
    ).select("pivot", F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _links_inside(differences: DataFrame, link: int) -> DataFrame:
    """Links between members of a group of which not both are linked to the pivot: enough of them to
    connect what the links connect."""
    differences = stored(_centred(differences, link), "differences-from-centres")
    probes, index = (stored(x, "prefixes") for x in _prefixes(differences, link))
    crowd_links = stored(_crowd_links(probes, index, differences, link), "crowd-links")
    pairs = _candidates(probes, index, stored(_camps(crowd_links, differences), "camps"), link)
    central = differences.where("linked").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    return crowd_links.unionByName(_verified(pairs, differences, link), allowMissingColumns=True).select("a", "b").unionByName(central)


# --- the whole ---------------------------------------------------------------


def components_of(docs: DataFrame, width: int = WIDTH, link: int = LINK) -> DataFrame:
    """row_no, doc_id, text_hash, n_shingles, and `head` (unknown, doc_id, row_no), the first row of
    the component, of every row."""
    sketched = stored(sketches(docs, width), "sketches")
    classes = stored(
        sketched.where("n_shingles > 0").groupBy("digest").agg(
            F.min(F.struct("row_no", "doc_id", "text_hash", "n_shingles", "registers")).alias("r")
        ).select("digest", F.col("r.row_no").alias("node"), "r.*"),
        "set-classes",
    )
    members = _buckets(classes)
    # Only classes with company take part in what follows.
    company = stored(classes.join(members.select("node").distinct(), "node", "left_semi"), "classes-with-company")
    groups = stored(_groups(members, company, link), "pivot-groups")
    differences = stored(_differences(docs, company, groups, width, link), "differences")
    links = differences.where("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b")).unionByName(
        _links_inside(differences, link)
    )
    roots = components(links)
    rows = stored(
        sketched.join(classes.select("digest", "node"), "digest", "left")
        .join(roots, "node", "left")
        .select(
            "row_no", "doc_id", "text_hash", "n_shingles",
            F.when(F.col("n_shingles") > 0, F.coalesce("root", "node")).otherwise(F.col("row_no")).alias("root"),
        ),
        "component-rows",
    )
    heads = stored(
        rows.groupBy("root").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_no")).alias("head")
        ),
        "component-heads",
    )
    return rows.join(heads, "root").drop("root")


def deduplicate(docs: DataFrame, width: int = WIDTH, link: int = LINK) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    return components_of(docs, width, link).select(
        "doc_id", "n_shingles", F.col("head.doc_id").alias("component_id"),
        (F.col("row_no") == F.col("head.row_no")).alias("kept"),
    )


def keep_one(docs: DataFrame, width: int = WIDTH, link: int = LINK) -> DataFrame:
    """The first row of each component, all its columns as they were."""
    kept = components_of(docs, width, link).where(F.col("row_no") == F.col("head.row_no")).select(
        F.struct("doc_id", "text_hash").alias("identity")
    )
    rows = docs.select(
        F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")).alias("identity"),
        F.struct("*").alias("row"),
    )
    # Rows equal in identifier and text are there more than once, side by side.
    return rows.join(kept, "identity", "left_semi").groupBy("identity").agg(first_row(docs).alias("row")).select("row.*")
