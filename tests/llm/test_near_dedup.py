import random
import re
import string
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from conftest_data import FOLDER

from touchline.llm import near_dedup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(zip(words, words[1:], words[2:])) if len(words) > 2 else frozenset([tuple(words)] if words else [])


def brute(rows):
    """Compare all pairs of rows."""
    sets = [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    first = {}
    for i in range(len(rows)):
        first.setdefault(find(i), []).append(rows[i][0])
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in first.items()}
    return sorted((str(rows[i][0]), len(sets[i]), str(smallest[find(i)])) for i in range(len(rows)))


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = near_dedup.deduplicate(docs).collect()
    want = brute(rows)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    assert all(r.doc_id == r.component_id for r in got if r.kept)
    return got


def test_equals_all_pairs_on_the_given_documents(spark):
    check(spark.read.parquet(f"{FOLDER}/documents.parquet"))


@pytest.fixture
def family():
    """Copies of one text with a few words changed each, many below and many above the limit, and
    a chain whose ends are far apart."""
    source = random.Random(4)
    base = [f"w{source.randrange(4000)}" for _ in range(150)]
    rows = []
    for i in range(250):
        words = list(base)
        for _ in range(source.randrange(8)):
            words[source.randrange(150)] = f"z{source.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    chain = [f"c{i}" for i in range(120)]
    for i in range(30):
        rows.append((1000 + i, " ".join(chain)))
        chain = chain[3:] + [f"d{i}{j}" for j in range(3)]
    return rows


def test_dense_families_and_chains(documents, family, edge_rows):
    got = check(documents(family + edge_rows + [(2000 + i, "short text") for i in range(5)] + [(3000, "Short TEXT ")]))
    assert len({r.component_id for r in got if r.doc_id and 1000 <= r.doc_id < 1030}) == 1


def test_one_row_of_each_component_stays(documents, edge_rows):
    docs = documents(edge_rows)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in near_dedup.deduplicate(docs).collect())
    assert near_dedup.keep_one(documents([])).count() == near_dedup.deduplicate(documents([])).count() == 0


def test_width_and_limit_can_be_chosen(documents):
    words = [f"w{i}" for i in range(200)]
    longer, far = ([*words, *(f"x{i}" for i in range(n))] for n in (45, 60))
    docs = documents([(1, " ".join(words)), (2, " ".join(longer)), (3, " ".join(f"y{i}" for i in range(200)))])
    apart = documents([(1, " ".join(words)), (2, " ".join(far))])
    # 196 / 241 = 0.813 and 196 / 256 = 0.766 of the five-word shingles.
    assert sorted(r.doc_id for r in near_dedup.keep_one(docs, width=5, link=80).collect()) == [1, 3]
    assert sorted(r.doc_id for r in near_dedup.keep_one(apart, width=5, link=80).collect()) == [1, 2]
    assert near_dedup.keep_one(docs).count() == 3


def test_estimates_are_close_for_all_sizes():
    source = np.random.default_rng(8)
    for n, shared in [(20, 18), (300, 200), (5000, 4500), (5000, 50)]:
        pool = source.integers(0, 2 ** 63, 2 * n - shared).astype(np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[n - shared:])
        exact = shared / (2 * n - shared)
        got = near_dedup.estimate(
            near_dedup.registers(a)[None], near_dedup.registers(b)[None], np.array([float(n)]), np.array([float(n)])
        )[0]
        assert got == pytest.approx(exact, abs=0.16 if n < 100 else 0.13)
    unrelated = near_dedup.estimate(
        near_dedup.registers(np.unique(pool[:200]))[None], near_dedup.registers(np.unique(pool[300:500]))[None],
        np.array([200.0]), np.array([200.0]),
    )
    assert unrelated[0] < 0.06


def test_words_are_lowered_in_ascii_only():
    assert near_dedup.shingles("ABC D E".encode()).tolist() == near_dedup.shingles("abc\nd  e".encode()).tolist()
    assert near_dedup.shingles("Ä b c".encode()).tolist() != near_dedup.shingles("ä b c".encode()).tolist()


def unlinked_relatives(documents, n):
    """Texts that share half of their words as one passage, so every two are alike and none are linked."""
    source = random.Random(n)
    shared = " ".join(f"s{i}" for i in range(60))
    return documents([
        (i, f"{shared} " + " ".join(f"u{source.randrange(10**9)}" for _ in range(60))) for i in range(n)
    ])


def test_work_on_relatives_that_are_not_linked_grows_in_proportion(documents):
    made = {}
    for n in (200, 400, 800):
        docs = unlinked_relatives(documents, n)
        sketched = near_dedup.stored(near_dedup.sketches(docs), "test-sketches")
        classes = near_dedup.stored(sketched.withColumn("node", sketched["row_no"]), "test-classes")
        members = near_dedup._buckets(classes)
        made[n] = near_dedup._groups(members, classes, 85).count()
    # Twice the documents may not make much more than twice the rows.
    assert made[400] <= 3 * made[200] + 200 and made[800] <= 3 * made[400] + 200, made


def test_registers_borrow_alike_on_both_ways():
    source = np.random.default_rng(5)
    order, _ = near_dedup._lenders()
    for n in (1, 2, 30, 59, 60, 61, 90, 150, 400, 3000):
        hashes = np.unique(source.integers(0, 2**64, n, dtype=np.uint64))
        got = near_dedup.registers(hashes)
        bucket = ((hashes >> np.uint64(32)) * np.uint64(near_dedup.REGISTERS)) >> np.uint64(32)
        own = set(bucket.tolist())
        for i in range(near_dedup.REGISTERS):
            if i not in own:
                lender = next(j for j in order[i] if j in own)
                assert got[i] == got[lender]


def beside_a_larger_family(n, swapped=25):
    """Near copies of one text, and twice as many of another that is too far from it to be linked."""
    source = random.Random(n)
    first = [f"w{i}" for i in range(150)]
    second = [*first[:150 - swapped], *(f"q{i}" for i in range(swapped))]
    rows = []
    for i in range(3 * n):
        words = list(second if i < n else first)
        words[source.randrange(110)] = f"z{source.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    return rows


def inside_groups(docs):
    """What `components_of` hands to the search inside the groups."""
    sketched = near_dedup.stored(near_dedup.sketches(docs), "test-sketches")
    classes = near_dedup.stored(sketched.withColumn("node", sketched["row_no"]), "test-classes")
    members = near_dedup._buckets(classes)
    groups = near_dedup.stored(near_dedup._groups(members, classes, 85), "test-groups")
    return near_dedup.stored(near_dedup._differences(docs, classes, groups, 3, 85), "test-differences")


def test_pairs_of_a_family_that_follows_another_ones_pivot_are_not_listed(documents):
    made = {}
    for n in (100, 200):
        differences = inside_groups(documents(beside_a_larger_family(n)))
        assert differences.where("NOT linked").count() >= n
        probes, index = near_dedup._prefixes(differences, 85)
        camps = near_dedup._camps(near_dedup._crowd_links(probes, index, differences, 85), differences)
        made[n] = near_dedup._candidates(probes, index, camps, 85).count()
    assert made[100] <= 400 and made[200] <= 800, made
    check(documents(beside_a_larger_family(100)))


def test_strays_are_dealt_once_for_each_pivot(documents, monkeypatch):
    seen, deal = [], near_dedup._dealt_anew

    def watched(strays, classes, level):
        seen.append((strays.count(), strays.select("node").distinct().count()))
        return deal(strays, classes, level)

    monkeypatch.setattr(near_dedup, "_dealt_anew", watched)
    inside_groups(documents(beside_a_larger_family(40, swapped=40)))
    # A stray shares several buckets with the one pivot it is not near.
    assert seen[0][1] >= 20 and seen[0][0] <= 1.3 * seen[0][1], seen


def test_a_batch_of_pairs_is_verified_in_little_memory():
    source = np.random.default_rng(3)
    n = 10_000

    def lists():
        ends = np.arange(0, 100 * (n + 1), 100, dtype=np.int32)
        return pa.ListArray.from_arrays(ends, np.sort(source.integers(0, 1 << 60, (n, 100)), axis=1).ravel())

    a, b = lists(), lists()
    # Every third pair has equal differences; the offset of a part must not shift the lists.
    b = pa.array([x if i % 3 == 0 else y for i, (x, y) in enumerate(zip(a.to_pylist(), b.to_pylist()))], a.type)
    ids, size = pa.array(np.arange(n)), pa.array(np.full(n, 200))
    batch = pa.RecordBatch.from_arrays([ids, ids, ids, size, size, a, b], ["pivot", "a", "b", "n_a", "n_b", "d_a", "d_b"])
    tracemalloc.start()
    found = [x for part in near_dedup._verify_stream(iter([batch]), 85) for x in part.column("a").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == list(range(0, n, 3))
    assert peak < 8e6  # the elements as Python's integers would be 80 MB


def test_a_batch_of_strays_is_dealt_in_little_memory():
    n = 10_000
    values = np.random.default_rng(5).integers(0, 1 << 12, (n, near_dedup.REGISTERS)).astype("<u2")
    ids = pa.array(np.arange(n))

    class Rows:
        def join(self, *_):
            return self

        select = join

        def mapInArrow(self, run, _):
            self.run = run
            return self

    rows = Rows()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(near_dedup, "stored", lambda frame, _: frame)
        patch.setattr(near_dedup, "_shared", lambda frame, _: frame)
        near_dedup._dealt_anew(rows, rows, 1)
    batch = pa.RecordBatch.from_arrays(
        [ids, ids, pa.array([r.tobytes() for r in values], pa.binary())], ["node", "path", "registers"]
    )
    tracemalloc.start()
    n_keys = sum(part.num_rows for part in rows.run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n_keys == n * near_dedup.BANDS
    assert peak < 8e6


def around(docs, pivot):
    """Differences of all of `docs` from one of them, whatever the buckets say."""
    sketched = near_dedup.stored(near_dedup.sketches(docs), "test-sketches")
    classes = near_dedup.stored(sketched.withColumn("node", sketched["row_no"]), "test-classes")
    head = classes.where(classes["doc_id"] == pivot).select(classes["node"].alias("pivot"))
    groups = near_dedup.stored(head.crossJoin(classes.select("node")).where("node != pivot"), "test-groups")
    return classes, near_dedup.stored(near_dedup._differences(docs, classes, groups, 3, 85), "test-differences")


def scattered(n, words, seed, most=7, within=150):
    """n copies of one text, each with up to `most` words changed; the last has `most` of them changed."""
    source = random.Random(seed)
    for i in range(n):
        copy = list(words)
        for place in source.sample(range(within), source.randrange(1, most + 1) if i < n - 1 else most):
            copy[place] = f"z{source.randrange(10**9)}"
        yield " ".join(copy)


def candidates_of(differences, monkeypatch):
    """The links found inside the groups, and how many pairs were compared for them."""
    made, find = [], near_dedup._candidates

    def watched(*args):
        found = near_dedup.stored(find(*args), "test-candidates")
        made.append(found.count())
        return found

    with monkeypatch.context() as patch:
        patch.setattr(near_dedup, "_candidates", watched)
        links = near_dedup.stored(near_dedup._links_inside(differences, 85), "test-links")
    return links, made[0]


def test_a_pivot_with_oddities_does_not_make_pairs_of_its_family(documents, monkeypatch):
    made = {}
    for n in (100, 200):
        rows = list(enumerate(scattered(n, [f"w{i}" for i in range(150)], n)))
        classes, differences = around(documents(rows), n - 1)
        links, made[n] = candidates_of(differences, monkeypatch)
        ids = {r.node: r.doc_id for r in classes.select("node", "doc_id").collect()}
        root = list(range(n))

        def find(i):
            return i if root[i] == i else find(root[i])

        # The links to the pivot itself are not among those inside the group.
        every = links.unionByName(differences.where("linked").selectExpr("pivot AS a", "node AS b")).collect()
        for r in every:
            first, last = sorted((find(ids[r.a]), find(ids[r.b])))
            root[last] = first
        assert sorted((str(i), str(find(i))) for i in range(n)) == [(i, c) for i, _, c in brute(rows)]
        sets = [shingle_set(text) for _, text in rows]
        assert all(100 * len(sets[ids[r.a]] & sets[ids[r.b]]) >= 85 * len(sets[ids[r.a]] | sets[ids[r.b]]) for r in every)
    assert made[100] <= 100 and made[200] <= 200, made


def test_scattered_copies_that_follow_a_foreign_pivot_are_not_all_paired(documents, monkeypatch):
    made = {}
    first = [f"w{i}" for i in range(150)]
    second = [*first[:125], *(f"q{i}" for i in range(25))]
    for n in (100, 200):
        texts = [*scattered(n, second, n, within=110), *scattered(2 * n, first, n + 1, within=110), " ".join(first)]
        _, differences = around(documents(list(enumerate(texts))), 3 * n)
        _, made[n] = candidates_of(differences, monkeypatch)
    assert made[100] <= 1000 and made[200] <= 2.5 * made[100] + 200, made
