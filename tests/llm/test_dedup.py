import hashlib
import random
from collections import Counter, defaultdict

import pytest
import xxhash

from tesserae.llm import simhash as module
from tesserae.llm.common import LOWER, UPPER, connected_components, linked_in_buckets
from tesserae.llm.exact_dedup import RUN_ROWS, drop_exact_duplicates, exact_duplicates, levels_for
from tesserae.llm.simhash import _ball, hamming_forest, near_duplicates, segments_for, simhash, shingle_hashes

TABLE = str.maketrans(UPPER, LOWER)


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(TABLE)].append(i)
    out = []
    for i, t in rows:
        ids = groups[k := (t or "").translate(TABLE)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(k.encode()).hexdigest()))
    return Counter(out)


def brute_print(text, width):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def brute_near(rows, width, distance):
    prints = [brute_print(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return Counter((d, f"{prints[i]:016x}", min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows))


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice("abcdef") * 3
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, " ".join(rng.choice(["Un", "deux", "x", "yy", "zzz"]) + str(rng.randint(0, 50)) for _ in range(rng.randint(1, 90)))))
    return rows


def test_levels_grow_with_the_rows():
    assert [levels_for(n, 16) for n in (0, 1, RUN_ROWS * 256, RUN_ROWS * 256 + 1, RUN_ROWS * 4096 + 1)] == [2, 2, 2, 3, 4]


@pytest.mark.parametrize("levels,fan_in", [(1, 4), (2, 16), (3, 2), (None, 16)])
def test_exact_equals_brute_force(docs, awkward, levels, fan_in):
    rows = awkward + corpus()
    got = exact_duplicates(docs(rows), levels=levels, fan_in=fan_in)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == brute_exact(rows)


def test_exact_keeps_one_row_of_each_text(docs, awkward):
    left = drop_exact_duplicates(docs(awkward))
    assert left.columns == docs(awkward).columns
    texts = Counter((r.text or "").translate(TABLE) for r in left.collect())
    assert set(texts.values()) == {1} and len(texts) == len({(t or "").translate(TABLE) for _, t in awkward})
    assert exact_duplicates(docs([])).count() == 0 and drop_exact_duplicates(docs([])).count() == 0


@pytest.mark.parametrize("width,distance,segments", [(4, 4, 3), (5, 8, 4), (2, 3, 4)])
def test_near_equals_brute_force(docs, awkward, width, distance, segments):
    rows = awkward + corpus(seed=width)
    got = near_duplicates(docs(rows), width=width, distance=distance, segments=segments)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()) == brute_near(rows, width, distance)


def test_chunked_tables_lose_no_link(docs, monkeypatch):
    import tesserae.llm.simhash as m

    monkeypatch.setattr(m, "CHUNK_ROWS", 3)
    monkeypatch.setattr(m, "PAIRS_AT_ONCE", 8)
    rows = corpus(150, 9)
    got = near_duplicates(docs(rows), width=4, distance=6, segments=3)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()) == brute_near(rows, 4, 6)


def test_near_of_nothing(docs):
    assert near_duplicates(docs([])).count() == 0


def test_radii_cover_the_distance():
    for distance, count in [(4, 3), (8, 4), (3, 4), (10, 2)]:
        plan = segments_for(distance, count)
        assert sum(b for _, b, _ in plan) == 64 and sum(r + 1 for _, _, r in plan) == distance + 1
    assert len(_ball(5, 2)) == 16 and simhash(shingle_hashes("", 4)) == 0


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(5, 5), (3, 200)]
    got = {r.id: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{x: 3 for x in [3, 7, *range(200, 260)]}}


@pytest.mark.parametrize("distance,segments", [(4, 3), (5, 2)])
def test_overfull_routes(spark, monkeypatch, distance, segments):
    # prints that agree in the leading bits of every segment, or in all of one, with tables of a few rows: dealt again, then cut into chunks
    monkeypatch.setattr(module, "TABLE_ROWS", 4)
    monkeypatch.setattr(module, "CHUNK_ROWS", 8)
    rng = random.Random(distance)
    plan = segments_for(distance, segments)
    loose = sum(((1 << max(3, bits - 9)) - 1) << shift for shift, bits, _ in plan)
    prints = {rng.getrandbits(64) & loose for _ in range(150)} | {rng.getrandbits(64) & ~((1 << plan[0][1]) - 1) for _ in range(60)}
    prints |= {p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, distance + 1))) for p in rng.sample(sorted(prints), 80)}
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    links = hamming_forest(spark.createDataFrame([(p,) for p in prints], "fp long"), distance=distance, segments=segments).collect()
    assert links and all(0 < ((r.a ^ r.b) & (1 << 64) - 1).bit_count() == r.bits <= distance for r in links)

    def groups(pairs):
        root = {p: p for p in prints}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        least = {}
        for p in prints:
            least.setdefault(find(p), p)
        return [least[find(p)] for p in prints]

    near = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance]
    assert groups((r.a, r.b) for r in links) == groups(near)


def test_lone_links_of_a_crowded_bucket(spark):
    # one bucket of 2,000 that share no other: each link has a token of its own, beside those that all ids have
    links = {(100 * k + 57, 100 * k + 3) for k in range(20)}
    mine = {i: [10 * i + 1, 10 * i + 2] for i in range(2000)}
    for u, v in links:
        mine[u] = [10 * v + 1, 10 * u + 2]
    given = spark.createDataFrame([(i, [-1, -2, *t], 3, 1.0) for i, t in mine.items()], "id long, tokens array<bigint>, need int, share double")
    true = spark.createDataFrame(sorted(links), "u long, v long")

    def verifier(ids):
        return (lambda pairs: pairs.join(true, ["u", "v"])), (lambda some: given.join(some, "id", "left_semi"))

    got = linked_in_buckets(spark.createDataFrame([(7, i) for i in mine], "bucket long, id long"), verifier).collect()
    assert {(r.id, r.root) for r in got} == {(i, v) for u, v in links for i in (u, v)}


def test_a_crowd_that_shares_too_little_is_not_dealt(spark):
    # 2,000 ids meet by a common token, behind which too few are left for any two; the links have a token of their own
    links = {(100 * k + 57, 100 * k + 3) for k in range(20)}
    mine = {i: [10 * i + 1, 10 * i + 2] for i in range(2000)}
    for u, v in links:
        mine[u] = [10 * v + 1, 10 * u + 2]
    given = spark.createDataFrame([(i, [-1, -2, *t], 3, 1.5) for i, t in mine.items()], "id long, tokens array<bigint>, need int, share double")
    true = spark.createDataFrame(sorted(links), "u long, v long")

    asked = []

    def verifier(ids):
        return (lambda pairs: asked.append(pairs.count()) or pairs.join(true, ["u", "v"])), (lambda some: given.join(some, "id", "left_semi"))

    store = spark._jsparkSession.sharedState().statusStore()
    done = store.executionsCount()
    got = linked_in_buckets(spark.createDataFrame([(7, i) for i in mine], "bucket long, id long"), verifier).collect()
    assert {(r.id, r.root) for r in got} == {(i, v) for u, v in links for i in (u, v)}
    made, runs = [], store.executionsList()
    for run in (runs.apply(i).executionId() for i in range(max(0, runs.size() - (store.executionsCount() - done)), runs.size())):
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if node.name() == "Generate":
                told = [node.metrics().apply(i) for i in range(node.metrics().size())]
                made += [int(values.apply(m.accumulatorId()).replace(",", "")) for m in told if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
    # four tokens of each are the most
    assert made and max(made) <= 4 * len(mine)
    # after the bucket's first, only pairs that share enough tokens are verified
    assert asked[0] == len(mine) - 1 and sum(asked[1:]) == len(links)


def test_links_of_a_hot_bucket_take_few_steps(spark, monkeypatch):
    # star components need no round, and a bucket of most rows costs no join that the other buckets' rows go through besides
    import tesserae.llm.common as m

    written = []
    plain = m.stage
    monkeypatch.setattr(m, "stage", lambda df, name: written.append(name) or plain(df, name))
    got = connected_components(spark.createDataFrame([(i, i - i % 10) for i in range(100)], "a long, b long")).collect()
    assert {r.id: r.root for r in got} == {i: i - i % 10 for i in range(100)} and written == ["cc"]
    links = {(100 * k + 57, 100 * k + 3) for k in range(20)}
    mine = {i: [10 * i + 1, 10 * i + 2] for i in range(2000)}
    for u, v in links:
        mine[u] = [10 * v + 1, 10 * u + 2]
    given = spark.createDataFrame([(i, [-1, -2, *t], 3, 1.0) for i, t in mine.items()], "id long, tokens array<bigint>, need int, share double")
    true = spark.createDataFrame(sorted(links), "u long, v long")
    written.clear()
    buckets = spark.createDataFrame([(7, i) for i in mine] + [(i, i) for i in range(100, 2000)], "bucket long, id long")
    store = spark._jsparkSession.sharedState().statusStore()
    done = store.executionsCount()
    linked = linked_in_buckets(buckets, lambda ids: ((lambda pairs: pairs.join(true, ["u", "v"])), (lambda some: given.join(some, "id", "left_semi"))))
    runs = store.executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(max(0, runs.size() - (store.executionsCount() - done)), runs.size())]
    assert {(r.id, r.root) for r in linked.collect()} == {(i, v) for u, v in links for i in (u, v)}
    assert len(written) <= 34 and not any("LeftAnti" in p for p in plans)


def test_first_of_a_token_meets_only_what_can_share_enough(spark, monkeypatch):
    # all ids have a common token last, behind which none is left: it makes no pair whose tokens are counted
    import tesserae.llm.common as m

    mine = {i: [10 * i + 1, 10 * i + 2] for i in range(300)}
    mine[57] = [31, 572]
    given = spark.createDataFrame([(i, [-1, *t], 3, 1.0) for i, t in mine.items()], "id long, tokens array<bigint>, need int, share double")
    true = spark.createDataFrame([(57, 3)], "u long, v long")
    counted = []
    plain = m.sharing
    monkeypatch.setattr(m, "sharing", lambda pairs, sets: counted.append(pairs.count()) or plain(pairs, sets))
    got = linked_in_buckets(spark.createDataFrame([(7, i) for i in mine], "bucket long, id long"), lambda ids: ((lambda pairs: pairs.join(true, ["u", "v"])), (lambda some: given.join(some, "id", "left_semi")))).collect()
    assert {(r.id, r.root) for r in got} == {(3, 3), (57, 3)} and counted[0] == 1
