import random
from collections import Counter

import pytest

from tesserae.llm.common import LOWER, UPPER
from tesserae.llm.quality import text_statistics
from tesserae.llm.queries import PIECES
from tesserae.llm.sentencepiece_codec import load_model
from tesserae.llm.simhash import drop_near_duplicates, shingle_hashes, similar_groups, simhash

pipeline = pytest.importorskip("corpus_pipeline")
TABLE = str.maketrans(UPPER, LOWER)


def near(a, b, width=5, distance=6, similarity=0.8):
    x, y = shingle_hashes(a, width), shingle_hashes(b, width)
    s, t = set(x.tolist()), set(y.tolist())
    far = ((simhash(x) ^ simhash(y)) & (1 << 64) - 1).bit_count()
    return far <= distance and len(s & t) >= similarity * len(s | t)


def copies(seed=2):
    rng = random.Random(seed)
    rows = []
    for base in range(25):
        words = [f"w{rng.randint(0, 4000)}" for _ in range(rng.randint(60, 220))]
        rows.append(" ".join(words))
        for _ in range(base % 4):
            own = list(words)
            own[rng.randrange(len(own))] = "changed"
            rows.append(" ".join(own))
    return [(i * 3, t) for i, t in enumerate(dict.fromkeys(rows))]


def test_near_copies_are_grouped_and_others_left_alone(docs):
    rows = copies()
    got = {r.text_key: (r.least, r.root, r.stays) for r in similar_groups(docs(rows)).collect()}
    by_id = {least: (root, stays) for least, root, stays in got.values()}
    assert len(by_id) == len(rows)
    linked = [(i, j) for i, a in rows for j, b in rows if i < j and near(a, b)]
    assert all(by_id[i][0] == by_id[j][0] for i, j in linked)
    root = {i: i for i, _ in rows}
    for i, j in linked + linked:
        root[i] = root[j] = min(root[i], root[j])
    groups = Counter(by_id[i][0] for i, _ in rows)
    assert len(groups) >= 25 and Counter(s for _, s in by_id.values())[True] == len(groups)
    left = drop_near_duplicates(docs(rows))
    assert left.count() == len(groups) and left.columns == docs(rows).columns


def jaccard(a, b, width=5):
    s, t = set(shingle_hashes(a, width).tolist()), set(shingle_hashes(b, width).tolist())
    return len(s & t) / len(s | t)


def brute_groups(rows, similarity=0.8):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in rows:
        for j, b in rows:
            if i < j and jaccard(a, b) >= similarity:
                root[find(j)] = find(i)
    return {i: find(i) for i in root}


def test_groups_are_those_of_plain_jaccard(docs):
    rng = random.Random(8)
    rows = []
    for _ in range(40):
        words = [f"w{rng.randint(0, 4000)}" for _ in range(rng.randint(100, 300))]
        rows.append(" ".join(words))
        own = list(words)
        for at in range(rng.randrange(50), len(own), rng.choice([50, 60, 75])):
            own[at] = "changed"
        rows.append(" ".join(own))
    # variants of one template, of which only some are near each other
    base = [f"t{i}" for i in range(120)]
    for _ in range(60):
        own = list(base)
        for at in rng.sample(range(len(own)), 3):
            own[at] = f"v{rng.randint(0, 9)}"
        rows.append(" ".join(own))
    rows = list(enumerate(rows))
    root = brute_groups(rows)
    texts = dict(rows)
    pairs = [(i, i + 1) for i in range(0, 80, 2) if jaccard(texts[i], texts[i + 1]) >= 0.8]
    assert sum(not near(texts[i], texts[j]) for i, j in pairs) >= 5  # the bit filter missed these
    got = {r.least: r.root for r in similar_groups(docs(rows)).collect()}
    groups = lambda of: {frozenset(i for i in of if of[i] == r) for r in of.values()}
    assert groups(got) == groups(root)


def test_dense_buckets_fall_apart_only_where_jaccard_does(docs, monkeypatch):
    import tesserae.llm.common as m

    rng = random.Random(21)
    rows = set()
    for _ in range(80):
        own = [f"t{i}" for i in range(100)]
        for at in rng.sample(range(0, 100, 10), 3):
            own[at] = f"v{rng.randint(0, 2)}"
        rows.add(" ".join(own))
    rows = list(enumerate(sorted(rows)))
    root = brute_groups(rows)
    # cells that hold the largest bucket compare it completely, smaller ones go round until nothing is added
    for cell in (100, 8):
        monkeypatch.setattr(m, "CELL_ROWS", cell)
        got = {r.least: r.root for r in similar_groups(docs(rows)).collect()}
        groups = lambda of: {frozenset(i for i in of if of[i] == r) for r in of.values()}
        assert groups(got) == groups(root)


def test_near_copies_are_sought_by_fingerprints(docs, monkeypatch):
    import tesserae.llm.simhash as m

    asked = []
    plain = m.linked_in_buckets
    monkeypatch.setattr(m, "linked_in_buckets", lambda buckets, verifier, near: plain(buckets.limit(0), verifier, near.transform(lambda df: asked.append(df.count()) or df)))
    words = [f"w{i}" for i in range(400)]
    rows = [(3, " ".join(words)), (1, " ".join([*words, "end"])), (2, " ".join(f"v{i}" for i in range(400)))]
    # without bands, links come from the search of fingerprints alone
    assert {r.doc_id for r in drop_near_duplicates(docs(rows)).collect()} == {1, 2} and asked == [1]


def test_near_copies_of_awkward_rows(docs, awkward):
    left = drop_near_duplicates(docs(awkward)).collect()
    texts = Counter((r.text or "").translate(TABLE) for r in left)
    assert set(texts.values()) == {1} and sum(not (t or "").split() for t in texts) == 1
    assert drop_near_duplicates(docs([])).count() == 0


def test_stages_do_what_they_say(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {"": docs.collect()}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert name == "tokens" or out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs.collect()
    passed = {r.doc_id for r in kept["quality"]}
    for r in kept[""]:
        n, _, _, _, again = text_statistics(r.text)[:5]
        if n < 50 or 100 * again > 50 * n:
            assert r.doc_id not in passed
    assert len(passed) > 0.7 * sum(len((r.text or "").split()) >= 50 for r in kept[""])
    # exact: of equal texts the largest id
    best = {}
    for r in kept["quality"]:
        key = r.text.translate(TABLE)
        best[key] = max(best.get(key, -1), r.doc_id)
    assert Counter(r.doc_id for r in kept["exact"]) == Counter(best.values())
    # near: no two of those that stay are near, and those that went have a smaller one of their group
    stay, gone = kept["near"], [r for r in kept["exact"] if r.doc_id not in {x.doc_id for x in kept["near"]}]
    sets = {r.doc_id: set(shingle_hashes(r.text, 5).tolist()) for r in kept["exact"]}
    alike = lambda a, b: len(sets[a.doc_id] & sets[b.doc_id]) >= 0.8 * len(sets[a.doc_id] | sets[b.doc_id])
    assert not any(alike(a, b) for a in stay for b in stay if a.doc_id < b.doc_id)
    assert gone and all(any(alike(r, x) for x in kept["exact"] if x.doc_id != r.doc_id) for r in gone)
    assert Counter(r.doc_id for r in kept["tokens"]) == Counter(r.doc_id for r in kept["mix"]) and {r.doc_id for r in kept["mix"]} <= {r.doc_id for r in stay}
    size = lambda rows: sum(len(r.text.encode().split()) for r in rows)
    assert abs(size(kept["mix"]) - 1.5 * size(stay)) < 0.1 * size(stay)
    model, texts = load_model(PIECES), {r.doc_id: r.text for r in stay}
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in kept["tokens"])
    some = kept["tokens"][:20]
    assert [list(r.ids) for r in some] == [x.tolist() for x in model.encode([texts[r.doc_id] for r in some])]


@pytest.mark.parametrize("rows", [[], [(1, None), (None, ""), (2, " \n")]])
def test_stages_of_next_to_nothing(spark, docs, tmp_path, rows):
    table = docs(rows)
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, table, "/root/testdata/sf0.001")
        out.write.parquet(f"{tmp_path}/{k}")
        table = spark.read.parquet(f"{tmp_path}/{k}")
    assert table.count() == 0
