import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tesserae.llm.hmm import score_texts
from tesserae.llm.mixing import mix_sources, source_targets, take_mix
from tesserae.llm.quality import BASE, STATS, IsolationForest, _smallest, quality_rules, text_statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_stats(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def texts(n=60, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice("a bb ccc ## <d> é x\n x\n 7|8 \u0085z".split(" ")) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_statistics_equal_brute_force(awkward):
    for t in [t for _, t in awkward] + texts():
        assert text_statistics(t)[:5] == brute_stats(t)


def labelled(docs, spark, n=400):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    rows, marks = [], []
    for i in range(n):
        bad = i % 8 == 0
        words = [word() + ("###" if bad else "") for _ in range(rng.randint(60, 200))]
        rows.append((i, " ".join(words)))
        marks.append((i, 0 if bad else 1, 0))
    return rows, marks


def test_forest_rejects_junk_and_keeps_clean(docs, spark):
    rows, marks = labelled(docs, spark)
    labels = spark.createDataFrame(marks[: len(marks) // 2] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality_rules(docs(rows), labels).collect()}
    assert sum(not got[i] for i, q, _ in marks if q == 0) >= 48 and sum(got[i] for i, q, _ in marks if q == 1) >= 345
    again = {r.doc_id: r.kept for r in quality_rules(docs(rows), labels).collect()}
    assert got == again


def test_quality_of_awkward_rows(docs, spark, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_rules(docs(awkward), none).collect()
    want = Counter((i, *s, s[0] < 50 or 100 * s[4] > 50 * s[0]) for i, s in ((i, brute_stats(t)) for i, t in awkward))
    assert Counter((r.doc_id, *(r[s] for s in STATS[:5]), r.base_failed) for r in got) == want
    assert all(r.kept == (not r.base_failed) for r in got)
    assert quality_rules(docs([]), none).count() == 0


def test_empty_cells_have_short_paths():
    rng = np.random.default_rng(0)
    rows = np.concatenate((rng.normal(0, 1, (500, 3)), rng.normal(8, 1, (60, 3))))
    good = np.arange(560) < 500
    score = IsolationForest(rows, good, trees=50, subsample=128, seed=1).score(rows)
    assert score[~good].min() > np.median(score[good])
    assert IsolationForest(rows[:0], good[:0], trees=3, subsample=8, seed=1).score(rows).tolist() == [0] * 560


def brute_mix(rows, weights=(3, 1, 2), share=1.5, most=2.0, seed="mix"):
    groups = defaultdict(list)
    for i, t, s in rows:
        groups[(s is None, s or "")].append((int(hashlib.md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:15], 16), len(WORD.findall(t or ""))))
    keys = sorted(groups)
    size = {k: sum(n for _, n in groups[k]) for k in keys}
    w = {k: weights[j % len(weights)] for j, k in enumerate(keys)}
    left, capped = sum(size.values()) * share, set()
    while True:
        rest = left - sum(most * size[k] for k in capped)
        free = sum(w[k] for k in keys if k not in capped)
        target = {k: most * size[k] if k in capped else rest * w[k] / free for k in keys}
        over = {k for k in keys if k not in capped and target[k] >= most * size[k]}
        if not over:
            break
        capped |= over
    out = Counter()
    for k in keys:
        whole = int(target[k] // size[k]) if size[k] else 0
        budget, below, by_hash = target[k] - whole * size[k], 0, defaultdict(int)
        for h, n in groups[k]:
            by_hash[h] += n
        extra, open_ = {}, budget > 0
        for h in sorted(by_hash):
            if open_ and below + by_hash[h] <= budget:
                extra[h] = 1
            else:
                extra[h] = int(open_ and 2 * (budget - below) > by_hash[h])
                open_ = False
            below += by_hash[h]
        for h, n in groups[k]:
            out[(n, size[k], round(target[k], 6), whole + extra[h] if n else None)] += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_equals_brute_force(docs, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([i, i // 2, None]), " ".join("w" * rng.randint(0, 30)), rng.choice(["a", "b", None, "Z", "é", "hot", "hot", "hot"])) for i in range(200)]
    got = mix_sources(docs(rows)).collect()
    assert Counter((r.mix_size, r.mix_source_size, round(r.mix_target, 6), r.mix_copies if r.mix_size else None) for r in got) == brute_mix(rows)
    by_source = defaultdict(list)
    for r in got:
        by_source[r.source].append(r)
    assert all(r.mix_size * r.mix_copies <= 2 * r.mix_size for r in got)
    taken = take_mix(docs(rows))
    assert taken.columns == docs(rows).columns and taken.count() == sum(r.mix_copies for r in got)


def test_mix_of_awkward_rows(docs, awkward):
    assert mix_sources(docs([])).count() == 0 and take_mix(docs([])).count() == 0
    got = mix_sources(docs(awkward))
    assert got.count() == len(awkward)
    assert [r.mix_copies for r in mix_sources(docs([(1, None), (2, "")])).collect()] == [0, 0]


def test_targets_stop_at_twice_the_size(spark):
    got = {r.key: r.target for r in source_targets(spark.createDataFrame([("a", 10), ("b", 1000), ("c", 0)], "key string, source_size long"), [3, 1, 2], 1.5, 2.0).collect()}
    assert got == {"a": 20.0, "b": 1495.0, "c": 0.0}


def test_sample_of_smallest_hashes(spark):
    # many rows of few hashes, so that the first bound leaves too few
    rng = random.Random(2)
    rows = [(rng.choice([2**62, -(2**63), rng.getrandbits(64) - 2**63]), i) for i in range(2000)]
    table = spark.createDataFrame(rows, "h long, doc_id long")
    for most in (1, 10, 100, 5000):
        assert [tuple(r) for r in _smallest(table, most).to_numpy().tolist()] == sorted(rows)[:most]
    late = spark.createDataFrame([(2**62 + i, i) for i in range(1000)], "h long, doc_id long")
    assert _smallest(late, 3)["doc_id"].tolist() == [0, 1, 2] and _smallest(table.limit(0), 3).empty


def test_base_columns_without_a_model(spark, docs, awkward):
    # no trees and no training: the base columns stay as they are with them
    labels = spark.createDataFrame([(4, 1), (6, 0)], "doc_id long, quality int")
    columns = ["doc_id", *BASE, "base_failed"]
    rules = [Counter(tuple(r) for r in quality_rules(docs(awkward), labels, trees=n).select(*columns).collect()) for n in (0, 20)]
    assert rules[0] == rules[1] and sum(rules[0].values()) == len(awkward)
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]
    scores = [Counter(tuple(r) for r in score_texts(docs(awkward), rounds=n).select(*columns).collect()) for n in (0, 2)]
    assert scores[0] == scores[1] and sum(scores[0].values()) == len(awkward)
    assert quality_rules(docs([]), labels, trees=0).count() == 0 and score_texts(docs([]), rounds=0).count() == 0
