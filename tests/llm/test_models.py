import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import tesserae.llm.hmm as hmm
from tesserae.llm.queries import PIECES
from tesserae.llm.sentencepiece_codec import decode, encode, load_model


def prose(n=160, seed=0):
    rng = random.Random(seed)
    tongues = [[f"{c}{i}{c}" for i in range(40)] for c in "abcd"]
    return [(i, " ".join(rng.choice(tongues[i % 4]).upper() if rng.random() < 0.1 else rng.choice(tongues[i % 4]) for _ in range(rng.randint(0, 40)))) for i in range(n)]


def test_hidden_states_beat_unigrams_on_held_out_texts(docs):
    rows = prose()
    got = {r.doc_id: r for r in hmm.score_texts(docs(rows), classes=512).collect()}
    tokens = {i: [*t.encode().lower().split(), b"\0end"] for i, t in rows}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for i in train for w in tokens[i])
    total, types = sum(counts.values()), len(counts)
    for i, words in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in set(train), len(words), sum(counts[w] > 0 for w in words), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in words))
        assert r.score < 0
    held = [i for i in got if got[i].held_out]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held) + 10


def test_scaled_recursions_equal_sums_over_paths():
    rng = np.random.default_rng(1)
    k, lens = 3, np.array([2, 5, 1, 4])
    start, move = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k)
    emit = rng.random((lens.sum(), k))
    steps = hmm._Steps(lens)
    placed = np.empty_like(emit)
    placed[steps.place] = emit
    alpha, scale = steps.forward(start, move, placed)
    beta, weighed = steps.backward(move, placed, scale)
    likely = np.bincount(steps.docs, np.log(scale)[steps.place], minlength=4)
    at = 0
    for d, n in enumerate(lens):
        e, now = emit[at : at + n], None
        for t in range(n):
            now = start * e[0] if t == 0 else now @ move * e[t]
        assert likely[d] == pytest.approx(np.log(now.sum()))
        at += n
    assert np.allclose((alpha * beta).sum(1), 1)
    moves = move * (alpha[steps.before].T @ weighed[steps.later])
    assert moves.sum() == pytest.approx((lens - 1).sum())


def test_blocks_and_rounds(docs, monkeypatch):
    """Likelihood doesn't fall from round to round, and is the same whatever the blocks."""
    df, seen = docs(prose()).coalesce(1), []
    keep = hmm.HiddenMarkov.__init__

    def init(self, *a, **k):
        keep(self, *a, **k)
        seen.append(self.likelihoods)

    monkeypatch.setattr(hmm.HiddenMarkov, "__init__", init)
    hmm.score_texts(df, classes=512)
    monkeypatch.setattr(hmm, "BLOCK_TOKENS", 300)
    hmm.score_texts(df, classes=512)
    assert all(b > a - abs(a) * 1e-3 for a, b in zip(seen[0], seen[0][1:], strict=False)) and np.allclose(*seen, rtol=1e-4)


def test_scores_of_awkward_rows(docs, awkward):
    got = hmm.score_texts(docs(awkward), classes=64).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in awkward)
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len((t or "").encode().split()) + 1) for i, t in awkward)
    assert hmm.score_texts(docs([]), classes=64).count() == 0


# -- SentencePiece -------------------------------------------------------------------------------------------------------------------

ODD = [
    "", "a", "  a", "a  b", "a   ", "\n\n", "  \n x", "é ü ß\u0085   x", "日本語テスト 🎉", "x" * 3000, " " * 40, "a\0b", "\0", "▁a▁▁b", "\0\0 a \0",
    "1234567890 12", "aaaa aaaaaaa", "=======  ----", "the theres" * 50, "\x01\x02 \x01", " ".join(["word"] * 20_000),
]


@pytest.fixture(scope="module")
def model():
    return load_model(PIECES)


def test_encodes_as_the_library_does(model):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(2)
    chars = "  eeeaaatinosrhld.,-=\n\t0123éüßñ日Ж▁Aa"
    texts = ODD + ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    got = model.encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == sp.encode(text), repr(text)
    assert model.decode(got) == [sp.decode(i.tolist()) for i in got]


def test_small_indexes_and_caches_change_nothing(model, monkeypatch):
    import tesserae.llm.sentencepiece_codec as m

    texts = ODD + ["some words that come again and again", "some words"]
    want = [x.tolist() for x in model.encode(texts)]
    for name, value in (("INDEX_CHARS", 7), ("CACHED_WORDS", 2), ("BATCH_CHARS", 11)):
        monkeypatch.setattr(m, name, value)
    model.cache.clear()
    assert [x.tolist() for x in model.encode(texts)] == want


def test_round_trip_of_a_table(docs, awkward, model):
    rows = decode(encode(docs(awkward), model), model).collect()
    assert len(rows) == len(awkward) and all(r.decoded == (r.text or "").replace("▁", " ") for r in rows)
    assert encode(docs([]), model).count() == 0


def test_other_models_are_refused(tmp_path):
    (tmp_path / "m").write_bytes(b"")
    with pytest.raises(ValueError):
        load_model(str(tmp_path / "m"))


def test_pieces_are_first_sought_in_one_search(monkeypatch):
    """Slices are searched one by one only where they are parts of the suffix array; the array itself takes one search for all pieces."""
    import tesserae.llm.sentencepiece_codec as codec

    widest, within = [], codec._within
    monkeypatch.setattr(codec, "_within", lambda keys, lo, hi, wanted: widest.append(int((hi - lo).max(initial=0)) - len(keys)) or within(keys, lo, hi, wanted))
    model = load_model(PIECES)
    text = "the quick brown fox considers international responsibilities"
    widest.clear()
    assert model.decode(model.encode([text])) == [text]
    assert widest and max(widest) < 0
