import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm import token_counts as tc
from tesserae.llm import whitening as wh

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("x", T.StringType()), T.StructField("w", T.StringType()), T.StructField("at", T.StringType())])


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], VECTORS)


@pytest.mark.parametrize("size", [3, 1 << 19, 1 << 20, (1 << 20) + 1, 1 << 45, 1 << 62])
def test_limb_products_are_exact(size):
    rng = np.random.default_rng(size % 97)
    x = rng.integers(-size, size, (500, 4))
    x[0], x[1] = size, -size
    want = x.astype(object).T @ x.astype(object)
    got = sum(m.astype(object) * (1 << (wh.LIMB_BITS * e)) for e, m in wh.products(x).items())
    assert (got == want).all()


def test_sums_of_full_blocks_stay_below_2_to_53():
    x = np.full((wh.BLOCK_ROWS, 2), (1 << 40) - 1)
    assert sum(int(m[0, 1]) << (wh.LIMB_BITS * e) for e, m in wh.products(x).items()) == wh.BLOCK_ROWS * ((1 << 40) - 1) ** 2


def brute(rows, k):
    """By the definition: exact rational covariance of the distinct integer vectors."""
    xs = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in rows}
    fit = sorted({tuple(x) for x in xs.values()})
    n, dims = len(fit), len(fit[0])
    s = [sum(x[d] for x in fit) for d in range(dims)]
    cov = np.array([[float(sum((Fraction(x[i]) - Fraction(s[i], n)) * (Fraction(x[j]) - Fraction(s[j], n)) for x in fit) / n) for j in range(dims)] for i in range(dims)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    white = {i: [float(sum((x[d] - s[d] / n) * u[d, c] for d in range(dims)) / math.sqrt(e[c])) for c in range(len(e))] for i, x in xs.items()}
    return n, {i: sum((n * x[d] - s[d]) ** 2 for d in range(dims)) for i, x in xs.items()}, white, e / np.trace(cov)


def test_whitening_against_definition(spark):
    rng = np.random.default_rng(1)
    own = rng.normal(0, 1, (60, 6)) * [3, 2, 1.5, 1, 0.5, 0.2]
    rows = [(i, v.tolist()) for i, v in enumerate(own)] + [(100 + i, own[0].tolist()) for i in range(30)]  # a hot vector counts once
    n, dev, white, explained = brute(rows, 16)
    odd = [(900, None), (901, [None] * 6), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, []), (905, [1.0, 2.0])]
    got = wh.whiten(vectors(spark, rows + odd), components=16).collect()
    assert n == 60 and len(got) == 90 * 6 and {r.n for r in got} == {60}
    assert {r.vec_id: int(r.deviation) for r in got} == dev
    signs = {c: np.sign(white[0][c - 1] * next(r.whitened for r in got if r.vec_id == 0 and r.component == c)) for c in range(1, 7)}
    for r in got:
        assert abs(r.whitened * signs[r.component] - white[r.vec_id][r.component - 1]) < 1e-9 and abs(r.explained - explained[r.component - 1]) < 1e-12
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_few_rows_ties_and_extremes(spark):
    got = lambda rows: wh.whiten(vectors(spark, rows)).collect()
    assert got([]) == [] and got([(1, [1.0, 2.0])]) == [] and got([(1, None)]) == []
    two = got([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0])])  # one direction has variance
    assert [(r.vec_id, r.component, abs(round(r.whitened, 9)), r.deviation) for r in two] == [(1, 1, 1.0, 64**2), (2, 1, 1.0, 64**2), (None, 1, 1.0, 64**2)]
    far = got([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 5.0])])
    assert {r.component for r in far} == {1} and all(math.isfinite(r.whitened) for r in far)
    tied = got([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, -1.0])])
    assert len(tied) == 8 and tied[0].identity_error < 1e-9


def test_integers(spark):
    got = vectors(spark, [(1, [0.0, -0.01, 0.99, 3e38, -3e38])]).select(wh.integers(F.col("embedding")).alias("x")).first().x
    assert got == [1_000_000, 999_999, 1_000_063, (1 << 63) - 1, -(1 << 63) + 1_000_000]


# -- token counts -------------------------------------------------------------------------------------------------------------------

NAMES = ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json")
ODD = ["", " ", "  two  spaces ", "▁ ▁▁", "<s> </s> <unk> <|endoftext|> x", "é́ü ß\u0085 ", "\x00\x01 a", "日本語のテキスト", "👩‍👩‍👧 x", "it's I'll 3,14 -- \n\n\t x", "Σ ΣΑΣ ὈΔΥΣΣΕΎΣ x"]


def library(name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return path, lambda t: len(model.encode(t))
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return path, lambda t: len(model.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("size", [1, 2, 5, 40])
def test_pieces_count_as_the_whole(name, size):
    path, whole = library(name)
    counter = tc.load_counter(path)
    assert counter.cuts
    rng = np.random.default_rng(size)
    alphabet = list("abcdehilnorstuAZ \n") + ["  ", " the ", "é", "ß", "▁", "字", "👍", "\x01", "'s", "12", "<|endoftext|>", "\t", " "]
    texts = ODD + ["".join(rng.choice(alphabet, rng.integers(1, 200))) for _ in range(300)]
    assert tc.count_texts(counter, iter(texts), size=size, batch_bytes=500) == [whole(t) for t in texts]
    cut = [len(list(tc.pieces(counter, t, size))) for t in texts]
    assert max(cut) > 3


@pytest.mark.parametrize("name", NAMES)
def test_counts_of_a_table(spark, docs, awkward, name):
    path, whole = library(name)
    rows = [*awkward, (77, "lang und breit " * 30_000), (78, "Wort" * 60_000), (79, "<s><|endoftext|>")]
    got = tc.token_counts(docs(rows).withColumnRenamed("size", "n_tokens"), path, limit=100).collect()
    assert len(got) == len(rows)
    for r in got:
        t = r.text or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), whole(t), whole(t) > 100)
    assert tc.token_counts(docs([]), path).collect() == []


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        tc.load_counter("vocabulary.txt")


def test_matrix_rows_of_a_slice():
    own = pa.array([[1, 2], [3, 4], [5, 6]], pa.list_(pa.int64())).slice(1)
    assert wh._matrix(own, 2).tolist() == [[3, 4], [5, 6]]
