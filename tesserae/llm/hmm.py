"""Hidden Markov language model.

Latent states emit word classes (a word's last four characters, hashed: fixed in number), and a class emits its words by their counts, which
grow with the corpus. Documents are packed into blocks of about a million tokens, each with its own dictionary. Word counts are summed over
all blocks and come back by a join on (block, word), so a frequent word is one row a block and no table of words is ever in one place.
Baum-Welch: every task runs scaled forward-backward over its blocks and returns expected counts, of fixed size; their sums over the partitions
give the next parameters. Scoring runs the scaled forward recursion over whole texts; its scales multiply to the likelihood.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

BLOCK_TOKENS = 1 << 20
#: Weight of an unseen word within its class, and of the states' own emissions against the corpus's.
UNSEEN, OWN = 0.5, 0.995
#: Frequent classes among which the first states are sought.
SEEDS = 64

_BLOCKS = "block long, ids array<long>, train array<boolean>, lens array<int>, tokens binary, words array<string>, classes array<int>, counts array<long>"


def is_held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def _class(word: str, classes: int) -> int:
    return zlib.crc32(word[-4:].encode()) % (classes - 1) + 1


def _pack(ids: list, texts: list[list[bytes]], block: int, classes: int) -> pa.RecordBatch:
    """One row: the documents' tokens as numbers of the block's own dictionary; 0 is the end of a document."""
    number: dict[bytes, int] = {b"": 0}
    tokens, lens = [], []
    for words in texts:
        tokens.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint32, len(words)))
        tokens.append(np.zeros(1, np.uint32))
        lens.append(len(words) + 1)
    train = [not is_held_out(i) for i in ids]
    flat = np.concatenate(tokens)
    counts = np.bincount(flat[np.repeat(train, lens)], minlength=len(number))
    words = [w.decode("utf-8", "replace") for w in number]
    own = [0, *(_class(w, classes) for w in words[1:])]
    row = ([ids], [train], [lens], [flat.tobytes()], [words], [own], [counts.tolist()])
    kinds = (pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()))
    names = ["ids", "train", "lens", "tokens", "words", "classes", "counts"]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array(c, k) for c, k in zip(row, kinds, strict=True))], names=["block", *names])


def blocks_of(df: DataFrame, id_col: str, text_col: str, classes: int) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (t.as_py() or "").encode("utf-8", "replace").lower().split()
                if ids and size + len(words) + 1 > BLOCK_TOKENS:
                    yield _pack(ids, texts, (part << 32) + n, classes)
                    ids, texts, size, n = [], [], 0, n + 1
                ids.append(i)
                texts.append(words)
                size += len(words) + 1
        if ids:
            yield _pack(ids, texts, (part << 32) + n, classes)

    return df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(task, _BLOCKS)


class _Steps:
    """Documents of a block side by side: position off[t] + r holds step t of the r-th longest document, so a step is one slice."""

    def __init__(self, lens: np.ndarray):
        self.order = np.argsort(-lens, kind="stable")
        ranks = np.empty(len(lens), np.int64)
        ranks[self.order] = np.arange(len(lens))
        steps = int(lens.max(initial=0))
        self.width = len(lens) - np.cumsum(np.bincount(lens, minlength=steps + 1))[:steps]
        self.off = np.concatenate(([0], np.cumsum(self.width)))
        starts = np.cumsum(lens) - lens
        at = np.arange(int(lens.sum())) - np.repeat(starts, lens)
        rank = np.repeat(ranks, lens)
        self.place = self.off[at] + rank  # of each token
        self.before = (self.off[at - 1] + rank)[at > 0]  # of the token before each but first ones
        self.later = self.place[at > 0]
        self.docs = np.repeat(np.arange(len(lens)), lens)

    def forward(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(alpha, scale): state probabilities given the text so far, and each token's probability given those before it."""
        alpha, scale = np.empty_like(emit), np.empty(len(emit), emit.dtype)
        move = move.astype(emit.dtype)
        for t in range(len(self.width)):
            i, j = self.off[t], self.off[t + 1]
            if t == 0:
                now = start.astype(emit.dtype) * emit[i:j]
            else:
                now = alpha[self.off[t - 1] : self.off[t - 1] + j - i] @ move
                now *= emit[i:j]
            s = now.sum(1)
            scale[i:j] = s
            np.divide(now, s[:, None], out=alpha[i:j])
        return alpha, scale

    def backward(self, move: np.ndarray, emit: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(beta, emit * beta / scale), with which alpha gives the posteriors of states and of moves."""
        weighed = emit / scale[:, None]
        beta, back = np.ones_like(emit), np.ascontiguousarray(move.T.astype(emit.dtype))
        for t in range(len(self.width) - 1, 0, -1):
            i, j = self.off[t], self.off[t + 1]
            weighed[i:j] *= beta[i:j]
            np.matmul(weighed[i:j], back, out=beta[self.off[t - 1] : self.off[t - 1] + j - i])
        return beta, weighed


def _train_part(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(classes of the tokens, lengths) of a block's training documents."""
    train, lens = np.array(row["train"], bool), np.array(row["lens"], np.int64)
    tokens = np.frombuffer(row["tokens"], np.uint32)
    return np.array(row["classes"], np.int64)[tokens[np.repeat(train, lens)]], lens[train]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows with their lists as arrays: ids as an Arrow one, which may have nulls, others as NumPy ones."""

    def value(name: str, x):
        if name in ("block", "tokens") or not x.is_valid:
            return x.as_py()
        return x.values if name == "ids" else x.values.to_numpy(zero_copy_only=False)

    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: value(n, c[i]) for n, c in zip(batch.schema.names, batch.columns, strict=True)}


def _summed(blocks: DataFrame, work, width: int) -> dict[int, np.ndarray]:
    """Sum over all blocks of what work(row) adds to a {row number: vector} of arrays: one array a task, then one row a number."""

    def task(batches):
        total: dict[str, np.ndarray] = {}
        for row in _rows(batches):
            for name, value in work(row).items():
                total[name] = total[name] + value if name in total else value
        keys, values = [], []
        for name, value in total.items():
            live = np.flatnonzero(value.any(1))
            keys.append(live + int(name))
            values.append(value[live])
        if keys:
            flat = np.concatenate(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *(pa.array(flat[:, k]) for k in range(width))], names=["k", *(f"v{i}" for i in range(width))])

    made = blocks.select("block", "train", "lens", "tokens", "classes").mapInArrow(task, "k long, " + ", ".join(f"v{i} double" for i in range(width)))
    got = made.groupBy("k").agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(width))).toPandas()
    return dict(zip(got["k"], got.drop(columns="k").to_numpy(), strict=True))


#: Where the parts of the summed counts start: below them are the classes.
START, MOVE, LIKELY = 1 << 30, (1 << 30) + 8, (1 << 30) + 1024


class HiddenMarkov:
    """start [K], move [K, K] and emit [classes, K], trained on the blocks' training documents."""

    def __init__(self, blocks: DataFrame, totals: np.ndarray, *, states: int, rounds: int):
        self.states, self.background = states, (totals + 1) / (totals.sum() + len(totals))
        self.likelihoods: list[float] = []
        self._first(blocks, totals)
        for _ in range(rounds):
            self._round(blocks)

    def _set(self, emit: np.ndarray) -> None:
        self.emit = OWN * emit / np.maximum(emit.sum(0), 1e-9) + (1 - OWN) * self.background[:, None]

    def _first(self, blocks: DataFrame, totals: np.ndarray) -> None:
        """States start as the company of frequent classes that shun each other: each document divides itself among those by their counts in it."""
        k, top = self.states, np.argsort(-totals[1:], kind="stable")[:SEEDS] + 1
        lookup = np.full(len(totals), -1, np.int64)
        lookup[top] = np.arange(len(top))

        def together(row):
            cls, lens = _train_part(row)
            docs, has = np.repeat(np.arange(len(lens)), lens), lookup[cls]
            seen = np.zeros((len(lens), SEEDS))
            seen[docs[has >= 0], has[has >= 0]] = 1
            return {"0": seen.T @ seen}

        got, both = _summed(blocks, together, SEEDS), np.zeros((SEEDS, SEEDS))
        for i, v in got.items():
            both[i] = v
        df = np.maximum(np.diag(both), 1)
        lift = both / df[:, None] / df[None, :]
        chosen = [0]
        while len(chosen) < min(k, len(top)):
            worst = np.where(np.diag(both) > 0.002 * df.max(), lift[:, chosen].max(1), np.inf)
            worst[chosen] = np.inf
            chosen.append(int(np.argmin(worst)))
        seed = np.full(len(totals), -1, np.int64)
        seed[top[chosen]] = np.arange(len(chosen))

        def divided(row):
            cls, lens = _train_part(row)
            docs, has = np.repeat(np.arange(len(lens)), lens), seed[cls]
            share = np.full((len(lens), k), 0.05)
            np.add.at(share, (docs[has >= 0], has[has >= 0]), 1.0)
            share = share**2 / (share**2).sum(1, keepdims=True)
            return {"0": np.column_stack([np.bincount(cls, share[docs, s], minlength=len(totals)) for s in range(k)])}

        emit = np.zeros((len(totals), k))
        for c, v in _summed(blocks, divided, k).items():
            emit[c] = v
        self.start = np.full(k, 1 / k)
        self.move = np.full((k, k), 0.1 / max(1, k - 1)) if k > 1 else np.ones((1, 1))
        np.fill_diagonal(self.move, 0.9 if k > 1 else 1.0)
        self._set(emit)

    def _round(self, blocks: DataFrame) -> None:
        k, start, move, emit = self.states, self.start, self.move, self.emit.astype(np.float32)

        def expected(row):
            cls, lens = _train_part(row)
            steps = _Steps(lens)
            placed = np.empty(len(cls), np.int64)
            placed[steps.place] = cls
            seen = emit[placed]
            alpha, scale = steps.forward(start, move, seen)
            beta, weighed = steps.backward(move, seen, scale)
            moves = move * (alpha[steps.before].T.astype(float) @ weighed[steps.later])
            alpha *= beta
            sums = np.column_stack([np.bincount(placed, alpha[:, s], minlength=len(emit)) for s in range(k)])
            likely = np.zeros((1, k))
            likely[0, 0] = np.log10(scale.astype(float)).sum()
            return {"0": sums, str(START): alpha[: len(lens)].sum(0, dtype=float)[None], str(MOVE): moves, str(LIKELY): likely}

        got = _summed(blocks, expected, k)
        if START not in got:
            return
        counts = np.zeros_like(self.emit)
        for c, v in got.items():
            if c < len(counts):
                counts[c] = v
        self.likelihoods.append(float(got.get(LIKELY, np.zeros(k))[0]))
        self.start = (got[START] + 0.1) / (got[START] + 0.1).sum()
        moves = np.array([got.get(MOVE + s, np.zeros(k)) for s in range(k)]) + 0.1
        self.move = moves / moves.sum(1, keepdims=True)
        self._set(counts)


def score_texts(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", states: int = 6, rounds: int = 4, classes: int = 1 << 15) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability).

    Learns from rows whose crc32 of the id as text, modulo 7, isn't 2 (a null id as the empty text). A-Z is lower-cased; tokens are words and one
    end. Null and empty texts are an end alone. base_score is the add-one unigram model's. Repeated rows and ids are scored row by row; other
    columns are ignored; an empty table gives an empty one. An unseen word has its class's share for unseen words.
    """
    blocks = stage(blocks_of(df, id_col, text_col, classes), "blocks")
    entries = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "e")).select("block", "at", "e.words", "e.counts")
    # the end of a document has the empty word, which no other token is
    seen = stage(entries.where("counts > 0").groupBy("words").agg(F.sum("counts").alias("c")), "counts")
    by_class = F.when(F.col("words") == "", 0).otherwise(F.crc32(F.encode(F.right("words", F.lit(4)), "utf-8")) % (classes - 1) + 1)
    sums = seen.groupBy(by_class.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).toPandas()
    totals, types = np.zeros(classes), np.zeros(classes)
    totals[sums["k"].astype(int)], types[sums["k"].astype(int)] = sums["c"], sums["v"]
    train_tokens, vocabulary = int(totals.sum()), int(types.sum())
    model = HiddenMarkov(blocks, totals, states=states, rounds=rounds)
    known = entries.select("block", "at", "words").join(seen, "words").groupBy("block").agg(F.collect_list(F.struct("at", "c")).alias("known"))
    known = known.select("block", F.col("known.at").alias("known_at"), F.col("known.c").alias("known_c"))
    ready = blocks.select("block", "ids", "train", "lens", "tokens", "classes").join(known, "block", "left")
    start, move, emit = model.start, model.move, model.emit
    within = totals + UNSEEN * (types + 1)

    def task(batches):
        for row in _rows(batches):
            lens, own = np.array(row["lens"], np.int64), np.array(row["classes"], np.int64)
            tokens, steps = np.frombuffer(row["tokens"], np.uint32), _Steps(lens)
            count = np.zeros(len(own))
            if row["known_at"] is not None:
                count[row["known_at"]] = row["known_c"]
            placed = np.empty(len(tokens), np.int64)
            placed[steps.place] = own[tokens]
            _, scale = steps.forward(start, move, emit[placed])
            per_word = np.log10((count + UNSEEN) / within[own])
            base = np.log10((count + 1) / (train_tokens + vocabulary + 1))
            summed = lambda x: np.bincount(steps.docs, x, minlength=len(lens))  # noqa: B023, E731
            score = summed(np.log10(scale)[steps.place] + per_word[tokens])
            known_tokens = summed((count > 0)[tokens].astype(float)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [row["ids"], pa.array(~np.array(row["train"], bool)), pa.array(lens), pa.array(known_tokens), pa.array(np.full(len(lens), train_tokens)), pa.array(summed(base[tokens])), pa.array(score)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return ready.mapInArrow(task, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
