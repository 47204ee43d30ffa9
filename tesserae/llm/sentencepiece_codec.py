"""Encoding and decoding with a SentencePiece BPE model, by suffix-array matching.

Encoding a batch: the distinct words that aren't cached are concatenated, the suffix array of that text is built by prefix doubling up to the
longest piece, and every piece's range of occurrences is found by binary search over it. The occurrences are edges of a graph over
text positions; sorted by their end, they are relaxed from left to right. As the model is BPE, a path isn't relaxed by summed scores: the
edge that ends at a position belongs to the encoding of that prefix exactly if the last edge before it and itself would not have been merged
otherwise, which is decided by undoing the two pieces' merges, latest first. So the result is that of the merge procedure.

Model files are read by the driver; their path is a parameter and their tables travel with the function.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

SPACE = "▁"
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Characters indexed at once, cached words of a Python worker, and characters of text whose words are looked up together.
INDEX_CHARS, CACHED_WORDS, BATCH_CHARS = 1 << 17, 200_000, 1 << 20


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _message(data: bytes):
    """(field, value) of a protocol buffer message; nested messages and numbers of fixed width stay bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            width, at = _varint(data, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + width], at + width
        yield key >> 3, value


@dataclass
class Model:
    """Tables of a BPE model: plain arrays, bounded by its vocabulary."""

    pieces: list[str]
    types: list[int]
    rank: np.ndarray  # order of merging; -1 for single characters
    ids: np.ndarray  # matched pieces, by (length, id)
    codes: np.ndarray  # their characters' numbers, zero-padded
    bits: int  # of a character's number
    alphabet: np.ndarray  # number of each code point that pieces have; 0 for others
    lengths: np.ndarray
    left: np.ndarray  # the two pieces that a piece is merged from
    right: np.ndarray
    pair_keys: np.ndarray  # left * vocabulary + right of every pair that merges, sorted
    pair_rank: np.ndarray
    pair_bits: np.ndarray  # a bit for each hash of a pair that merges
    byte_ids: np.ndarray
    space_id: int
    runs: dict[int, int]  # pieces of two or more spaces
    cache: dict[str, bytes] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    # -- merging ------------------------------------------------------------------------------------------------------------

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that a and b merge to; a number above all ranks if they don't."""
        keys = a * len(self.pieces) + b
        h = self._hash(keys)
        out = np.full(len(a), 1 << 40, np.int64)
        maybe = np.flatnonzero(self.pair_bits[h >> 3] >> (h & 7).astype(np.uint8) & 1)
        at = np.minimum(np.searchsorted(self.pair_keys, keys[maybe]), len(self.pair_keys) - 1)
        found = self.pair_keys[at] == keys[maybe]
        out[maybe[found]] = self.pair_rank[at[found]]
        return out

    def stay_apart(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether pieces a and b, side by side, are what merging below ``limit`` leaves of their joint text."""
        a, b, limit = a.copy(), b.copy(), limit.copy()
        apart, todo = np.ones(len(a), bool), np.arange(len(a))
        while len(todo):
            x, y = a[todo], b[todo]
            crossed = self._merged(x, y) < limit[todo]
            apart[todo[crossed]] = False
            todo, x, y = todo[~crossed], x[~crossed], y[~crossed]
            rx, ry = self.rank[x], self.rank[y]
            more = np.maximum(rx, ry) >= 0
            todo, x, y, rx, ry = todo[more], x[more], y[more], rx[more], ry[more]
            first = rx > ry  # the left piece was merged later; of equal pieces the right one was
            a[todo] = np.where(first, self.right[x], x)
            b[todo] = np.where(first, y, self.left[y])
            limit[todo] = np.where(first, rx, ry + 1)
        return apart

    # -- matching -----------------------------------------------------------------------------------------------------------

    def _occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece id) of every occurrence of every piece in an array of character numbers."""
        n, width, bits, deep = len(text), self.codes.shape[1], self.bits, 63 // self.bits
        padded = np.concatenate((text, np.zeros(width + deep, np.int64)))
        key = padded[: n + width].copy()
        for k in range(1, deep):
            key <<= bits
            key |= padded[k : n + width + k]
        (order, suffixes), depth = _ranked(key[:n]), deep
        while depth < self.lengths.max():
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - depth)] = order[depth:] + 1
            (order, suffixes), depth = _ranked(order * (n + 1) + ahead), 2 * depth
        lo, hi = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), n, np.int64)
        for at in range(0, width, deep):
            live = np.flatnonzero((self.lengths > at) & (hi > lo))
            keys = key[suffixes + at]
            low = np.zeros(len(live), np.int64)
            for k in range(deep):
                low = (low << bits) | self.codes[live, at + k]
            free = bits * np.maximum(0, at + deep - self.lengths[live])
            past = low + (np.int64(1) << free)
            if at:
                lo[live], hi[live] = _within(keys, lo[live], hi[live], low), _within(keys, lo[live], hi[live], past)
            else:  # all slices are the whole
                lo[live], hi[live] = np.searchsorted(keys, low), np.searchsorted(keys, past)
        counts = hi - lo
        starts = suffixes.astype(np.int32)[np.repeat(lo - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
        return starts, starts + np.repeat(self.lengths.astype(np.int32), counts), np.repeat(self.ids.astype(np.int32), counts)

    def _encode_words(self, words: list[str]) -> None:
        """Put the encoding of each word into the cache: with a space before it, unless it starts with a line break."""
        text = np.frombuffer("\0".join(w if w[:1] == "\n" else SPACE + w for w in words).encode("utf-32-le", "surrogatepass") + b"\0" * 4, "<u4").astype(np.int64)
        starts = np.concatenate(([0], np.flatnonzero(text == 0)[:-1] + 1))
        plain = self.alphabet[text]
        start, end, piece = self._occurrences(plain)
        # what precedes a position in its run of known characters
        at = np.arange(len(plain), dtype=np.int32)
        run = np.maximum.accumulate(np.where(plain == 0, at + 1, 0))
        step = end - run[end - 1]
        order = np.argsort(step.astype(np.uint16) if len(step) and step.max() < 1 << 16 else step, kind="stable")
        start, end, piece, step = start[order], end[order], piece[order], step[order]
        last, come = np.full(len(plain) + 1, -1, np.int64), np.zeros(len(plain) + 1, np.int32)
        cuts = np.searchsorted(step, np.arange(1, (step[-1] if len(step) else 0) + 2))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            s, e, p = start[i:j], end[i:j], piece[i:j]
            whole = s == run[e - 1]
            good = whole.copy()
            rest = np.flatnonzero(~whole)
            good[rest] = self.stay_apart(last[s[rest]], p[rest].astype(np.int64), np.full(len(rest), 1 << 40, np.int64))
            last[e[good]], come[e[good]] = p[good], s[good]
        tokens, stops = self._walk(text, plain, last, come)
        first = np.searchsorted(stops, starts, "right")
        past = np.concatenate((first[1:], [len(stops)]))
        for w, i, j in zip(words, first.tolist(), past.tolist(), strict=True):
            self.cache[w] = tokens[i:j].tobytes()

    def _walk(self, text, plain, last, come):
        """The tokens on the way back from the end of every run, by position, with the bytes of unknown characters between them."""
        ends = np.flatnonzero((plain != 0) & (np.concatenate((plain[1:], [0])) == 0)) + 1
        toks, at = [], []
        while len(ends):
            toks.append(last[ends])
            at.append(ends)
            prev = come[ends]
            ends = prev[(prev > 0) & (plain[prev - 1] != 0)]
        odd = np.flatnonzero((plain == 0) & (text != 0))
        for ch in np.unique(text[odd]).tolist():
            where, coded = odd[text[odd] == ch] + 1, chr(ch).encode("utf-8", "replace")
            for k, byte in enumerate(coded):
                toks.append(np.full(len(where), self.byte_ids[byte]))
                at.append(where + (k - len(coded) + 1) / 8)  # in order, after what ends before the character
        toks, at = (np.concatenate(toks), np.concatenate(at)) if toks else (np.empty(0, np.int64), np.empty(0))
        order = np.argsort(at, kind="stable")
        return toks[order].astype("<i4"), at[order]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Piece ids of each text; null and empty texts have none."""
        out: list[np.ndarray] = []
        i = 0
        while i < len(texts):
            j, chars = i, 0
            while j < len(texts) and (j == i or chars < BATCH_CHARS):
                chars += len(texts[j] or "")
                j += 1
            # a line break starts a word that has no space before it
            parts = [t.replace(SPACE, " ").replace("\n", " \n").split(" ") if t else [] for t in texts[i:j]]
            wanted = set().union(*parts)
            if len(self.cache) > CACHED_WORDS:  # what this text doesn't have goes, so frequent words stay
                self.cache = {w: self.cache[w] for w in wanted & self.cache.keys()}
            new = list(wanted - self.cache.keys())
            a = 0
            while a < len(new):
                b, size = a, 0
                while b < len(new) and (b == a or size < INDEX_CHARS):
                    size += len(new[b]) + 2
                    b += 1
                self._encode_block(new[a:b])
                a = b
            for p in parts:
                ids = np.frombuffer(b"".join(map(self.cache.__getitem__, p)), "<i4")
                out.append(self._join_spaces(ids) if "" in p else ids)
            i = j
        return out

    def _encode_block(self, words: list[str]) -> None:
        odd = [w for w in words if "\0" in w]
        if plain := [w for w in words if "\0" not in w]:
            self._encode_words(plain)
        for w in odd:  # U+0000 is the separator above: encode what is between, and put its byte there
            pieces = w.split("\0")
            self._encode_words(["".join(pieces[0])])
            got = self.cache[pieces[0]]
            for rest in pieces[1:]:
                got += struct.pack("<i", int(self.byte_ids[0])) + self._bare(rest)
            if pieces[0] != w:
                self.cache[w] = got

    def _bare(self, word: str) -> bytes:
        """The encoding of a word without a space before it: that of the word after a character no piece has, less that character."""
        if not word:
            return b""
        stop = next(c for c in map(chr, range(1, 32)) if not self.alphabet[ord(c)] and c != "\n")
        self._encode_words([stop + word])
        coded = self.cache.pop(stop + word)
        return coded[8:]  # the space, and one byte

    def _join_spaces(self, ids: np.ndarray) -> np.ndarray:
        """Merge runs of single spaces: their pieces have one score, below all others, so the leftmost pair that has a piece merges first."""
        out, i = [], 0
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids == self.space_id).view(np.int8), [0]))))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            widths: list[int] = []
            for _ in range(e - s):
                widths.append(1)
                while len(widths) > 1 and widths[-1] + widths[-2] in self.runs:
                    widths.append(widths.pop() + widths.pop())
            out += [ids[i:s], np.array([self.runs.get(w, self.space_id) for w in widths], "<i4")]
            i = e
        return np.concatenate((*out, ids[i:]))

    # -- decoding -----------------------------------------------------------------------------------------------------------

    def decode(self, rows) -> list[str]:
        """The text of each row of ids: bytes that aren't UTF-8 become U+FFFD; one leading space is dropped; unknown ids raise."""
        if not hasattr(self, "surface"):
            self.surface = [
                bytes([int(p[1:-1], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode()
                for p, t in zip(self.pieces, self.types, strict=True)
            ]
        of = self.surface.__getitem__
        texts = (b"".join(map(of, () if ids is None else np.asarray(ids).tolist())).decode("utf-8", "replace") for ids in rows)
        return [t[1:] if t[:1] == " " else t for t in texts]


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each key among the distinct ones, and the positions of the keys in order."""
    at = np.argsort(keys)
    ordered, ranks = keys[at], np.zeros(len(keys), np.int64)
    ranks[at[1:]] = np.cumsum(ordered[1:] != ordered[:-1])
    return ranks, at


def _within(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """First position in each sorted slice keys[lo:hi] that holds at least the wanted value."""
    lo, hi = lo.copy(), hi.copy()
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) >> 1
        less = keys[mid] < wanted[live]
        lo[live[less]] = mid[less] + 1
        hi[live[~less]] = mid[~less]
        live = live[lo[live] < hi[live]]
    return lo


def load_model(path: str) -> Model:
    """Read a BPE model with byte fallback, identity normalisation and a space before each text; others raise ValueError."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, types, trainer, normal = [], [], [], {}, {}
    for number, value in _message(data):
        if number == 1:
            row = dict(_message(value))
            pieces.append(row[1].decode())
            scores.append(struct.unpack("<f", row.get(2, bytes(4)))[0])
            types.append(row.get(3, NORMAL))
        elif number in (2, 3):
            (trainer if number == 2 else normal).update(_message(value))
    matched = [i for i, t in enumerate(types) if t == NORMAL]
    runs = {len(pieces[i]): i for i in matched if len(pieces[i]) > 1 and set(pieces[i]) == {SPACE}}
    matched = [i for i in matched if i not in set(runs.values())]
    singles = {pieces[i] for i in matched if len(pieces[i]) == 1}
    lowest = min(scores[i] for i in matched if len(pieces[i]) > 1)
    if (
        trainer.get(3) != 2 or types.count(BYTE) != 256 or normal.get(2) or normal.get(3) != 1 or normal.get(4) != 0
        or USER_DEFINED in types or SPACE not in singles or "\n" in singles or any(SPACE in pieces[i][1:] for i in matched)
        or len({scores[i] for i in runs.values()}) > 1 or any(scores[i] >= lowest for i in runs.values())
        or not {c for i in matched for c in pieces[i]} <= singles
    ):
        raise ValueError(f"{path}: not a BPE model with byte fallback, identity normalisation, and spaces at the start of pieces only")
    matched.sort(key=lambda i: (len(pieces[i]), i))
    number = {pieces[i]: i for i in matched}
    rank = np.full(len(pieces), -1, np.int64)
    merged = sorted((i for i in matched if len(pieces[i]) > 1), key=lambda i: -scores[i])
    rank[merged] = np.arange(len(merged))
    splits = [(number[p[:k]], number[p[k:]], i) for i in merged for p in [pieces[i]] for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
    a, b, made = np.array(splits, np.int64).reshape(-1, 3).T
    order = np.argsort(a * len(pieces) + b)
    lengths = np.array([len(pieces[i]) for i in matched], np.int64)
    alphabet, chars = np.zeros(0x110000, np.int64), sorted(singles)
    alphabet[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
    bits = len(chars).bit_length()
    codes = np.zeros((len(matched), -(-int(lengths.max()) // (63 // bits)) * (63 // bits)), np.int64)
    for row, i in enumerate(matched):
        codes[row, : lengths[row]] = alphabet[[ord(c) for c in pieces[i]]]
    byte_ids = np.zeros(256, np.int64)
    for i, t in enumerate(types):
        if t == BYTE:
            byte_ids[int(pieces[i][1:-1], 16)] = i
    model = Model(
        pieces, types, rank, np.array(matched, np.int64), codes, bits, alphabet, lengths, np.arange(len(pieces)), np.arange(len(pieces)),
        (a * len(pieces) + b)[order], rank[made][order], np.zeros(1 << 21, np.uint8), byte_ids, number[SPACE], runs,
    )
    h = model._hash(model.pair_keys)
    np.bitwise_or.at(model.pair_bits, h >> 3, (1 << (h & 7)).astype(np.uint8))
    # how each piece is merged, short ones first: at its last step, two pieces that stay apart until then
    formed = rank < 0
    size = np.array([len(p) for p in pieces])
    for length in range(2, int(lengths.max()) + 1):
        own = np.flatnonzero(size[made] == length)
        own = own[formed[a[own]] & formed[b[own]]]
        own = own[model.stay_apart(a[own], b[own], rank[made[own]])]
        model.left[made[own]], model.right[made[own]], formed[made[own]] = a[own], b[own], True
    keep = formed[model.ids]
    model.ids, model.codes, model.lengths = model.ids[keep], model.codes[keep], model.lengths[keep]
    return model


#: The model that this Python worker used last: workers outlive queries, and only one model keeps a cache.
_LAST: list[Model] = []


def _only(model: Model) -> Model:
    if _LAST and _LAST[0] is not model:
        _LAST[0].cache.clear()
    _LAST[:] = [model]
    return model


def encode(df: DataFrame, model: Model, *, text_col: str = "text", to: str = "ids") -> DataFrame:
    """df with the array column ``to``: the piece ids of each text, those of the library's encoder. A null or empty text has no pieces.

    U+2581 in a text is a space, as in the library. Characters without a piece become the bytes of their UTF-8. The column replaces
    one of that name. Long words and texts are encoded whole.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series(_only(shared.value).encode([t if isinstance(t, str) else None for t in texts]), dtype=object)

    # not deterministic as far as the optimizer goes: else it runs the function once for each use of its result
    return df.withColumn(to, udf.asNondeterministic()(F.col(text_col)))


def decode(df: DataFrame, model: Model, *, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the string column ``to``: the text of each array of ids; null and empty arrays give the empty text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StringType())
    def udf(rows: pd.Series) -> pd.Series:
        return pd.Series(shared.value.decode(rows), dtype=object)

    return df.withColumn(to, udf(F.col(ids_col)))


def round_trip(df: DataFrame, model: Model, *, text_col: str = "text", to: str = "ids", back: str = "decoded") -> DataFrame:
    """df with both columns of ``encode`` and ``decode``, made by one Python worker a task instead of two."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType())])

    @F.pandas_udf(kind)
    def udf(texts: pd.Series) -> pd.DataFrame:
        own = _only(shared.value)
        ids = own.encode([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "text": pd.Series(own.decode(ids), dtype=object)})

    both = df.withColumn("__coded", udf.asNondeterministic()(F.col(text_col)))
    return both.withColumns({to: F.col("__coded.ids"), back: F.col("__coded.text")}).drop("__coded")
