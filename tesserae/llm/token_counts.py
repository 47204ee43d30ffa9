"""How many tokens texts have, by the tokenizers' own libraries: lengths only, so ids never leave the Python worker.

A worker takes texts in batches of so many bytes, not rows. Long texts are cut into pieces of about that size at places where no token can
reach across, so memory doesn't follow the longest text; a stretch without such a place stays whole.

* SentencePiece (.model): no piece contains the two characters beside the cut. What a model adds in front of a text is taken off again: later
  pieces are led by a character that no piece has, whose own count is subtracted.
* Tokenizers (.json) that split at words before merging: in front of a single space between two ASCII letters.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text encoded at once, and characters of a text from where it is cut.
BATCH_BYTES, PIECE_CHARS = 1 << 20, 1 << 17


class PieceCounter:
    """Counts by the SentencePiece library."""

    def __init__(self, path: str):
        import sentencepiece

        from .sentencepiece_codec import BYTE, CONTROL, NORMAL, SPACE, UNKNOWN, _message

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            fields = list(_message(f.read()))
        normal = {k: v for number, value in fields if number == 3 for k, v in _message(value)}
        rows = [dict(_message(value)) for number, value in fields if number == 1]
        pieces = [r[1].decode() for r in rows if r.get(3, NORMAL) not in (UNKNOWN, CONTROL, BYTE)]
        self.joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        used = {c for p in pieces for c in p}
        # otherwise texts stay whole: rules and dropped white space move characters, and unknown neighbours become one token
        self.cuts = not normal.get(2) and not normal.get(4, 1) and normal.get(5, 1) == 1 and any(r.get(3) == BYTE for r in rows)
        self.lead = next(chr(c) for c in (*range(1, 9), *range(0xE000, 0xF8FF)) if chr(c) not in used)
        self.space, self.led = SPACE, len(self.model.encode(self.lead, num_threads=1))

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]

    def next_cut(self, text: str, at: int) -> int:
        """The first place from ``at`` on where a cut is safe; the text's end if there is none."""
        before = text[at - 1].replace(" ", self.space)
        for i in range(at, len(text)):
            here = text[i].replace(" ", self.space)
            if before + here not in self.joined:
                return i
            before = here
        return len(text)


class WordCounter:
    """Counts by the tokenizers library; special tokens in a text count as such, as is its default."""

    led, lead = 0, ""
    _CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        with open(path) as f:
            doc = json.load(f)
        steps = [p for key, inner in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")) if doc[key] for p in doc[key].get(inner, [doc[key]])]
        by_word = any(p["type"] == "ByteLevel" and p["use_regex"] or p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"] for p in steps)
        known = all(p["type"] in ("NFC", "Lowercase", "Split") or p["type"] == "ByteLevel" and not p["add_prefix_space"] or p["type"] == "Replace" and p["pattern"] == {"Regex": "\\s+"} and p["content"] == " " for p in steps)
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in doc["added_tokens"])
        self.cuts = by_word and known and plain

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def next_cut(self, text: str, at: int) -> int:
        found = self._CUT.search(text, at)
        return found.start() if found else len(text)


@lru_cache(maxsize=2)
def load_counter(path: str) -> PieceCounter | WordCounter:
    """The counter of a model file, once a worker: .model is SentencePiece's, .json the tokenizers library's."""
    if path.endswith(".model"):
        return PieceCounter(path)
    if path.endswith(".json"):
        return WordCounter(path)
    raise ValueError(f"{path}: neither .model nor .json")


def pieces(counter, text: str, size: int = PIECE_CHARS) -> Iterator[tuple[str, int]]:
    """(piece, tokens that aren't the text's): the text, cut where that is safe at the first places after each ``size`` characters."""
    at = 0
    while counter.cuts and len(text) - at > size:
        cut = counter.next_cut(text, at + size)
        yield (counter.lead if at else "") + text[at:cut], counter.led if at else 0
        at = cut
    if at == 0:
        yield text, 0
    elif at < len(text):
        yield counter.lead + text[at:], counter.led


def count_texts(counter, texts: Iterator[str | None], *, size: int = PIECE_CHARS, batch_bytes: int = BATCH_BYTES) -> list[int]:
    """Tokens of each text; null is empty."""
    out: list[int] = []
    batch, owners, less, held = [], [], [], 0

    def flush():
        nonlocal held
        for row, minus, n in zip(owners, less, counter.counts(batch), strict=True):
            out[row] += n - minus
        batch.clear(), owners.clear(), less.clear()
        held = 0

    for row, text in enumerate(texts):
        out.append(0)
        for piece, minus in pieces(counter, text or "", size):
            batch.append(piece)
            owners.append(row)
            less.append(minus)
            held += 4 * len(piece)  # bytes at most
            if held >= batch_bytes:
                flush()
    if batch:
        flush()
    return out


def token_counts(df: DataFrame, path: str, *, text_col: str = "text", limit: int = 4096, n_bytes: str = "n_bytes", n_tokens: str = "n_tokens", over: str = "over_limit") -> DataFrame:
    """df with n_bytes (of UTF-8), n_tokens and over_limit (more than ``limit``), which replace columns of those names.

    Counts are the library's for the whole text, without begin, end or added special tokens. A null or empty text has no bytes; its tokens are
    those of the empty text. The file at ``path`` has to be at the same place on every executor. No shuffle, whatever the texts' lengths;
    repeated rows are counted each, and an empty table stays empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    @F.arrow_udf("long")
    def counted(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = load_counter(path)
        for part in parts:
            yield pa.array(count_texts(counter, (v.as_py() for v in part)), pa.int64())

    made = df.withColumns({"__bytes": F.octet_length(text).cast("long"), "__tokens": counted(text)})
    made = made.withColumns({n_bytes: F.col("__bytes"), n_tokens: F.col("__tokens"), over: F.col("__tokens") > limit})
    return made.drop("__bytes", "__tokens")
