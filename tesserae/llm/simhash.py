"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. If two fingerprints differ in at most r bits, then for radii t_1..t_m with
sum(t_i + 1) = r + 1 they differ in at most t_i bits in some segment i (generalised pigeonhole). So the table of segment i is
probed with the Hamming ball of radius t_i around each fingerprint's segment, and complete distances are verified.

Probes are enumerated in two halves to keep the shuffle small: the top bits of a segment route rows to the tables (a row goes to
each route within the radius), the low bits are enumerated inside the task against that route's table. The number of
route bits grows with the number of distinct fingerprints, so a table has about ``TABLE_ROWS`` rows at any size. A table that is
larger because fingerprints cluster is dealt again by more bits of its segment, until it is small or the segment is used up; only where so
many fingerprints agree in all of a segment is a table cut into chunks, and each pair of chunks is a task of its own. Tasks return
a spanning forest of the verified links (nearest links first), not the links, so a dense group of copies costs a
linear number of rows; the components are those of all links.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, log2

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, connected_components, linked_in_buckets, salted_lookup, small_batches, stage, unstage

#: Aimed rows of a route's table, and those above which it is cut into chunks.
TABLE_ROWS, CHUNK_ROWS = 8192, 65536
#: Candidate pairs verified at once in a task.
PAIRS_AT_ONCE = 1 << 21


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each space-joined shingle of ``width`` words, A-Z lower-cased, repeats included; shorter texts are one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n, digest = max(1, len(words) - width + 1), xxhash.xxh64_intdigest
    stops = (ends[width - 1 :] if len(words) >= width else ends[-1:]) - 1
    return np.fromiter((digest(line[i:j], seed) for i, j in zip(starts[:n].tolist(), stops.tolist(), strict=True)), np.uint64, n)


def simhash(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes; 0 without hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        total += np.unpackbits(hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * total > len(hashes), bitorder="little") if len(hashes) else np.zeros(8, np.uint8)
    return int(bits.view("<i8")[0])


def fingerprint(text, width: int):
    """Column of 64-bit fingerprints (bigint, the bits of the unsigned value)."""

    @F.pandas_udf(T.LongType())
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(shingle_hashes(t, width)) for t in texts], dtype="int64")

    return udf(text)


def segments_for(distance: int, count: int) -> list[tuple[int, int, int]]:
    """(shift, bits, radius) of each segment: radii sum to distance + 1 - count, widths to 64, both as even as can be."""
    if distance + 1 < count:
        raise ValueError("more segments than distance + 1 are of no use")
    out, shift = [], 0
    for i in range(count):
        bits = 64 // count + (i >= count - 64 % count)
        radius = (distance + 1 - count) // count + (i < (distance + 1 - count) % count)
        out.append((shift, bits, radius))
        shift += bits
    return out


def _ball(bits: int, radius: int) -> list[tuple[int, int]]:
    """(mask, number of set bits) of all masks of at most ``radius`` of ``bits`` bits."""
    return [(sum(1 << b for b in picked), k) for k in range(min(bits, radius) + 1) for picked in combinations(range(bits), k)]


class _Forest:
    """Union-find over positions; ``add`` returns which of the given links join two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n, dtype=np.int64)

    def roots(self, at: np.ndarray) -> np.ndarray:
        top = self.up[at]
        while len(top) and (above := self.up[top] != top).any():
            top[above] = self.up[top[above]]
        self.up[at] = top
        return top

    def _root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = int(self.up[x])
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        kept = []
        todo = np.arange(len(a))
        while len(todo):
            ra, rb = self.roots(a[todo]), self.roots(b[todo])
            todo = todo[ra != rb]
            # a slice at a time, so that most links of a dense group fall to the vectorised test above
            for i in todo[:2048].tolist():
                x, y = self._root(int(a[i])), self._root(int(b[i]))
                if x != y:
                    self.up[max(x, y)] = min(x, y)
                    kept.append(i)
            todo = todo[2048:]
        return np.array(kept, np.int64)


def _links(table: np.ndarray, probes: np.ndarray, spent: np.ndarray, shift: int, bits: int, radius: int, route_bits: int, distance: int):
    """Spanning forest (a, b, bits) of the links between one route's table and its probes. All arrays are uint64."""
    low_bits = bits - route_bits
    low = lambda x: ((x >> np.uint64(shift)) & np.uint64((1 << low_bits) - 1)).astype(np.int64)
    table = np.unique(table)
    table = table[np.argsort(low(table), kind="stable")]
    keys = low(table)
    every = np.unique(np.concatenate((table, probes)))
    forest = _Forest(len(every))
    out = []
    balls = {k: np.array([m for m, n in _ball(low_bits, radius) if n <= radius - k], np.int64) for k in range(radius + 1)}
    for k, ball in balls.items():
        own = np.unique(probes[spent == k])
        step = max(1, PAIRS_AT_ONCE // max(1, len(ball)))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            asked = (low(part)[:, None] ^ ball[None, :]).ravel()
            lo, hi = np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")
            hit = np.flatnonzero(hi > lo)
            lo, counts, who = lo[hit], (hi - lo)[hit], hit // len(ball)
            cuts = np.cumsum(counts)
            first = 0
            while first < len(hit):
                done = cuts[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(cuts, done + PAIRS_AT_ONCE, "right")))
                n = counts[first:last]
                a = np.repeat(part[who[first:last]], n)
                b = table[np.repeat(lo[first:last] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
                d = np.bitwise_count(a ^ b)
                near = np.flatnonzero((d <= distance) & (a != b))
                near = near[np.argsort(d[near], kind="stable")]
                if len(near):
                    a, b, d = a[near], b[near], d[near]
                    kept = forest.add(np.searchsorted(every, a), np.searchsorted(every, b))
                    out.append(np.stack((a[kept].view(np.int64), b[kept].view(np.int64), d[kept].astype(np.int64))))
                first = last
    return np.concatenate(out, axis=1) if out else np.empty((3, 0), np.int64)


def _of_segment(values: list[int]) -> Column:
    """The value of the row's segment."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), F.col("seg") + 1)


def _deepened(dealt: DataFrame, routes: DataFrame, plan: list[tuple[int, int, int]]) -> DataFrame:
    """dealt with the rows of ``routes`` dealt again by ``more`` further bits of their segments; what is left of a radius is spent on them, too."""
    after = _of_segment([shift + bits for shift, bits, _ in plan]) - F.col("depth") - F.col("more")
    own = F.call_function("shiftrightunsigned", F.col("fp"), after).bitwiseAND(F.expr("shiftleft(1L, more) - 1L"))
    # the masks of ``more`` bits are those below 2^more of the masks of all bits
    radius = max(r for _, _, r in plan)
    ball = F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.lit(k).alias("k")) for m, k in _ball(max(bits for _, bits, _ in plan), radius)))
    fits = F.filter(ball, lambda x: (x["m"] < F.expr("shiftleft(1L, more)")) & (F.col("spent") + x["k"] <= _of_segment([r for _, _, r in plan])))
    to = F.transform(fits, lambda x: F.struct(
        (F.col("depth") + F.col("more")).alias("depth"), F.expr("shiftleft(route, more)").bitwiseOR(own.bitwiseXOR(x["m"])).alias("route"), (F.col("spent") + x["k"]).alias("spent"),
    ))
    same = F.array(F.struct("depth", "route", "spent"))
    joined = dealt.join(routes, ["seg", "depth", "route"], "left")
    return joined.select("fp", "seg", F.explode(F.when(F.col("more").isNull(), same).otherwise(to)).alias("r")).select("fp", "seg", "r.*")


def hamming_forest(prints: DataFrame, *, distance: int, segments: int) -> DataFrame:
    """(a, b, bits): verified links between the distinct bigints of column fp, enough of them to connect what all links connect."""
    plan = segments_for(distance, segments)
    n = prints.count()
    rows = []
    for s, (shift, bits, radius) in enumerate(plan):
        depth = min(bits, max(4, ceil(log2(max(1, n) / TABLE_ROWS)) if n > TABLE_ROWS else 0))
        top = F.shiftrightunsigned("fp", shift + bits - depth).bitwiseAND(F.lit((1 << depth) - 1))
        rows += [F.struct(F.lit(s).alias("seg"), F.lit(depth).alias("depth"), top.bitwiseXOR(F.lit(mask)).cast("long").alias("route"), F.lit(k).alias("spent")) for mask, k in _ball(depth, radius)]
    key = ["seg", "depth", "route"]
    dealt = prints.select("fp", F.explode(F.array(*rows)).alias("r")).select("fp", "r.*")
    while True:
        big = stage(dealt.where("spent = 0").groupBy(*key).count().where(F.col("count") > CHUNK_ROWS), "overfull")
        left = _of_segment([bits for _, bits, _ in plan]) - F.col("depth")
        open_ = big.where(left > 0)
        if open_.isEmpty():
            break
        dealt = _deepened(dealt, open_.select(*key, F.least(left, F.greatest(F.lit(1), F.ceil(F.log2(F.col("count") / TABLE_ROWS)).cast("int"))).alias("more")), plan)
    # whole segments that so many fingerprints share are cut into chunks
    big = big.select(*key, F.ceil(F.col("count") / CHUNK_ROWS).cast("int").alias("chunks"))
    dealt = dealt.join(big, key, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine, all_chunks = F.pmod(F.xxhash64("fp"), "chunks").cast("int"), F.sequence(F.lit(0), F.col("chunks") - 1)
    pair = lambda i, j, home: F.named_struct(F.lit("i"), i, F.lit("j"), j, F.lit("home"), F.lit(home))
    cells, home = F.transform(all_chunks, lambda i: pair(i, mine, False)), F.transform(all_chunks, lambda j: pair(mine, j, True))
    dealt = dealt.select(*key, "fp", "spent", F.explode(F.when(F.col("spent") == 0, F.concat(cells, home)).otherwise(cells)).alias("c"))
    dealt = dealt.select(*key, "c.i", "c.j", "c.home", "fp", "spent")

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        shift, bits, radius = plan[int(pdf["seg"].iat[0])]
        home, fp = pdf["home"].to_numpy(bool), pdf["fp"].to_numpy("int64").view(np.uint64)
        out = _links(fp[home], fp[~home], pdf["spent"].to_numpy("int64")[~home], shift, bits, radius, int(pdf["depth"].iat[0]), distance)
        return pd.DataFrame({"a": out[0], "b": out[1], "bits": out[2].astype("int32")})

    return dealt.groupBy(*key, "i", "j").applyInPandas(task, "a long, b long, bits int")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4, segments: int = 3) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable over links).

    Fingerprints of ``width``-word shingles (null and empty texts: 0) link at ``distance`` or fewer differing bits. Equal
    fingerprints are one node, so exact copies cost one row. Ids may repeat: such rows have one result each. A null id gets a
    result, and never names a component unless it stands alone (then null). Other columns are ignored. An empty table gives one.
    """
    small_batches(df.sparkSession)
    docs = stage(df.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), width).alias("fp")), "fingerprints")
    prints = stage(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "prints")
    edges = hamming_forest(prints.select("fp"), distance=distance, segments=segments)
    named = prints.join(connected_components(edges), F.col("fp") == F.col("id"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stage(named, "classes")
    classes = named.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = salted_lookup(named.select("fp", "root"), "fp", "root", classes).select("fp", "component_id")
    return salted_lookup(docs, "doc_id", "fp", answer).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _shingle_set(text, width: int):
    """Column of the distinct shingle hashes of a text."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, width)).view(np.int64) for t in texts], dtype=object)

    return udf(text)


#: Bands of a text's MinHashes and rows of each: a pair at Jaccard 0.8 shares none with probability (1 - 0.8^5)^24 = 7e-5.
BANDS, BAND_ROWS = 24, 5
_MIX = np.random.default_rng(7).integers(0, 1 << 64, (2, BANDS * BAND_ROWS), np.uint64)


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key of each band of MinHashes over the shingles; one key for texts without words."""
    if not len(hashes):
        return [0]
    least = np.full(BANDS * BAND_ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[at : at + 1024, None] ^ _MIX[0]) * (_MIX[1] | np.uint64(1))).min(0), out=least)
    return [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, BAND_ROWS))]


def _bands_and_print(text, width: int):
    """Column of (bands, fp): keys of the bands of MinHashes, and the fingerprint, of the same shingles."""

    @F.pandas_udf("bands array<bigint>, fp bigint")
    def udf(texts: pd.Series) -> pd.DataFrame:
        bands, prints = [], []
        for t in texts:
            hashes = shingle_hashes(t, width)
            bands.append(np.array(band_keys(hashes), np.uint64).view(np.int64))
            prints.append(simhash(hashes))
        return pd.DataFrame({"bands": pd.Series(bands, dtype=object), "fp": pd.Series(prints, dtype="int64")})

    return udf.asNondeterministic()(text)


def _text_key(text) -> Column:
    return F.md5(F.coalesce(ascii_lower(text), F.lit("")))


def similar_groups(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, distance: int = 4, segments: int = 3
) -> DataFrame:
    """One row per distinct text: text_key (MD5), least (smallest id with it), copies (rows), root (names the group), stays (of each group, the text
    of least id).

    Fingerprints over ``width``-word shingles are searched by multi-index hashing, as in ``near_duplicates``; texts that links of ``distance`` or
    fewer differing bits lead to are compared by their shingle sets and link at a Jaccard similarity of ``similarity`` or more. As such texts often
    differ in more bits, those that share a band of MinHashes, a bucket, are compared as well where they aren't linked yet (the bands
    are made for 0.8 and above). Only links by shingle sets join groups, and no such link within a bucket is lost. Texts equal after lower-casing
    A-Z are one; two texts without words are alike. Null counts as empty, and a null id as larger than all others.
    """
    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).alias("doc_id"), _text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("t"))
    # not deterministic as far as the optimizer goes: else it runs the function once for each use of its result
    coded = docs.withColumn("c", _bands_and_print(F.col("t"), width)).select("doc_id", "text_key", "c.*")
    rows = stage(coded, "bands")
    texts = rows.groupBy("text_key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"), F.any_value("fp").alias("fp"))
    # numbers that hold once they are written
    texts = stage(texts.select(F.monotonically_increasing_id().alias("id"), "*"), "texts")
    unstage(rows)

    def verifier(ids: DataFrame):
        told = texts.join(ids, "id", "left_semi").select("id", F.col("text_key").alias("key"), "least")
        own = docs.join(told, (F.col("text_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("least")))
        sets = stage(own.select("id", _shingle_set(F.col("t"), width).alias("s")).dropDuplicates(["id"]), "sets")
        x, y = sets.select(F.col("id").alias("u"), F.col("s").alias("x")), sets.select(F.col("id").alias("v"), F.col("s").alias("y"))

        def verified(pairs: DataFrame) -> DataFrame:
            shared = pairs.join(x, "u").join(y, "v").select("u", "v", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("all"))
            return shared.where(F.col("n") >= F.lit(similarity) * (F.col("all") - F.col("n"))).select("u", "v")

        def tokens(some: DataFrame) -> DataFrame:
            # linked sets share ``similarity`` of the larger one at least
            least = F.ceil(F.size("s") * F.lit(similarity) - F.lit(1e-9))
            return sets.join(some, "id", "left_semi").select("id", F.col("s").alias("tokens"), (F.size("s") - least + 1).cast("int").alias("need"), (F.size("s") * F.lit(similarity / (1 + similarity))).alias("share"))

        return verified, tokens

    # texts of one fingerprint are likely alike, and so are the first texts of two that the search links
    prints = stage(texts.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "prints")
    found = hamming_forest(prints.select("fp"), distance=distance, segments=segments)
    for c, name in (("a", "u"), ("b", "v")):
        found = found.join(prints.select(F.col("fp").alias(c), F.col("first").alias(name)), c)
    same = salted_lookup(texts.select("id", "fp"), "id", "fp", prints.where("n > 1")).where("id != first").select(F.col("id").alias("u"), F.col("first").alias("v"))

    linked = linked_in_buckets(texts.select(F.explode(F.array_distinct("bands")).alias("bucket"), "id"), verifier, found.select("u", "v").unionByName(same))
    unstage(prints)
    rooted = texts.drop("bands", "fp").join(linked, "id", "left").select("id", "text_key", "least", "copies", F.coalesce("root", "id").alias("root"))
    rooted = stage(rooted, "rooted")
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "id")).alias("best"))
    return salted_lookup(rooted, "id", "root", best).select("text_key", "least", "copies", "root", (F.col("id") == F.col("best.id")).alias("stays"))


def drop_near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df with one row of each group of ``similar_groups``: that of the smallest id; all columns."""
    stays = similar_groups(df, id_col=id_col, text_col=text_col, **options).where("stays")
    stays = stage(stays.select(F.col("text_key").alias("__near_stays"), F.col("least").alias("__near_least"), F.col("copies").alias("__near_copies")), "stays")
    keyed = df.withColumn("__near_key", _text_key(F.col(text_col)))
    own = keyed.join(stays, (F.col("__near_key") == F.col("__near_stays")) & F.col(id_col).eqNullSafe(F.col("__near_least")))
    # only texts of several rows can have one of them twice
    if not stays.where("__near_copies > 1").isEmpty():
        own = own.where("__near_copies = 1").unionByName(own.where("__near_copies > 1").dropDuplicates(["__near_key"]))
    return own.select(*df.columns)
