import hashlib
import zlib

import pytest
from pyspark.sql import types as T

from tesserae.llm import trie

TURNS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    # names that the operator uses itself
    T.StructField("c", T.StringType()), T.StructField("pos", T.StringType()), T.StructField("k", T.StringType()),
])


def brute(rows):
    """Nodes by their definition: (conv_id, depth) -> everything else."""
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append(((t is not None, t or 0, key), (role, text)))
    own = {c: [v for _, v in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = {}
    for node, cs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) > len(n) for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = ",".join(str(c) for c in sorted(c for c in cs if paths[c] == node))
        out[min(cs), len(node)] = (min(members[node[:-1]]) if node else None, len(cs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def result(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS)
    got = trie.opening_trie(df).collect()
    made = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(made) == len(got)
    return made


def made_up(n, long):
    """Conversations of a few common openings; some without turns of their own, nulls, ties, repeated rows, and one long one."""
    rows = []
    for c in range(n):
        x = zlib.crc32(f"x{c}".encode())
        for t in range(x % 7):
            rows.append((c - 20, t, ("user", None, "bot")[(x >> t) % 3], ("hi", "", None, f"é{x % 3}", "ä" * 40)[(x >> (2 * t)) % 5]))
    rows += [(7, None, "user", "first"), (7, 0, "user", "tie"), (7, 0, "user", "tie"), (7, 0, "bot", "tie"), (None, 1, "user", "nobody"), (250, None, None, None)]
    rows += [(3000 + k % 2, t, "user", f"turn {t // 2}") for k in range(2) for t in range(long)]
    return rows


def test_against_definition(spark):
    rows = made_up(240, 60)
    assert result(spark, rows) == brute(rows)


def test_conversations_of_many_blocks_and_lists_of_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 4)
    monkeypatch.setattr(trie, "CHUNK_BITS", 2)
    rows = made_up(150, 30)
    assert result(spark, rows) == brute(rows)


def test_one_conversation_repeated(spark):
    """Many equal conversations: all members of every node, one list of all ids at the end."""
    rows = [(c, t, "user", f"turn {t}") for c in range(1000, 2300) for t in range(3)]
    got = result(spark, rows)
    every = hashlib.sha256(",".join(map(str, range(1000, 2300))).encode()).hexdigest()
    assert got[1000, 3] == (1000, 1300, 0, 1, 1299 * 6, every) and got[1000, 0][1:5] == (1300, 1, 1, 1299 * 18)


def test_empty_table(spark):
    assert result(spark, []) == {} and result(spark, [(None, 0, "a", "b")]) == {}


def test_whole_conversations(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "a"), (3, 0, "u", "c")]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS)
    got = trie.prefix_trie(*trie.whole_conversations(trie.ordered_turns(df)))
    assert sorted((r.conv_id, r.depth, r.n_convs, r.n_children, r.saved_tokens) for r in got.collect()) == [(1, 0, 3, 2, 1), (1, 1, 2, 1, 1), (1, 2, 1, 0, 0), (3, 1, 1, 0, 0)]


def test_sql_has_the_same_crc():
    import duckdb

    from tesserae.llm.queries import _CRC

    for c in (0, 7, 12345, 999999999, -31):
        assert duckdb.sql(f"SELECT {_CRC} FROM (SELECT {c} AS c)").fetchall()[0][0] == zlib.crc32(str(c).encode())


@pytest.mark.parametrize("c", [-250, -5, 99, 100, 12345])
def test_families_follow_the_remainder(c):
    assert (c - int(c / 100) * 100) == (abs(c) % 100) * (1 if c >= 0 else -1)
