import gzip
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tesserae.llm.pii import KINDS, PATTERNS, find_pii, joined_spans, sanitise
from tesserae.llm.sharding import assign_shards, write_shards
from tesserae.llm.warc import WarcReader, archived_pages, read_warc, write_warc

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, digits[::-1])))
    return total % 10 == 0


def brute_spans(text):
    out = []
    for k, kind in enumerate(KINDS[:4]):
        for m in PLAIN[kind].finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


ODD = [
    "a@b.c%d@e.f", "x@y.z..q@r.s", "a@b..c", "a@-.x.", "a@b.c.", "..@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256 000255.1.1.1", "+1 (234) 567-8901.", "+1((((", "+12+34567890123",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111  1111 1111 1111", "1-2-3-", "é4111111111111111é user.name+tag@ex-am.ple.co.uk", "😀 10.0.0.1\n10.0.0.1 +49 170 1234567",
    "a" * 70_000, "1" * 70_000, "1." * 30_000, "1 " * 30_000, "a@" + "b." * 20_000 + "c", "+" * 5000 + "1" + "-" * 5000, "a@b.c" * 3000,
]


def test_base_spans_equal_plain_patterns(docs, awkward):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("a.1@+- 4\n()%é25") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    rows = list(enumerate(texts)) + [(i, t) for i, t in awkward]
    got = find_pii(docs(rows)).select("doc_id", joined_spans("spans").alias("s")).collect()
    assert Counter((r.doc_id, r.s) for r in got) == Counter((i, brute_spans(t)) for i, t in rows)


def test_words_that_give_an_entity_away(docs):
    rng = random.Random(1)
    common = ["the", "house", "and", "river", "went"]
    filler = lambda: " ".join(rng.choice(common) + str(rng.randint(0, 3)) for _ in range(8))
    rows = [(i, f"{filler()} zorblax {i % 50} mail me@corp.example.com {filler()}\nzorblax alone {filler()}" if i % 10 == 0 else filler()) for i in range(200)]
    rows.append((999, "quux one@else.org\nquux one@else.org"))
    found = {r.doc_id: r for r in find_pii(docs(rows), share=0.8).collect()}
    terms = {x.v for r in found.values() for x in r.spans if x.k == 4}
    lines = [l for _, t in rows for l in t.split("\n")]
    has = lambda w, of: [l for l in of if w in re.findall(r"[^\x20\x09-\x0D]+", l)]
    own = [l for l in lines if "me@corp.example.com" in l]
    info = math.log2(len(lines) / len(own))
    told = lambda w: math.log2(len(lines) * len(has(w, own)) / len(own) / len(has(w, lines)))
    expected = {w for l in own for w in l.split() if "@" not in w and len(set(has(w, own))) >= 3 and told(w) >= 0.8 * info}
    assert terms == expected and "mail" in terms and not terms & set(common)
    clean = {r.doc_id: r.text for r in sanitise(docs(rows), share=0.8).collect()}
    assert "[TERM] [EMAIL]" in clean[0] and "mail" not in clean[0].split("\n")[0] and clean[1] == rows[1][1] and clean[999] == "quux [EMAIL]\nquux [EMAIL]"
    assert find_pii(docs([])).count() == 0 and sanitise(docs([(1, None)])).first().text is None


def test_copies_of_a_line_do_not_decide_disclosure(docs):
    rng = random.Random(3)
    filler = lambda: " ".join(f"f{rng.randint(0, 10**6)}" for _ in range(4))
    rows = [f"{filler()} zorblax hot me@corp.example.com {i}x" for i in range(10)] + [filler() for _ in range(60)] + [f"{filler()} hot" for _ in range(6)]
    # a copied line with the word hides it, one with word and entity gives an ordinary word away
    rows += ["zorblax alone"] * 300 + ["hot me@corp.example.com"] * 200
    lines = set(rows)
    has = lambda w: {l for l in lines if w in l.split()}
    own = has("me@corp.example.com")
    told = lambda w: math.log2(len(lines) * len(has(w) & own) / len(own) / len(has(w))) / math.log2(len(lines) / len(own))
    expected = {w for l in own for w in l.split() if "@" not in w and len(has(w) & own) >= 3 and told(w) >= 0.9}
    found = find_pii(docs([(i, t) for i, t in enumerate(rows)])).collect()
    assert {x.v for r in found for x in r.spans if x.k == 4} == expected == {"zorblax"}


def test_words_of_an_entity_are_terms_outside_it(docs):
    rng = random.Random(5)
    filler = lambda: " ".join(f"f{rng.randint(0, 10**6)}" for _ in range(4))
    rows = [f"{filler()}\nx {filler()} schmidt anna.schmidt@example.com 4111 1111 1111 1111 of 1111 (anna.schmidt@example.com) schmidt" for _ in range(8)] + [filler() for _ in range(80)]
    for r in find_pii(docs(list(enumerate(rows)))).collect():
        text = rows[r.doc_id]
        base = [(x.s, x.e) for x in r.spans if x.k < 4]
        words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\S+", text) if m[0] in {"x", "schmidt", "1111", "of"}]
        free = {w for w in words if not any(s < w[1] and e > w[0] for s, e in base)}
        assert {(x.s, x.e, x.v) for x in r.spans if x.k == 4} == free
        assert r.doc_id >= 8 or {w[2] for w in free} == {"x", "schmidt", "1111", "of"} and len(base) == 3
    clean = sanitise(docs(list(enumerate(rows)))).where("doc_id = 0").first().text
    assert "schmidt" not in clean and "([EMAIL])" in clean


def brute_shards(rows, limit, seed="shard"):
    hashed = [(i, int(hashlib.md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:15], 16), len((t or "").encode())) for i, t in rows]
    out = Counter()
    for i, h, _ in hashed:
        for depth in range(61):
            own = [(g, b) for _, g, b in hashed if g >> 60 - depth == h >> 60 - depth]
            size = sum(b for _, b in own)
            if size <= limit or len({g for g, _ in own}) == 1:
                out[(i, f"{h >> 60 - depth:0{depth}b}" if depth else "", depth, size, len(own), size <= limit)] += 1
                break
    return out


@pytest.mark.parametrize("limit", [40, 300, 10**9])
def test_shards_equal_brute_force(docs, awkward, limit, tmp_path):
    rng = random.Random(limit)
    rows = [(rng.choice([i, 7, 7]), "é" * rng.randint(0, 60)) for i in range(120)] + awkward
    got = assign_shards(docs(rows), limit=limit).collect()
    assert Counter((r.doc_id, r.shard, r.shard_depth, r.shard_bytes, r.shard_docs, r.shard_fits) for r in got) == brute_shards(rows, limit)
    if limit == 300:
        write_shards(docs(rows), f"{tmp_path}/out", limit=limit)
        back = docs(rows).sparkSession.read.parquet(f"{tmp_path}/out")
        assert back.count() == len(rows) and back.select("shard").distinct().count() == len({r.shard for r in got})
    assert assign_shards(docs([])).count() == 0


PAGES = "page_id long, url string, html string, payload string, digest string"


def brute_pages(rows, least=1000):
    first = {}
    for i, h in rows:
        b = (h or "").encode()
        if len(b) >= least and i is not None:
            first[b] = max(first.get(b, i), i)
    out = Counter()
    for i, h in rows:
        b = (h or "").encode()
        again = first.get(b) is not None and i != first[b]
        out[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", first[b] if again else None)] += 1
    return out


def test_archives_round_trip(spark, tmp_path):
    rows = [(i, "x" * (900 + i // 4 * 60) + "é\r\n\r\n") for i in range(40)] + [(50, None), (51, ""), (None, "y" * 2000), (52, "y" * 2000), (53, "z" * 70_000), (53, "z" * 70_000), (54, "z" * 70_000)]
    df = spark.createDataFrame([(i, None if i == 3 else f"http://x/{i}\r\nX: y", h, "a", "b") for i, h in rows], PAGES).repartition(3)
    got = archived_pages(df, f"{tmp_path}/a").collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute_pages(rows)
    records = read_warc(spark, f"{tmp_path}/a")
    assert records.count() == len(rows)
    plan = records.where("record_type = 'revisit' and target_uri like 'http%'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "") and records.where("record_type in ('revisit')").where("payload_length > 1300").count() > 0
    assert records.where("target_uri is null").count() == 1 and records.where("payload_digest = 'no'").count() == 0
    empty = archived_pages(df.where("false"), f"{tmp_path}/none")
    assert empty.count() == 0
    members = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "a").glob("*.warc.gz"))
    assert members.count(b"WARC/1.1\r\n") == len(rows)


def test_damaged_members_are_reported_and_passed_over(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://x/{i}", "z" * 500 + str(i), "a", "b") for i in range(6)], PAGES).coalesce(1)
    assert archived_pages(df, f"{tmp_path}/a").count() == 6
    (file,) = (tmp_path / "a").glob("*.warc.gz")
    data = bytearray(file.read_bytes())
    second = data.index(b"\x1f\x8b\x08\x04", 10)
    data[second + 40 : second + 60] = bytes(20)
    file.write_bytes(bytes(data))
    got = read_warc(spark, f"{tmp_path}/a")
    assert Counter(r.record_type for r in got.collect()) == Counter({"response": 5, "damaged": 1})
    assert got.where("record_type = 'response'").count() == 5


def test_reads_what_others_write(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi</p>"
    one = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a/\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    two = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Type: text/plain\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "plain.warc").write_bytes(one + two + one)
    (tmp_path / "packed.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two * 1) + gzip.compress(one))
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(two) + gzip.compress(one)[:30])
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(two + one + two))
    long = one.replace(b"Content-Type: text/html", b"Content-Type: text/html\r\nContent-Length: 9\r\nX: " + b"y" * 9000)
    long = long.replace(b"Content-Length: %d" % len(block), b"Content-Length: %d" % (len(block) + 9024), 1)
    (tmp_path / "long.warc.gz").write_bytes(gzip.compress(long))
    every = read_warc(spark, str(tmp_path)).collect()
    assert [(r.file.rsplit("/", 1)[1], r.payload) for r in every if r.record_type == "damaged"] == [("cut.warc.gz", None)]
    assert Counter((r.record_type, bytes(r.payload)) for r in every if "whole" in r.file or "long" in r.file) == Counter({("response", b"<p>hi</p>"): 2, ("resource", b"hello"): 2})
    assert [r.payload_length for r in read_warc(spark, str(tmp_path), payload=False).where("file like '%long%'").collect()] == [9]
    rows = [r for r in every if r.record_type != "damaged" and "whole" not in r.file and "long" not in r.file]
    assert Counter((r.file.rsplit("/", 1)[1], r.record_type, bytes(r.payload)) for r in rows) == Counter(
        {("plain.warc", "response", b"<p>hi</p>"): 2, ("plain.warc", "resource", b"hello"): 1, ("packed.warc.gz", "response", b"<p>hi</p>"): 2, ("packed.warc.gz", "resource", b"hello"): 1, ("cut.warc.gz", "resource", b"hello"): 1}
    )
    assert all(r.payload is None for r in read_warc(spark, str(tmp_path), payload=False).collect())
    assert [len(p.paths) for p in WarcReader({"path": str(tmp_path)}).partitions()] == [5]
    with pytest.raises(Exception):
        write_warc(spark.sql("select raise_error('lost') as record_type"), f"{tmp_path}/b")
    assert not list((tmp_path / "b").rglob("*.warc.gz"))


def test_equal_texts_are_sanitised_wherever_they_are(docs):
    rows = [(i, "mail a@b.example now") for i in range(200)] + [(None, "mail a@b.example now"), (300, None), (301, ""), (302, "x")]
    got = sanitise(docs(rows)).collect()
    assert len(got) == len(rows) and {r.text for r in got if r.doc_id is None or r.doc_id < 200} == {"mail [EMAIL] now"} and {r.doc_id: r.text for r in got if r.doc_id and r.doc_id >= 300} == {300: None, 301: "", 302: "x"}
