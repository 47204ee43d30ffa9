"""Personal data: patterns, and information-theoretic sanitisation of the words that give them away.

Patterns find e-mail addresses, IP addresses, card and phone numbers. The protected entities are those values, which must not be told by the words
beside them, and the four kinds: that a line has an address or a number must not be told either once that is gone. Over the corpus's distinct
lines, df counts lines: an entity's information is IC(e) = log2(N / df(e)), and a word discloses PMI(e; t) = log2(N df(e, t) / (df(e) df(t))) of
it. A word that discloses at least a given share of IC(e), in enough different lines, is sanitised where it stands in a line with e.

Everything is built-in functions. No pattern matches across lines. The patterns are written so that no search is worse than linear and no
repeated group recurs in the matcher, however long a run of letters or digits is; they match what the plain forms beside them match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, salted_lookup, stage

KINDS = ["email", "ip", "card", "phone", "term"]
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@(?=[A-Za-z0-9-]+\.[A-Za-z0-9-])[A-Za-z0-9-](?:[A-Za-z0-9.-](?<!\.\.))*[A-Za-z0-9-]",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[0-9\x20-](?<![\x20-]{2}))*[0-9]",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which a text has no match, or None.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_SPAN = "array<struct<s:int,k:int,e:int,v:string>>"


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        digits = F.regexp_replace(v, "[ -]", "")
        return F.when(F.length(digits).between(12, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(v, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _bind(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def _running(lengths: Column) -> Column:
    """Running sums of an array of integers, in steps of 64: what a place needs is the sum of its step so far and that of the steps before."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: (x + y).cast("int"))
    within = lambda x: F.transform(x["own"], lambda _, k: (x["before"] + total(F.slice(x["own"], 1, k + 1))).cast("int"))
    before = lambda steps, sums: F.transform(steps, lambda own, i: F.struct(total(F.slice(sums, 1, i)).alias("before"), own.alias("own")))
    steps = _bind(lengths, lambda a: F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / 64).cast("int")), lambda i: F.slice(a, i * 64 + 1, 64)))
    return _bind(steps, lambda st: _bind(F.transform(st, total), lambda sums: F.flatten(F.transform(before(st, sums), within))))


def _located(text: Column, pattern: Column, kind: int) -> Column:
    """Spans of all matches, by code points: what lies between matches, and the matches, give the starts."""
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    ends = _running(F.zip_with(found, F.slice(between, 1, F.size(found)), lambda v, gap: F.length(v) + F.length(gap)))
    spans = F.zip_with(ends, found, lambda e, v: F.struct((e - F.length(v)).alias("s"), F.lit(kind).alias("k"), e.alias("e"), v.alias("v")))
    return F.when(F.size(found) > 0, spans).otherwise(F.array()).cast(_SPAN)


def base_spans(text: Column) -> Column:
    """Array of (s, k, e, v), by start and then kind: leftmost matches of each pattern, less those that fail its test."""

    def of(k: int, kind: str) -> Column:
        spans, needs = F.filter(_located(text, F.lit(PATTERNS[kind]), k), lambda x: _valid(kind, x["v"])), NEEDS[kind]
        return F.when(F.contains(text, F.lit(needs)), spans).otherwise(F.array().cast(_SPAN)) if needs else spans

    return F.array_sort(F.concat(*(of(k, kind) for k, kind in enumerate(KINDS[:4]))))


def _bare(line: Column, start: Column, spans: Column) -> Column:
    """The line with a line feed, which no line has, in place of each span. Spans count from ``start`` characters before the line."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        s, e = x["s"] - start, x["e"] - start
        gap = F.substring(line, acc["at"] + 1, F.greatest(s - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], e).cast("int").alias("at"), F.concat(acc["out"], gap, F.lit("\n")).alias("out"))

    return F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substring(line, a["at"] + 1, F.length(line))))


def _starts(lines: Column) -> Column:
    """Array of (start, line)."""
    return F.zip_with(_running(F.transform(lines, lambda x: F.length(x) + 1)), lines, lambda e, x: F.struct((e - F.length(x) - 1).alias("start"), x.alias("line")))


def _entities(spans: Column) -> Column:
    """The values, as kind:value, and the kinds."""
    names = F.array(*map(F.lit, KINDS))
    of = F.transform(spans, lambda x: F.element_at(names, x["k"] + 1))
    return F.array_distinct(F.concat(F.zip_with(of, spans, lambda n, x: F.concat(n, F.lit(":"), x["v"])), of))


def _words(line: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(line, F.lit(WORD), F.lit(0)))


def _free_words(bare: Column) -> Column:
    """Words that no span touches: those not beside a line feed."""
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(rf"(?<!\n)(?<!{WORD[:-1]}){WORD}+(?!\n)"), F.lit(0)))


def disclosing_terms(own: DataFrame, texts: DataFrame, *, share: float, support: int) -> DataFrame:
    """(line_key, terms): the words of a line that disclose ``share`` or more of the information of one of its entities, in ``support`` or more
    distinct lines with it.

    own: (line_key, found, words) of the distinct lines with entities, found being the entities and words those that no base span touches; texts: column t
    of all texts, over whose distinct lines words and lines are counted. A line is shuffled once, after each task has dropped its own repeats.
    What is counted is summed in each task before it is shuffled, so an entity that many lines have, as a kind is, is one row a task.
    """
    found = own.select("line_key", "words", F.explode("found").alias("v"))
    often = found.groupBy("v").agg(F.count("*").alias("df_v")).where(F.col("df_v") >= support)
    beside = salted_lookup(found, "line_key", "v", often).where("df_v is not null").select("line_key", "v", "df_v", F.explode("words").alias("t"))
    beside = stage(beside, "beside")
    pairs = stage(beside.groupBy("v", "df_v", "t").agg(F.count("*").alias("df_vt")).where(F.col("df_vt") >= support), "cooccur")
    every = texts.select(F.explode(F.split("t", "\n", -1)).alias("line")).withColumn("line_key", F.md5("line"))
    once = every.groupBy("line_key").agg(F.any_value("line").alias("line"))
    words = stage(once.select(F.explode(F.concat(_words(F.col("line")), F.array(F.lit("\n")))).alias("t")).groupBy("t").agg(F.count("*").alias("df_t")), "words")
    n = words.where(F.col("t") == "\n").agg(F.coalesce(F.sum("df_t"), F.lit(0))).first()[0]  # no word is a line feed: it counts the lines
    info = F.log2(F.lit(float(n)) / F.col("df_v"))
    mutual = F.log2(F.lit(float(n)) * F.col("df_vt") / F.col("df_v") / F.col("df_t"))
    told = pairs.join(words, "t").where((info > 0) & (mutual >= share * info)).select("v", "t", F.lit(True).alias("told"))
    pair = F.struct("v", "t")
    met = salted_lookup(beside.select("line_key", "t", pair.alias("vt")), "line_key", "vt", told.select(pair.alias("vt"), "told")).where("told")
    return met.groupBy("line_key").agg(F.collect_set("t").alias("terms"))


def find_pii(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: float = 0.9, support: int = 3) -> DataFrame:
    """One row per input row: doc_id, key (SHA-256 of the text), spans (array of (s, k, e, v), k numbering KINDS, sorted).

    Base spans are always there; terms are added by disclosure, where no base span touches them.
    Null counts as empty. Rows of one text have the same spans, whatever their ids. Other columns are ignored. An empty table gives an empty one.
    """
    texts = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # spans never cross a line feed, so those of a line are found in it alone
    found = texts.select("doc_id", "t", base_spans(F.col("t")).alias("spans"))
    lines = F.when(F.size("spans") > 0, F.split("t", "\n", -1)).otherwise(F.array().cast("array<string>"))
    rows = stage(found.select("doc_id", F.sha2("t", 256).alias("key"), "spans", lines.alias("lines")), "spans")
    each = rows.where("size(spans) > 0").select("key", F.explode(_starts(F.col("lines"))).alias("l")).select("key", "l.start", "l.line")
    each = each.where(F.col("line").rlike("[0-9]|@")).withColumn("spans", base_spans(F.col("line"))).where("size(spans) > 0")
    each = stage(each.select("key", "start", F.md5("line").alias("line_key"), "line", "spans"), "lines")
    own = each.groupBy("line_key").agg(F.any_value("line").alias("line"), F.any_value("spans").alias("spans"))
    own = stage(own.select("line_key", _entities(F.col("spans")).alias("found"), _free_words(_bare(F.col("line"), F.lit(0), F.col("spans"))).alias("words")), "own")
    told = stage(disclosing_terms(own, texts, share=share, support=support), "terms")
    near = salted_lookup(each, "key", "line_key", told).where("terms is not null").select("key", "start", "line", "spans", F.explode("terms").alias("t"))
    literal = F.concat(F.lit(r"(?<![^\x20\x09-\x0D])\Q"), F.replace("t", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![^\x20\x09-\x0D])"))
    at = near.select("key", "start", "spans", F.explode(_located(F.col("line"), literal, 4)).alias("x"))
    # a word is a term only where no base span touches it
    at = at.where("not exists(spans, b -> b.s < x.e and b.e > x.s)").select("key", F.struct((F.col("x.s") + F.col("start")).alias("s"), F.col("x.k").alias("k"), (F.col("x.e") + F.col("start")).alias("e"), F.col("x.v").alias("v")).alias("x"))
    terms = at.groupBy("key").agg(F.collect_set("x").alias("terms"))
    full = salted_lookup(rows.select("doc_id", "key", "spans"), "doc_id", "key", terms)
    return full.select("doc_id", "key", F.array_sort(F.concat("spans", F.coalesce("terms", F.array().cast(_SPAN)))).alias("spans"))


def sanitise(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df with text_col sanitised, all other columns as they are. A null text stays null.

    What is found becomes [EMAIL] and the like, a term of digits [NUMBER], other terms [TERM]; of overlapping spans the first covers.
    """
    found = find_pii(df, id_col=id_col, text_col=text_col, **options)
    spans = found.where(F.size("spans") > 0).groupBy("key").agg(F.any_value("spans").alias("__pii_spans"))
    keyed = df.withColumn("__pii_key", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    joined = salted_lookup(keyed, id_col, "__pii_key", spans.withColumnRenamed("key", "__pii_key"))  # all empty texts have one key
    clean = F.when(F.col("__pii_spans").isNull(), F.col(text_col)).otherwise(replaced(F.col(text_col), F.col("__pii_spans")))
    return joined.withColumn(text_col, clean).select(*df.columns)


def replaced(text: Column, spans: Column) -> Column:
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        name = F.when((x["k"] == 4) & x["v"].rlike("^[0-9]+$"), "[NUMBER]").otherwise(F.element_at(names, x["k"] + 1))
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        covered = x["s"] < acc["at"]
        return F.struct(F.greatest(acc["at"], x["e"]).cast("int").alias("at"), F.when(covered, acc["out"]).otherwise(F.concat(acc["out"], gap, name)).alias("out"))

    return F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
