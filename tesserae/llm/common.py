"""Helpers shared by the corpus operators: staged tables, skew-safe lookups, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word characters: everything but ASCII white space. ``bytes.split()`` cuts UTF-8 at the same places.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where it is unset, a temporary one, in local mode only."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tesserae-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send so many rows at most to a Python worker at once, for functions whose results are larger than their texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def salted_lookup(rows: DataFrame, row_id: str, key: str, table: DataFrame, salts: int = 64) -> DataFrame:
    """Left-join ``table`` (one row a key) to ``rows``, a key of which may hold most rows.

    Rows are dealt by a hash of ``row_id`` into ``salts`` parts; each part asks for a key once, so the hot key is
    looked up ``salts`` times, and the rows then meet their answers on (salt, key), spread over the parts.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(F.col(row_id)), F.lit(salts)))
    asked = dealt.groupBy("_salt", key).agg(F.lit(1).alias("_one")).drop("_one")
    answers = asked.join(table, key, "left")
    return dealt.join(answers, ["_salt", key], "left").drop("_salt")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root): every endpoint with the smallest id it can reach, by alternating large and small stars.

    Each round links every node to the least neighbour known; rounds needed grow with the logarithm of a
    component's size. They end when links are stars: each node has one link to a smaller one, which has none. Every round is a group-by with
    map-side minima and salted lookups of those minima, so no task gets all links of a hub. Empty input gives an empty table.
    """
    cur = stage(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "cc"
    )
    while True:
        ends = cur.select(F.col("hi").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(cur.select("lo", F.lit(0), F.lit(1)))
        if not ends.groupBy("id").agg((F.sum("up") + F.max("down")).alias("n"), F.max("up").alias("up")).agg(F.count_if((F.col("up") > 0) & (F.col("n") > 1))).first()[0]:
            break
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(cur.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_lookup(both, "v", "u", least, 16).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = stage(large, "cc")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = salted_lookup(large, "lo", "hi", low, 16).select(F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        nxt = stage(small.select("e.hi", "e.lo").where("hi != lo").distinct(), "cc")
        unstage(cur)
        unstage(large)
        cur = nxt
    nodes = cur.select(F.col("hi").alias("id"), F.col("lo").alias("root"))
    return nodes.union(cur.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct())


#: Members of a bucket that are compared all with all, and of a part of a larger one that meets another part in a task; ``cell`` without a limit.
CELL_ROWS, PART_ROWS, ALL_ROWS = 16, 256, 2**63 - 1


def rarest_tokens(sets: DataFrame) -> DataFrame:
    """(bucket, id, left, share): of the ``need`` rarest tokens of each id those that another one has, from rows (id, tokens, need, share), tokens being
    distinct bigints.

    Two ids that share more than size - need of each one's tokens share one of these (prefix filter), as both take them in one order. An id that
    has less than ``need`` tokens may share none of them with its links: all such ids meet in one bucket more. Linked ids share as many tokens as
    the sum of their ``share`` says, or more; ``left`` is how many they share at most if this is the first of them (positional filter).
    """
    each = sets.select("id", "need", "share", F.explode("tokens").alias("token"))
    counts = stage(each.groupBy("token").agg(F.count("*").alias("n")), "tokens")
    ranked = each.join(counts, "token").groupBy("id").agg(F.any_value("need").alias("need"), F.any_value("share").alias("share"), F.array_sort(F.collect_list(F.struct("n", "token"))).alias("by"))
    first = F.filter(F.transform(F.slice("by", F.lit(1), F.col("need")), lambda x, i: F.struct(x["n"].alias("n"), x["token"].alias("bucket"), (F.size("by") - i).alias("left"))), lambda x: x["n"] > 1)
    first = ranked.select("id", "share", F.explode(first).alias("t")).select("t.bucket", "id", "t.left", "share")
    few = sets.where(F.size("tokens") < F.col("need")).select(F.lit(0).cast("long").alias("bucket"), "id", F.lit(1 << 30).alias("left"), "share")
    out = stage(first.unionByName(few), "rarest")
    unstage(counts)
    return out


def sharing(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct pairs (u, v) that share as many tokens as linked ones do at least: counting them is cheaper than most verifiers. sets: what
    ``rarest_tokens`` gets."""
    for c in ("u", "v"):
        pairs = pairs.join(sets.select(F.col("id").alias(c), F.col("tokens").alias(f"t{c}"), F.col("share").alias(f"s{c}")), c)
    return pairs.where(F.size(F.array_intersect("tu", "tv")) >= F.col("su") + F.col("sv") - F.lit(1e-6)).select("u", "v")


#: What keeps the links of distinct pairs (u, v), and what gives the tokens of ids, not needed where ``cell`` is ALL_ROWS.
Verifier = tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame] | None]


def linked_in_buckets(buckets: DataFrame, verifier: Callable[[DataFrame], Verifier], near: DataFrame | None = None, cell: int | None = None) -> DataFrame:
    """(id, root) of every id that a verified link reaches: its component's smallest id.

    buckets: distinct rows (bucket, id), both bigint; every link between ids of one bucket counts. ``verifier`` gets all ids that are compared
    (column id) and returns a function of distinct pairs (u, v) that keeps those which are links, and one of ids that gives their rows for
    ``rarest_tokens``. ``near``: pairs (u, v) that are likely links, or None. ``cell``: members of a bucket that are compared all with all, CELL_ROWS if
    None; more pay where crowds are families of near copies, in which every token is shared, and of ALL_ROWS none is dealt by tokens. There are
    three rounds; those after the first leave out pairs that are linked by others already:

    1. The likely links are compared, and every member with the first of its bucket.
    2. In buckets of up to ``cell`` members, all pairs are compared. Members of larger ones that aren't of one component are dealt by their rarest
       tokens, of which linked ones share one, so that no link is lost. They are compared with the first that has the token, if they can share enough.
    3. Of what is left of these, those that can share enough with another one are compared with all that aren't of their component, the crowd's
       largest component only with the others; larger crowds in pairs of parts.

    Joins by bucket are written as they are made, so that Spark splits the partitions of large buckets.
    """
    cell = cell or CELL_ROWS
    buckets = stage(buckets, "buckets")
    full = stage(buckets.groupBy("bucket").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"), "shared")
    shared = stage(buckets.join(full, "bucket"), "shared")
    unstage(buckets)
    unstage(full)
    ids = shared.select("id")
    if near is not None:
        near = stage(near, "likely")
        ids = ids.union(near.select("u")).union(near.select("v"))
    ids = stage(ids.distinct(), "ids")
    verified, tokens = verifier(ids)

    def joined(root: DataFrame | None, pairs: DataFrame) -> DataFrame:
        """root after those of the pairs that are links."""
        links = stage(verified(pairs), "links")
        if root is not None and links.count() == 0:
            unstage(links)
            return root
        new = connected_components(links if root is None else links.union(root.select("id", "root")), "u", "v")
        new = stage(new, "roots")
        unstage(links)
        if root is not None:
            unstage(root)
        return new

    def apart(rows: DataFrame, root: DataFrame) -> DataFrame:
        """rows with root and n, of the buckets that have ids of several components."""
        rows = rows.drop("first", "n", "root")
        every = stage(rows.join(root, "id", "left").select(*rows.columns, F.coalesce("root", "id").alias("root")), "apart")
        open_ = every.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high").select("bucket", "n")
        open_ = stage(open_, "open")
        out = stage(every.join(open_, "bucket"), "apart")
        unstage(every)
        unstage(open_)
        return out

    def fitting(rows: DataFrame) -> DataFrame:
        """rows that can share enough with some row of their bucket. With n and m, the bucket's rows and those that aren't of its largest component, and
        minor, whether a row is one of these: each link has one at least."""
        rows = rows.drop("n")
        least = rows.groupBy("bucket").agg(F.min("share").alias("low"), F.max(F.col("left") - F.col("share")).alias("spare"))
        least = stage(least, "least")
        fits = (F.col("left") - F.col("share") >= F.col("low") - F.lit(1e-6)) & (F.col("share") <= F.col("spare") + F.lit(1e-6))
        own = stage(rows.join(least, "bucket").where(fits).select(*rows.columns), "fitting")
        each = own.groupBy("bucket", "root").agg(F.count("*").alias("c"))
        counts = each.groupBy("bucket").agg(F.sum("c").alias("n"), (F.sum("c") - F.max("c")).alias("m"), F.max_by("root", F.struct("c", "root")).alias("major")).where("m > 0")
        counts = stage(counts, "counts")
        out = stage(own.join(counts, "bucket").withColumn("minor", F.col("root") != F.col("major")).drop("major"), "fitting")
        for done in (least, own, counts):
            unstage(done)
        return out

    def pairs_of(rows: DataFrame, *share: str) -> DataFrame:
        """(u, v), u > v: all pairs of different components of which one is minor, those of a large bucket in tasks of two parts of it. With columns
        ``left`` and ``share``, those that can share enough."""
        part = lambda n: F.ceil(F.col(n) / PART_ROWS).cast("int")
        mine, every = lambda n: F.pmod(F.xxhash64("id"), part(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), part(n) - 1))
        x = rows.where("minor").select("bucket", mine("m").alias("i"), every("n").alias("j"), "id", "root", *share)
        y = rows.select("bucket", every("m").alias("i"), mine("n").alias("j"), "id", "root", "minor", *share)
        met = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("bucket", "i", "j")]
        # two minor ones meet twice
        met += [F.col("x.root") != F.col("y.root"), ~F.col("y.minor") | (F.col("x.id") > F.col("y.id"))]
        if share:
            met.append(F.least("x.left", "y.left") >= F.col("x.share") + F.col("y.share") - F.lit(1e-6))
        return x.alias("x").join(y.alias("y"), met).select(F.greatest("x.id", "y.id").alias("u"), F.least("x.id", "y.id").alias("v"))

    likely = shared.where("id != first").select(F.col("id").alias("u"), F.col("first").alias("v"))
    if near is not None:
        likely = likely.unionByName(near.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    root = joined(None, likely.distinct())
    # a bucket of two is done by its first
    open_ = apart(shared.where("n > 2"), root)
    some = pairs_of(open_.where(f"n <= {cell}").select("*", F.col("n").alias("m"), F.lit(True).alias("minor"))).distinct()
    used = [shared, ids, open_]
    crowd = open_.where(f"n > {cell}").select("id").distinct()
    if crowd.isEmpty():
        root = joined(root, some)
    else:
        sets = stage(tokens(crowd), "sets")
        rare = rarest_tokens(sets)
        # buckets of those that are open: what is one component by now isn't compared
        rows = apart(rare, root)
        first = stage(rows.groupBy("bucket").agg(F.min(F.struct("id", "root", "left", "share")).alias("first")), "first")
        enough = F.least("left", "first.left") >= F.col("share") + F.col("first.share") - F.lit(1e-6)
        star = rows.join(first, "bucket").where(enough & (F.col("root") != F.col("first.root"))).select(F.col("id").alias("u"), F.col("first.id").alias("v"))
        root = joined(root, some.unionByName(sharing(star.distinct(), sets)).distinct())
        fit = fitting(apart(rows, root).where("n > 2"))
        root = joined(root, sharing(pairs_of(fit, "left", "share").distinct(), sets))
        used += [sets, rare, rows, first, fit]
    for done in used + ([near] if near is not None else []):
        unstage(done)
    return root
