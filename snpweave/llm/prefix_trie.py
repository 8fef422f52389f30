"""A trie of conversations by their turns, built a level at a time.

Turns get their places by a range sort, so a conversation of very many turns is numbered by many tasks. Equal rebuilt
conversations (by count and two 64-bit sums over place and turn) are one class, named by its smallest conv_id and
weighted by its size. From the root on, each level groups the live classes by (parent node, next turn): the smallest id
names the node, and the classes take it from a join, so a turn that a third of all share is pre-aggregated and its join
can be split. A class alone in its node shares nothing further down: the rest of its path is a chain that is written in
one step. So there is one round for each level that different conversations share, not for each turn of the longest
one. Then levels are joined from the deepest up: leaves and savings of the children are added to their parent's.

A turn is the md5 of its role and text. The hash of a class's ids streams over the sorted ids in constant memory.

Turns of a conversation with equal `turn` are ordered by role, then text. Null role or text: empty. Rows with a null conv_id
belong to no conversation. Repeated rows are turns each. Ids below 0: the remainder has the sign of the id. An empty table
gives no rows, not even a root. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snpweave.llm.common import materialize, materialize_and_see
from snpweave.llm.prefix import running_total_in

SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
CHUNK = 4096  # turns of a path that are summed together


def placed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, key, n_bytes): each turn's place from 0, what it says and how long its text is."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", blank("role").alias("role"), blank("text").alias("text")).where("conv_id IS NOT NULL")
    key = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    ordered = rows.orderBy("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    lined = ordered.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("line"), key.alias("key"), F.octet_length("text").cast("long").alias("n_bytes"), F.lit(1).alias("one"))
    return running_total_in(materialize(lined, "turns"), "one", ["conv_id"], "part", ["line"], "pos").select("conv_id", "pos", "key", "n_bytes")


def rebuilt(turns: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first h turns of the family's first one: their turns, and (conv_id) of all."""
    turns = materialize(turns, "placed")
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h")
    named = convs.select("conv_id", h, (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    sized = named.join(convs.select(F.col("conv_id").alias("base"), F.col("own").alias("n_base")), "base", "left").select("conv_id", "h", "base", F.least("h", F.coalesce("n_base", F.lit(0))).alias("head"))
    first = sized.where("head > 0").select("conv_id", "base", "head").join(turns.withColumnRenamed("conv_id", "base"), "base").where("pos < head")
    rest = turns.join(sized, "conv_id").where("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("head"))
    cols = ["conv_id", "pos", "key", "n_bytes"]
    return materialize(first.select(*cols).unionByName(rest.select(*cols)), "rebuilt"), sized.select("conv_id")


def hashed_ids(members: DataFrame) -> DataFrame:
    """(rep, ends_sha256) of (rep, conv_id): the ids in ascending order, comma-joined. The ids stream by, class after class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def out(reps: list, hashes: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(hashes, pa.string())], names=["rep", "ends_sha256"])

        for batch in batches:
            reps, hashes = [], []
            for rep, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rep != now:
                    if state:
                        reps.append(now)
                        hashes.append(state.hexdigest())
                    now, state = rep, hashlib.sha256(str(conv).encode())
                else:
                    state.update(b",%d" % conv)
            yield out(reps, hashes)
        if state:
            yield out([now], [state.hexdigest()])

    return members.select("rep", "conv_id").repartition("rep").sortWithinPartitions("rep", "conv_id").mapInArrow(run, "rep long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of conversations (conv_id, pos from 0, key, n_bytes); convs has every conv_id, also those without turns."""
    spark = turns.sparkSession
    sums = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.bit_xor(F.xxhash64("pos", "key")).alias("a"), F.bit_xor(F.xxhash64("key", "pos", F.lit("b"))).alias("b"))
    sums = materialize(convs.join(sums, "conv_id", "left").na.fill(0, ["n_turns", "a", "b"]), "sums")
    same = sums.groupBy("n_turns", "a", "b").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes, seen = materialize_and_see(same, "classes", root=F.min("rep"), n=F.sum("n"), live=F.sum((F.col("n_turns") > 0).cast("long")))
    if seen["root"] is None:
        return spark.createDataFrame([], SCHEMA)
    root, live = seen["root"], seen["live"]
    paths = turns.withColumnRenamed("conv_id", "rep").join(classes.select("rep", "n", "n_turns"), "rep")
    paths = materialize(paths.repartitionByRange("pos", "rep").sortWithinPartitions("pos"), "paths")  # so that a level reads its own part

    # down: (rep, n, n_turns, n_bytes, parent, child, n_convs, n_classes, depth) a level
    levels: list[DataFrame] = []
    here = classes.select("rep", F.lit(root).alias("parent"))
    while live:
        step = paths.where(F.col("pos") == len(levels)).join(here, "rep")
        nodes = step.groupBy("parent", "key").agg(F.min("rep").alias("child"), F.sum("n").alias("n_convs"), F.count(F.lit(1)).alias("n_classes"))
        at = step.join(nodes, ["parent", "key"]).withColumn("depth", F.lit(len(levels) + 1).cast("long")).drop("key", "pos")
        shared = F.col("n_classes") > 1
        at, seen_here = materialize_and_see(at, "level", live=F.sum((shared & (F.col("n_turns") > F.col("depth"))).cast("long")))
        levels.append(at)
        here, live = at.where(shared).select("rep", F.col("child").alias("parent")), seen_here["live"]

    # the rest of the paths of classes alone in their node
    every = classes.select("rep", "n_turns").where("n_turns = 0").select(F.lit(root).alias("conv_id"), F.lit(0).cast("long").alias("depth"), "rep")
    alone = None
    for at in levels:
        mine = at.where("n_classes = 1").select("rep", "parent", F.col("depth").alias("top"))
        alone = mine if alone is None else alone.unionByName(mine)
        every = every.unionByName(at.where("n_classes > 1 AND n_turns = depth").select(F.col("child").alias("conv_id"), "depth", "rep"))
    tops = None
    nodes = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    out = None
    if alone is not None:
        depth = F.col("pos") + 1
        chain = paths.join(alone, "rep").where(depth >= F.col("top")).withColumn("depth", depth).withColumn("own", (F.col("n") - 1) * F.col("n_bytes"))
        chain = materialize(chain.withColumn("chunk", -F.expr(f"pos div {CHUNK}")), "chains")
        below = running_total_in(chain.where("n > 1"), "own", ["rep"], "chunk", [F.desc("pos")], "below")
        every = every.unionByName(chain.where("depth = n_turns").select(F.col("rep").alias("conv_id"), "depth", "rep"))
        whole = chain.where("n = 1").withColumn("below", F.lit(0).cast("long")).unionByName(below)
        out = whole.select(F.col("rep").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("rep")).alias("parent_conv_id"), F.col("n").alias("n_convs"), (F.col("depth") < F.col("n_turns")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), (F.col("own") + F.col("below")).alias("saved_tokens"), F.col("top"))
        out = materialize(out, "chain_nodes")
        tops = out.where("depth = top").select(*nodes)
        out = out.select(*nodes)

    # up: leaves and savings of a level's shared nodes from those of their children
    top = spark.range(1).select(F.lit(root).alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(seen["n"]).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("own"))
    done = None
    for d in range(len(levels), -1, -1):
        if d:
            mine = levels[d - 1].where("n_classes > 1 AND rep = child").select(F.col("child").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("own"))
        else:
            mine = top
        kids = tops.where(F.col("depth") == d + 1) if tops is not None else None
        kids = done if kids is None else kids if done is None else kids.unionByName(done)
        if kids is None:
            rolled = mine.withColumns({"n_children": F.lit(0).cast("long"), "n_leaves": F.lit(1).cast("long"), "saved_tokens": F.col("own")})
        else:
            added = kids.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            rolled = mine.join(added, "conv_id", "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "n_leaves": F.coalesce("leaves", F.lit(1)), "saved_tokens": F.col("own") + F.coalesce("saved", F.lit(0))})
        done = materialize(rolled.select(*nodes), "rolled")
        out = done if out is None else out.unionByName(done)

    many = sums.join(classes.where("n > 1").select("n_turns", "a", "b", "rep"), ["n_turns", "a", "b"])
    hashes = hashed_ids(many).unionByName(classes.where("n = 1").select("rep", F.sha2(F.col("rep").cast("string").cast("binary"), 256).alias("ends_sha256")))
    ends = every.join(hashes, "rep").select("conv_id", "depth", "ends_sha256")
    none = hashlib.sha256(b"").hexdigest()
    return out.join(ends, ["conv_id", "depth"], "left").select(*nodes, F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(placed_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


OP13_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v // 2, 3988292384 * (v % 2)))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, t.pos, role, text FROM c JOIN t ON t.conv_id = c.base AND t.pos < h
  UNION ALL SELECT c.conv_id, t.pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= h),
p AS (
  SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes, string_agg(md5(strlen(role) || ':' || role || text), '') OVER w AS path
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
e AS (SELECT path, sha256(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id)) AS ends FROM p JOIN l ON p.conv_id = l.conv_id AND p.depth = l.depth GROUP BY path),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS own FROM p GROUP BY path, depth),
k AS (SELECT substr(path, 1, 32 * (depth - 1)) AS up, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
s AS (
  SELECT a.path, count(*) FILTER (k.up IS NULL) AS n_leaves, sum(b.own) AS saved
  FROM n a JOIN n b ON starts_with(b.path, a.path) LEFT JOIN k ON k.up = b.path GROUP BY a.path)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, CASE WHEN n.depth > 0 THEN u.conv_id END AS parent_conv_id, n.n_convs,
       coalesce(k.n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM n JOIN s ON s.path = n.path LEFT JOIN k ON k.up = n.path LEFT JOIN e ON e.path = n.path
LEFT JOIN n u ON n.depth > 0 AND u.path = substr(n.path, 1, 32 * (n.depth - 1))
"""
