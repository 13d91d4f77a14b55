"""Prefix trie of conversations, found through a z-fast trie whose nodes are rows."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.llm.common import attach, stage
from alertloom.session import ship_package

#: Running hashes and sums are taken within blocks of so many turns, and over the blocks' totals.
BLOCK_TURNS = 4096
#: Members of a node are joined to text in ranges of so many ids, then hashed range by range.
ID_RANGE = 4096


def fattest(low: Column, high: Column) -> Column:
    """The 2-fattest number in (low, high]: the one that the highest power of two divides."""
    return F.expr(f"shiftleft(shiftright({high}, length(bin({low} ^ {high})) - 1), length(bin({low} ^ {high})) - 1)")


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1 by turn, null first, then role and text), t1, t2 (hashes of role and text), bytes.

    One range-partitioned sort over all turns; a conversation may lie in any number of parts, the place in it is the
    distance from its first row, counted over the parts."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    rows = rows.orderBy("conv_id", "turn", "role", "text").withColumn("at", F.monotonically_increasing_id())
    hashed = lambda k: F.xxhash64(F.lit(k), "role", "text").alias(f"t{k}")
    rows = stage(rows.select("conv_id", F.shiftright("at", 33).alias("part"), "at", hashed(1), hashed(2), F.octet_length("text").cast("long").alias("bytes")), "turns")
    parts = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    pos = (F.col("at") - F.col("first") + F.col("before") + 1).alias("pos")
    return rows.join(parts, ["conv_id", "part"]).select("conv_id", pos, "t1", "t2", "bytes")


def rebuilt(turns: DataFrame, family: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, t1, t2, bytes) of the rebuilt conversations, and (conv_id, len) of all of them, turnless ones too: the
    first h turns of the family's first conversation, then the own turns after the first h; h is crc32(conv_id) % longest."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest
    plan = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = plan.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
    plan = stage(plan.select("conv_id", "n", "h", "base", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "plan")
    heads = turns.where(F.col("pos") < longest).withColumnRenamed("conv_id", "base")
    taken = plan.where("k > 0").select("conv_id", "base", F.explode(F.expr("sequence(1L, k)")).alias("pos")).join(heads, ["base", "pos"])
    own = attach(turns, plan.select("conv_id", "n", "h", "k"), ["conv_id"], "n").where("pos > h")
    columns = ["t1", "t2", "bytes"]
    return taken.select("conv_id", F.col("pos").alias("depth"), *columns).unionByName(own.select("conv_id", F.expr("k + pos - h").alias("depth"), *columns)), plan.select("conv_id", "len")


def running(rows: DataFrame) -> DataFrame:
    """conv_id, depth, p1, p2, bytes, upto: a 128-bit hash of the first `depth` turns and their bytes. The hash is the exclusive or of
    hashes of each turn with its depth, so it can be taken block by block in any order."""
    block = F.expr(f"(depth - 1) div {BLOCK_TURNS}")
    mixed = rows.select("conv_id", "depth", block.alias("block"), F.xxhash64("t1", "depth").alias("m1"), F.xxhash64("t2", "depth").alias("m2"), "bytes")
    sums = lambda cols, w: [F.bit_xor(cols[0]).over(w), F.bit_xor(cols[1]).over(w), F.sum(cols[2]).over(w)]
    totals = mixed.groupBy("conv_id", "block").agg(F.bit_xor("m1").alias("b1"), F.bit_xor("m2").alias("b2"), F.sum("bytes").alias("b3"))
    ahead = sums(("b1", "b2", "b3"), Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("conv_id", "block", *[F.coalesce(c, F.lit(0)).alias(f"a{i}") for i, c in enumerate(ahead, 1)])
    here = sums(("m1", "m2", "bytes"), Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0))
    local = mixed.select("conv_id", "block", "depth", "bytes", *[c.alias(f"s{i}") for i, c in enumerate(here, 1)])
    return local.join(totals, ["conv_id", "block"]).select(
        "conv_id", "depth", F.col("s1").bitwiseXOR(F.col("a1")).alias("p1"), F.col("s2").bitwiseXOR(F.col("a2")).alias("p2"), "bytes", (F.col("s3") + F.col("a3")).alias("upto")
    )


def prefix_at(rows: DataFrame, paths: DataFrame, depth: str, one: str, two: str, key: str = "sid") -> DataFrame:
    """rows with the hash of the prefix of `depth` turns of the string in `key`, null where there is none."""
    wanted = paths.select(F.col("sid").alias(key), F.col("depth").alias("__d"), F.col("p1").alias(one), F.col("p2").alias(two))
    return rows.withColumn("__d", F.col(depth)).join(wanted, [key, "__d"], "left").drop("__d")


def with_hashes(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes with the prefix hashes at their handle (the 2-fattest depth in (lo, hi]), their first turn and their end."""
    nodes = nodes.withColumn("fat", fattest("lo", "hi"))
    nodes = prefix_at(nodes, paths, "fat", "f1", "f2", "rep")
    nodes = prefix_at(nodes.withColumn("first", F.col("lo") + 1), paths, "first", "x1", "x2", "rep")
    return prefix_at(nodes, paths, "hi", "e1", "e2", "rep")


def locate(strings: DataFrame, nodes: DataFrame, paths: DataFrame, steps: int) -> DataFrame:
    """Where each string leaves the trie: sid, len, rep, hi (the node whose edge it leaves or ends on; null at the root), at (the depth).

    Fat binary search: of the depths (a, b] that are still possible the 2-fattest one is looked up among the handles, with the hash of
    the string's prefix of that depth. A hit moves a to that node's end, a miss b below the depth. The deepest node hit
    is the last one whose handle is a prefix of the string; the string leaves on its edge, or on that of its child with the string's next turn,
    or below it as a new child."""
    handles = nodes.select(F.col("fat").alias("f"), F.col("f1").alias("q1"), F.col("f2").alias("q2"), F.struct("rep", "lo", "hi", "e1", "e2").alias("hit"))
    own = paths.join(strings.select("sid"), "sid", "left_semi")
    kind = handles.schema["hit"].dataType
    now = strings.withColumns({"a": F.lit(0).cast("long"), "b": F.col("len"), "v": F.lit(None).cast(kind)})
    for _ in range(steps):
        now = now.withColumn("f", F.when(F.col("a") < F.col("b"), fattest("a", "b")))
        now = prefix_at(now, own, "f", "q1", "q2").withColumns({"done": F.col("f").isNull(), "f": F.coalesce("f", F.lit(-1)), "q1": F.coalesce("q1", "sid")})
        now = now.join(handles, ["f", "q1", "q2"], "left")
        found = F.col("hit").isNotNull()
        now = now.select(
            "sid", "len", F.when(found, F.least("hit.hi", "b")).otherwise(F.col("a")).alias("a"),
            F.when(found | F.col("done"), F.col("b")).otherwise(F.col("f") - 1).alias("b"), F.coalesce("hit", "v").alias("v"),
        )
    now = now.withColumns({"end": F.coalesce("v.hi", F.lit(0)), "next": F.coalesce("v.hi", F.lit(0)) + 1})
    now = prefix_at(prefix_at(now, own, "end", "y1", "y2"), own, "next", "x1", "x2")
    whole = F.col("v").isNull() | ((F.col("y1") == F.col("v.e1")) & (F.col("y2") == F.col("v.e2")))
    children = nodes.select((F.col("lo") + 1).alias("next"), "x1", "x2", F.struct("rep", "lo", "hi").alias("child"))
    now = stage(now.withColumn("whole", F.coalesce(whole, F.lit(False))).join(children, ["next", "x1", "x2"], "left"), "exits")
    edge = F.when(F.col("child").isNotNull(), F.col("child")).when(~F.col("whole"), F.struct("v.rep", "v.lo", "v.hi"))
    now = now.select("sid", "len", edge.alias("edge"), F.col("v.rep").alias("rep"), "end")
    on_edge = now.where("edge is not null").select("sid", "len", "edge.*")
    depths = on_edge.select("sid", "rep", F.explode(F.expr("sequence(lo + 1, least(hi, len))")).alias("depth"))
    theirs = paths.select(F.col("sid").alias("rep"), "depth", "p1", "p2")
    same = depths.join(own.select("sid", "depth", "p1", "p2"), ["sid", "depth"]).join(theirs, ["rep", "depth", "p1", "p2"])
    same = same.groupBy("sid").agg(F.count("*").alias("common"))
    leaving = on_edge.join(same, "sid").select("sid", "len", "rep", "hi", (F.col("lo") + F.col("common")).alias("at"))
    below = now.where("edge is null").select("sid", "len", "rep", F.when(F.col("rep").isNotNull(), F.col("end")).alias("hi"), F.col("end").alias("at"))
    return leaving.unionByName(below)


def insert(found: DataFrame, nodes: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (rep, lo, hi, end) after a batch, and the strings (sid, len) that have to wait for the next one.

    Edges are cut at all depths where strings leave them. Of the strings that go on with the same turn from the same place one,
    chosen by a hash, becomes a leaf; the others wait. A string's fellows in waiting are those that share more with it than the leaf
    does, about half of them in expectation, so the number of batches grows with the logarithm of the number of strings."""
    found = prefix_at(found.withColumn("next", F.col("at") + 1), paths, "next", "n1", "n2")
    going = found.where("at < len")
    order = F.struct(F.xxhash64("sid"), "sid", "len", "at")
    leaves = going.groupBy("next", "n1", "n2").agg(F.min(order).alias("w")).select(F.col("w.sid").alias("rep"), F.col("w.at").alias("lo"), F.col("w.len").alias("hi"), F.col("w.sid").alias("end"))
    leaves = stage(leaves, "leaves")
    ending = F.when(F.col("at") == F.col("len"), F.col("sid"))
    cuts = found.where("hi is not null").select("rep", "hi", "at", ending.alias("end"), F.lit(None).cast("long").alias("lo"))
    cuts = cuts.unionByName(nodes.select("rep", "hi", F.col("hi").alias("at"), "end", "lo"))
    cuts = cuts.groupBy("rep", "hi", "at").agg(F.max("end").alias("end"), F.max("lo").alias("lo"))
    edge = Window.partitionBy("rep", "hi")
    pieces = cuts.select("rep", F.coalesce(F.lag("at").over(edge.orderBy("at")), F.max("lo").over(edge)).alias("lo"), F.col("at").alias("hi"), "end")
    waiting = going.join(leaves.select(F.col("rep").alias("sid")), "sid", "left_anti").select("sid", "len")
    return pieces.unionByName(leaves), waiting


def zfast_trie(strings: DataFrame, paths: DataFrame) -> DataFrame:
    """The compacted trie of the strings (sid, len > 0): rep (a string through the node), lo, hi (the node's edge stands for the depths
    lo + 1 to hi), end (the string that ends at hi, or null) and prefix hashes. Batches of strings are located and inserted until none is left."""
    nodes = None
    while row := strings.agg(F.max("len")).first()[0]:
        if nodes is None:
            root = F.lit(None).cast("long")
            found = strings.select("sid", "len", root.alias("rep"), root.alias("hi"), F.lit(0).cast("long").alias("at"))
            nodes = strings.limit(0).select(F.col("sid").alias("rep"), F.col("len").alias("lo"), F.col("len").alias("hi"), F.col("sid").alias("end"))
        else:
            found = stage(locate(strings, nodes, paths, int(row).bit_length()), "found")
        plain, waiting = insert(found, nodes, paths)
        strings = stage(waiting, "waiting")
        nodes = stage(with_hashes(plain, paths), "nodes")
    return nodes


def summed(nodes: DataFrame, sums: list[str], lows: list[str]) -> DataFrame:
    """id and, for each node, the sums and minima over its subtree, by pointer doubling: after k rounds a node knows all within 2**k below it,
    and the node 2**k above it. nodes: id, up (null for the root) and the columns."""
    now = stage(nodes, "tree")
    while not now.where("up is not null").isEmpty():
        more = now.where("up is not null").groupBy(F.col("up").alias("id")).agg(*[F.sum(c).alias(f"m_{c}") for c in sums], *[F.min(c).alias(f"m_{c}") for c in lows], F.count("*").alias("below"))
        more = stage(more.join(now.select("id", F.col("up").alias("above")), "id"), "below")
        jumps = attach(now.where("up is not null"), more.select(F.col("id").alias("up"), "above", "below"), ["up"], "below").select(*now.columns, "above")
        jumps = jumps.unionByName(now.where("up is null").withColumn("above", F.col("up")))
        added = jumps.join(more.drop("above", "below"), "id", "left")
        now = added.select("id", F.col("above").alias("up"), *[(F.col(c) + F.coalesce(f"m_{c}", F.lit(0))).alias(c) for c in sums], *[F.least(c, f"m_{c}").alias(c) for c in lows])
        now = stage(now, "tree")
    return now.drop("up")


def at_end(nodes: DataFrame, table: DataFrame) -> DataFrame:
    """Nodes with what the table says of the string that ends there; nodes where none ends, which may be many, take no part in the join."""
    return nodes.where("end is not null").join(table, "end").unionByName(nodes.where("end is null"), allowMissingColumns=True)


def ids_hash(members: DataFrame) -> DataFrame:
    """end and sha256 of its members' ids, ascending, in decimal, joined by commas. Ids are joined in ranges, and one task
    reads the ranges of an end in order and keeps the state of the hash only."""
    ship_package(members.sparkSession)
    piece = F.floor(F.col("conv_id") / ID_RANGE).alias("piece")
    pieces = members.groupBy("end", piece).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches):
        now, state = None, None
        for batch in batches:
            ends, digests = [], []
            for end, ids in zip(batch.column("end").to_pylist(), batch.column("ids").to_pylist()):
                if end == now:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    ends.append(now)
                    digests.append(state.hexdigest())
                now, state = end, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(ends, pa.int64()), pa.array(digests, pa.string())], ["end", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()], pa.string())], ["end", "ends_sha256"])

    return pieces.repartition("end").sortWithinPartitions("end", "piece").select("end", "ids").mapInArrow(run, "end bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame, family: int = 5, longest: int = 9) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations: conv_id, turn, role, text. Turns are ordered by turn (null first; ties by role, then text, so repeated rows are
    turns of their own); null role and text are empty. Rows without conv_id belong to no conversation. A conversation is rebuilt from
    the first h turns of the first one of its `family`, conv_id - conv_id % family, and its own turns after the first h,
    h = crc32(conv_id) % longest.

    Equal conversations are one string. The strings make a z-fast trie: compacted nodes are kept under the hash of their prefix at their 2-fattest
    depth, strings find the node they leave at by fat binary search, and are inserted in batches. Counts and sums are
    taken over the compacted tree; then each edge is expanded into the nodes it stands for. Prefixes are told apart by 128-bit
    hashes. Work is spread by string and depth, so neither a conversation of many turns nor many equal ones meet in one task; only
    the SHA-256 of one node's members, which cannot be split, runs through one task, range by range. Turnless conversations are members of the root.
    An empty table has no nodes; other columns are not read."""
    turns = stage(turns_in_order(conversations), "positions")
    rows, sizes = rebuilt(turns, family, longest)
    prefixes = stage(running(rows), "prefixes")
    ends = prefixes.select("conv_id", F.col("depth").alias("len"), "p1", "p2", "upto")
    whole = sizes.join(ends, ["conv_id", "len"], "left").fillna(0, ["p1", "p2", "upto"])
    key = ["len", "p1", "p2"]
    classes = stage(whole.groupBy(*key).agg(F.min("conv_id").alias("end"), F.count("*").alias("n"), F.first("upto").alias("upto")), "classes")
    members = attach(whole, classes.select(*key, "end", "n"), key, "n").select("end", "conv_id")
    strings = classes.where("len > 0").select(F.col("end").alias("sid"), "len")
    paths = stage(prefixes.withColumnRenamed("conv_id", "sid").join(strings, "sid", "left_semi"), "paths")
    nodes = zfast_trie(strings, paths)

    root = F.struct(F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("e1"), F.lit(0).cast("long").alias("e2"))
    top = classes.agg(F.count("*").alias("c"), F.max(F.when(F.col("len") == 0, F.col("end"))).alias("end")).where("c > 0")
    none = F.lit(None).cast("long")
    top = top.select(root.alias("id"), none.alias("rep"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), "end", F.lit(None).cast("struct<hi:bigint,e1:bigint,e2:bigint>").alias("up"))
    if nodes is not None:
        upto = lambda d, name: paths.select(F.col("sid").alias("rep"), F.col("depth").alias(d), F.col("p1").alias(f"{d}_1"), F.col("p2").alias(f"{d}_2"), F.col("upto").alias(name))
        placed = nodes.join(upto("hi", "high"), ["rep", "hi"]).join(upto("lo", "low"), ["rep", "lo"], "left")
        up = F.struct(F.col("lo").alias("hi"), F.coalesce("lo_1", F.lit(0)).alias("e1"), F.coalesce("lo_2", F.lit(0)).alias("e2"))
        low = F.coalesce("low", F.lit(0))
        placed = placed.select(F.struct("hi", "e1", "e2").alias("id"), "rep", "lo", "hi", "end", up.alias("up"), low.alias("low"), (F.col("high") - low).alias("edge"))
        placed = placed.unionByName(top.withColumns({"low": F.lit(0).cast("long"), "edge": F.lit(0).cast("long")}))
    else:
        placed = top.withColumns({"low": F.lit(0).cast("long"), "edge": F.lit(0).cast("long")})
    placed = stage(placed, "placed")
    children = placed.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.count("*").alias("n_children"))
    own = at_end(placed, classes.select("end", "n", (F.col("n") * F.col("upto")).alias("all"))).join(children, "id", "left")
    own = own.select("*", F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"))
    own = stage(own.fillna(0, ["n", "all", "n_children"]), "own")
    totals = summed(own.select("id", "up", "n", "all", "edge", "leaves", F.col("end").alias("first")), ["n", "all", "edge", "leaves"], ["first"])
    named = own.select("id", "rep", "lo", "hi", "end", "up", "low", "n_children").join(totals, "id")
    firsts = totals.select(F.col("id").alias("up"), F.col("first").alias("above")).join(children.select(F.col("id").alias("up"), "n_children"), "up")
    named = attach(named, firsts.withColumnRenamed("n_children", "w"), ["up"], "w").drop("w")
    named = stage(at_end(named, ids_hash(members)), "named")
    steps = named.where("up is not null").withColumn("depth", F.explode(F.expr("sequence(lo + 1, hi)")))
    steps = steps.join(paths.select(F.col("sid").alias("rep"), "depth", (F.col("upto") - F.col("bytes")).alias("ahead")), ["rep", "depth"])
    steps = steps.unionByName(named.where("up is null").withColumns({"depth": F.lit(0).cast("long"), "ahead": F.lit(0).cast("long")}))
    bottom = F.col("depth") == F.col("hi")
    return steps.select(
        F.col("first").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("lo") + 1, F.col("above")).when(F.col("depth") > 0, F.col("first")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(bottom, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("all") - F.col("n") * F.col("ahead") - F.col("edge") + F.col("ahead") - F.col("low")).alias("saved_tokens"),
        F.coalesce(F.when(bottom, F.col("ends_sha256")), F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
