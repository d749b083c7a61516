"""Conversation prefix trie, with subtree totals by parallel tree contraction.

A conversation's prefix of d turns is named by a SHA-256 of SHA-256s of its turns, so that equal
names are equal prefixes. Names come level by level: blocks of 32 turns are hashed each by itself,
then the blocks' own sequence in the same way, so a conversation of any length spreads over tasks.
Nodes are one aggregation by name; then each is known by its smallest member and its depth.

Totals of all subtrees are found by contraction. Compress takes out every node with one child:
pointers along these chains are doubled until each reaches the chain's end, which inherits the
chain's weight on its edge. Rake adds all leaves to their parents, summed before they meet them.
After both, every inner node had two children or more, so each round at least halves the tree, and
the rounds grow with its logarithm, not its depth. Raked nodes know their total. Those taken out by
compress get theirs back, the last round first, in a join with the node that their chain ended in.

Turns are ordered by turn (null first), then by the digest of role and text, so ties have a defined
order and repeated rows are turns of their own. Null roles and texts count as empty, texts of any
length are hashed where they are read. Rows without a conv_id belong to no conversation and are
left out. Other columns are dropped, whatever their names. An empty table gives no node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved
from .ordered import digests, places

#: Turns whose prefixes are named together.
BLOCK = 32
#: Conversations that share a beginning, and how many turns of it they may share.
FAMILY, SHARED = 5, 9


def head_length(conv_id: Column) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(SHARED))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with the shared beginning of their family: rows (conv_id, d, digest, n_bytes, last) and one row per conversation (conv_id, n_turns)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    own = turns.where("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    placed = saved(places(own, "conv_id", F.col("turn").asc_nulls_first(), "digest").select("conv_id", "place", "digest", "n_bytes"))
    heads = placed.where(F.col("place") < SHARED - 1)
    lengths = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    family = lengths.select("conv_id", "n", head_length(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    base = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    k = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = saved(family.join(base, "base", "left").select("conv_id", "base", "h", k.alias("k"), (k + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")))
    first = convs.select("conv_id", "base", "k", "n_turns").join(heads.select(F.col("conv_id").alias("base"), "place", "digest", "n_bytes"), "base").where("place < k")
    first = first.select("conv_id", F.col("place").alias("d"), "digest", "n_bytes", "n_turns")
    rest = placed.join(convs.select("conv_id", "h", "k", "n_turns"), "conv_id").where("place >= h")
    rest = rest.select("conv_id", (F.col("place") - F.col("h") + F.col("k")).alias("d"), "digest", "n_bytes", "n_turns")
    rows = first.unionByName(rest).withColumn("last", F.col("d") + 1 == F.col("n_turns")).drop("n_turns")
    return saved(rows), convs.select("conv_id", "n_turns")


def prefixes(rows: DataFrame) -> DataFrame:
    """rows (conv_id, d, digest and others) with `id`, a name of the turns up to d, and `parent`, that of the turns before."""
    rest = [c for c in rows.columns if c not in ("conv_id", "d")]
    blocks = rows.groupBy("conv_id", F.expr(f"d div {BLOCK}").alias("b")).agg(F.array_sort(F.collect_list(F.struct("d", *rest))).alias("turns"))
    digest = F.transform("turns", lambda t: t["digest"])
    local = F.transform("turns", lambda t, i: F.struct(t.alias("t"), F.sha2(F.array_join(F.slice(digest, F.lit(1), i + 1), ""), 256).alias("name")))
    blocks = blocks.select("conv_id", "b", local.alias("turns"))
    if rows.where(F.col("d") >= BLOCK).limit(1).count():
        blocks = saved(blocks)
        whole = blocks.where(F.size("turns") == BLOCK).select("conv_id", F.col("b").alias("d"), F.element_at("turns", -1)["name"].alias("digest"))
        # what stands before a block: the name of all blocks up to it, and that of its last turn
        before = prefixes(whole).select("conv_id", (F.col("d") + 1).alias("b"), F.col("id").alias("before"), F.sha2(F.concat("parent", "digest"), 256).alias("above"))
        blocks = blocks.join(before, ["conv_id", "b"], "left")
    else:
        blocks = blocks.select("*", F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("above"))
    blocks = blocks.select("conv_id", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("above", F.lit("")).alias("above"), "turns")
    named = F.transform("turns", lambda t, i: F.struct(t["t"].alias("t"), F.sha2(F.concat("before", t["name"]), 256).alias("id"), F.when(i == 0, F.col("above")).otherwise(F.sha2(F.concat("before", F.get(F.col("turns"), i - 1)["name"]), 256)).alias("parent")))
    return blocks.select("conv_id", F.explode(named).alias("r")).select("conv_id", "r.t.d", *(F.col(f"r.t.{c}").alias(c) for c in rest), "r.id", "r.parent")


def compressed(active: DataFrame, weights: tuple[str, ...]) -> tuple[DataFrame, DataFrame | None]:
    """The active nodes without those that have one child, and these as (node, end, weights): a node's total is its weights here and the total of `end`."""
    edge = [f"e_{w}" for w in weights]
    only = active.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.max("node").alias("end"), *(F.sum(e).alias(f"child_{e}") for e in edge)).where("n = 1")
    top = active.where("parent is not null").withColumnRenamed("parent", "above")
    unary = top.join(only, F.col("node") == F.col("parent")).select("node", "end", "above", *edge, *((F.col(w) + F.col(f"child_e_{w}")).alias(w) for w in weights))
    unary = saved(unary)
    if not unary.limit(1).count():
        return active, None
    chain = unary.select("node", "end", *weights)
    inner = unary.select(F.col("end").alias("node"))
    while True:
        far = chain.select(F.col("node").alias("at"), F.col("end").alias("far"), *(F.col(w).alias(f"far_{w}") for w in weights))
        step = chain.join(far, chain["end"] == far["at"], "left")
        step = saved(step.select("node", F.coalesce("far", "end").alias("end"), *((F.col(w) + F.coalesce(f"far_{w}", F.lit(0))).alias(w) for w in weights), F.col("at").isNotNull().alias("moved")))
        chain = step.drop("moved")
        if not step.where("moved").limit(1).count():
            break
    starts = unary.join(inner, "node", "left_anti").select("node", "above", *edge).join(chain, "node")
    starts = starts.select(F.col("end").alias("node"), "above", *((F.col(w) + F.col(f"e_{w}")).alias(f"new_{w}") for w in weights))
    left = active.join(chain.select("node"), "node", "left_anti").join(starts, "node", "left")
    left = left.select("node", F.coalesce("above", "parent").alias("parent"), *weights, *(F.coalesce(f"new_{w}", f"e_{w}").alias(f"e_{w}") for w in weights))
    return saved(left), chain


def raked(active: DataFrame, weights: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The active nodes without leaves, and the leaves with their totals (node, weights), which their parents now have."""
    inner = active.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n")).select(F.col("parent").alias("node"))
    marked = saved(active.join(inner.withColumn("inner", F.lit(True)), "node", "left"))
    leaves = marked.where("inner is null")
    gains = leaves.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(*(F.sum(F.col(w) + F.col(f"e_{w}")).alias(f"gain_{w}") for w in weights))
    left = marked.where("inner").join(gains, "node", "left")
    left = left.select("node", "parent", *((F.col(w) + F.coalesce(f"gain_{w}", F.lit(0))).alias(w) for w in weights), *(f"e_{w}" for w in weights))
    return saved(left), leaves.select("node", *weights)


def subtree_totals(tree: DataFrame, *weights: str) -> DataFrame:
    """(node, weights): each weight summed over the node's subtree. `tree` has node, parent (null for roots) and the weights, integers."""
    active = saved(tree.select("node", "parent", *weights, *(F.lit(0).cast("long").alias(f"e_{w}") for w in weights)))
    totals, chains = None, []
    while active.limit(1).count():
        active, chain = compressed(active, weights)
        if chain is not None:
            chains.append(chain)
        active, leaves = raked(active, weights)
        totals = leaves if totals is None else totals.unionByName(leaves)
    if totals is None:
        return tree.select("node", *weights)
    # last in, first out: a chain may end in a node that a later round took out
    for chain in reversed(chains):
        ends = totals.select(F.col("node").alias("end"), *(F.col(w).alias(f"end_{w}") for w in weights))
        regained = chain.join(ends, "end").select("node", *((F.col(w) + F.col(f"end_{w}")).alias(w) for w in weights))
        totals = totals.unionByName(saved(regained))
    return totals


def trie(turns: DataFrame) -> DataFrame:
    """One row per node of the rebuilt conversations; see op13_prefix_trie."""
    rows, convs = rebuilt(turns)
    named = saved(prefixes(rows))
    grouped = named.groupBy("id", (F.col("d") + 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("n_bytes").alias("n_bytes"), F.max("parent").alias("above"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    nodes = saved(grouped.unionByName(root.select(F.lit("").alias("id"), zero.alias("depth"), "n_convs", "conv_id", zero.alias("n_bytes"), F.lit(None).cast("string").alias("above"))))
    fan = nodes.where("above is not null").groupBy(F.col("above").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = saved(nodes.join(fan, "id", "left").withColumn("n_children", F.coalesce("n_children", zero)))
    # the root, one row, goes to all of depth 1; deeper nodes meet their parent by name
    upper = nodes.where("depth > 0 and n_children > 0").select(F.col("id").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    top = nodes.where("depth = 0").select(F.col("id").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    linked = nodes.where("depth = 1").join(F.broadcast(top), "above").unionByName(nodes.where("depth > 1").join(upper, "above"))
    linked = saved(linked.unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))))
    node = F.struct("conv_id", "depth")
    parent = F.when(F.col("depth") > 0, F.struct(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")))
    weights = (F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"))
    totals = subtree_totals(linked.select(node.alias("node"), parent.alias("parent"), *weights), "n_leaves", "saved_tokens")
    ends = named.where("last").select("id", "conv_id").unionByName(convs.where("n_turns = 0").select(F.lit("").alias("id"), "conv_id"))
    ends = digests(ends, "id", "conv_id").select("id", F.col("sha256").alias("ends_sha256"))
    out = linked.join(totals.select("node.*", "n_leaves", "saved_tokens"), ["conv_id", "depth"]).join(ends, "id", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
