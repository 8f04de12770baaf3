"""Merkle manifest of a table: leaf hashes, levels of runs, proofs and their check by a recursive query.

A row's leaf is the hash of its fields, each as its length in bytes, a colon
and its value (``-`` for null). The leaves of a group (a source) stand in
ascending order of their id; runs of ``fan`` nodes are hashed to a node of the
next level until one is left, the group's subroot; subroots, in order of the
group (null first), are hashed to the root in the same way.

``build`` stores the built levels as rows that name their parent. ``climb`` is
a recursive query over these rows: from every leaf it ascends to the root,
appends the siblings met on the way and folds the leaf's current hash into the
hash of each run. The leaves of a run share a row of the query and all siblings
above their own run; each has its own fold. Nodes with many runs below are
joined in copies, so that no join key holds more than a share of the rows.

Ids that are equal in a group are ordered by their leaf hashes, null ids come
first; repeated rows are leaves of their own. A group of one row has that leaf
as its subroot, a table of one group that subroot as its root; an empty table
gives an empty result. Columns besides the named ones are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveylab.llm.common import stored
from surveylab.llm.order import ranked

FAN = 16
#: Most copies in which a node with many runs below is joined.
COPIES = 256
#: The tree above the subroots. Trees of groups are "" (null) and "s" with the group's name.
TOP = "top"


def field(c: Column) -> Column:
    """``length:value`` of a column as text, ``-`` for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """SHA-256 of joined texts, as bytes; digests go into the next hash as lower-case hex."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def as_hex(c: Column | str) -> Column:
    return F.lower(F.hex(c))


def _node(tree: Column, level: Column | int, pos: Column) -> Column:
    return F.concat_ws("/", F.lit(level).cast("string") if isinstance(level, int) else level.cast("string"),
                       pos.cast("string"), tree)


@dataclass
class Manifest:
    """``runs``: (run, node, leaves) with the leaves of a run in order, each (id, leaf, now); ``nodes``: (node, parent,
    before, after, hash, is_subroot), the siblings as joined bytes; ``root``: the root's bytes (None without rows)."""

    runs: DataFrame
    nodes: DataFrame
    root: bytes | None


def _linked(level: DataFrame, fan: int, copies: int) -> tuple[DataFrame, DataFrame]:
    """Rows (tree, pos, n, hash, ...) of one level of trees with more than one node: (the nodes with their siblings,
    the nodes of the next level, which will be joined in ``copies``)."""
    runs = level.groupBy("tree", F.expr(f"pos div {fan}").alias("up"), "n", "level").agg(
        F.sort_array(F.collect_list(F.struct("pos", "hash", "node", "is_subroot", "copies"))).alias("kids"))
    hashes = F.expr("transform(kids, k -> k.hash)")
    made = runs.select("tree", "up", "n", "level", "kids", digest(F.array_join(
        F.transform(hashes, lambda h: F.lower(F.hex(h))), "")).alias("hash"))
    above = made.select("tree", F.col("up").alias("pos"), F.expr(f"bigint(ceil(n / {fan}))").alias("n"), "hash",
                        (F.col("level") + 1).alias("level"), F.lit(False).alias("is_subroot"),
                        F.lit(copies).alias("copies")).withColumn("node", _node(F.col("tree"), F.col("level"), F.col("pos")))
    parent = _node(F.col("tree"), F.col("level") + 1, F.col("up"))
    # The joined hashes of a run have 32 bytes each, so that siblings are cut out of one value.
    joined = F.unhex(F.array_join(F.transform(hashes, lambda h: F.hex(h)), ""))
    nodes = made.select(parent.alias("parent"), joined.alias("all"), F.posexplode("kids").alias("i", "k")).select(
        "k.node", "k.copies", "parent", F.lit(copies).alias("parent_copies"),
        F.expr("substring(all, 1, 32 * i)").alias("before"), F.expr("substring(all, 32 * i + 33)").alias("after"),
        "k.hash", "k.is_subroot")
    return nodes, above


def _climbed(level: DataFrame, fan: int, copies: int, most: int) -> tuple[list[DataFrame], DataFrame]:
    """All levels of trees: (their linked nodes, the one node that is left of each tree). The nodes made first are
    joined in ``copies``, those above in ``fan`` times as many each, up to ``most``."""
    nodes, left = [], []
    while True:
        left.append(level.where("n = 1"))
        more = level.where("n > 1")
        if more.isEmpty():
            return nodes, _union(left)
        linked, above = _linked(more, fan, copies)
        nodes.append(linked)
        level, copies = stored(above, "level"), min(most, copies * fan)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def build(leaves: DataFrame, fan: int = FAN, copies: int = COPIES) -> Manifest:
    """The manifest of leaves (id, group, leaf, now): the leaf's bytes, and those of its row as it is now (null if
    unchanged). Nodes are noted with the number of copies, up to ``copies``, in which :func:`climb` joins them."""
    placed = ranked(stored(leaves.select(
        "id", F.coalesce(F.concat(F.lit("s"), F.col("group")), F.lit("")).alias("tree"), "leaf", "now"), "leaves"),
        "tree", [F.col("id").asc_nulls_first(), F.col("leaf")])
    runs = stored(placed.groupBy("tree", F.expr(f"pos div {fan}").alias("up"), "n").agg(
        F.sort_array(F.collect_list(F.struct("pos", "leaf", "id", "now"))).alias("leaves")), "runs")
    first = runs.withColumns({
        # A lone leaf is its tree's only node.
        "hash": F.when(F.col("n") == 1, F.col("leaves")[0]["leaf"]).otherwise(
            digest(F.array_join(F.expr("transform(leaves, x -> lower(hex(x.leaf)))"), ""))),
        "level": F.when(F.col("n") == 1, 0).otherwise(1),
    }).select("tree", F.col("up").alias("pos"), F.expr(f"bigint(ceil(n / {fan}))").alias("n"), "hash", "level",
              F.lit(False).alias("is_subroot"), F.lit(1).alias("copies"),
              _node(F.col("tree"), F.col("level"), F.col("up")).alias("node"))
    nodes, subroots = _climbed(stored(first, "level"), fan, min(copies, fan), copies)
    above = ranked(stored(subroots.select("tree", "node", "hash", "copies"), "subroots").withColumn("all", F.lit(TOP)),
                   "all", [F.col("tree")])
    top = above.select(F.col("all").alias("tree"), "pos", "n", "hash", F.lit(0).alias("level"),
                       F.lit(True).alias("is_subroot"), "copies", "node")
    more, roots = _climbed(stored(top, "level"), fan, copies, copies)
    end = roots.select("node", "copies", F.lit(None).cast("string").alias("parent"), F.lit(1).alias("parent_copies"),
                       F.lit(b"").alias("before"), F.lit(b"").alias("after"), "hash", "is_subroot")
    linked = stored(_union([*nodes, *more, end]), "nodes")
    root = roots.select("hash").first()
    named = runs.select(F.monotonically_increasing_id().alias("run"),
                        _node(F.col("tree"), F.when(F.col("n") == 1, 0).otherwise(1), F.col("up")).alias("node"),
                        (F.col("n") == 1).alias("lone"), "leaves")
    return Manifest(stored(named, "runs"), linked, root and bytes(root[0]))


_CLIMB = """
    WITH RECURSIVE climb(run, at, copy, folded, siblings, subroot) AS (
        SELECT run, node, 0, folded, siblings, subroot FROM {start}
        UNION ALL
        SELECT c.run, n.parent, int(pmod(xxhash64(c.run), n.parent_copies)),
            if(n.parent IS NULL, c.folded, transform(c.folded, f -> unhex(sha2(concat(
                lower(hex(n.before)), lower(hex(f)), lower(hex(n.after))), 256)))),
            concat(c.siblings, n.before, n.after),
            if(n.is_subroot, n.hash, c.subroot)
        FROM climb c JOIN {nodes} n ON c.at = n.node AND c.copy = n.copy
    )
    SELECT run, folded, siblings, subroot FROM climb WHERE at IS NULL
"""


def climb(manifest: Manifest) -> DataFrame:
    """(run, folded, siblings, subroot) of every run of leaves: each leaf's current hash folded up to the root, the
    joined siblings above the run in order of the ascent, and the subroot passed."""
    spark = manifest.runs.sparkSession
    # Every leaf's fold over its own run; from there on the siblings are the same for the leaves of a run.
    folds = F.expr("""transform(leaves, (x, i) -> if(lone, coalesce(x.now, x.leaf), unhex(sha2(array_join(
        transform(leaves, (y, j) -> lower(hex(if(i = j, coalesce(y.now, y.leaf), y.leaf)))), ''), 256))))""")
    empty = F.lit(b"")
    start = manifest.runs.select("run", "node", folds.alias("folded"), empty.alias("siblings"), empty.alias("subroot"))
    nodes = manifest.nodes.select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")  # the query makes a row for each run and level
    try:
        return stored(spark.sql(_CLIMB, start=start, nodes=nodes), "climb")
    finally:
        if before is None:
            spark.conf.unset(limit)
        else:
            spark.conf.set(limit, before)


def proofs(manifest: Manifest) -> DataFrame:
    """(id, leaf, siblings, subroot, folded) of every leaf, as bytes: the joined siblings level by level, left to right
    (those of the own run first), and the root that the leaf's current row gives with them."""
    up = climb(manifest)
    own = F.expr("""transform(leaves, (x, i) -> struct(x.id as id, x.leaf as leaf, concat(
        unhex(array_join(transform(filter(leaves, (y, j) -> j != i), y -> hex(y.leaf)), '')), siblings) as siblings,
        subroot, folded[i] as folded))""")
    return manifest.runs.join(up, "run").select(F.inline(own))


def verify(df: DataFrame, fields: list[str], group: str, doc_id: str, now: dict[str, Column] | None = None,
           changed: Column | None = None, fan: int = FAN) -> DataFrame:
    """One row per row of ``df``: (id, leaf, subroot, root, siblings, folded, verified) with digests as bytes.

    ``now`` gives the current content of some fields and ``changed`` the rows
    in which it stands instead of the recorded one; ``verified`` tells if the
    leaf of the row as it is now, folded with the recorded siblings, gives the
    recorded root.
    """
    leaf = digest(*[field(F.col(f"`{c}`")) for c in fields])
    other = digest(*[field((now or {}).get(c, F.col(f"`{c}`"))) for c in fields])
    leaves = df.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{group}`").cast("string").alias("group"),
                       leaf.alias("leaf"), (F.when(changed, other) if changed is not None else F.lit(None).cast("binary"))
                       .alias("now"))
    manifest = build(leaves, fan)
    root = F.lit(manifest.root).cast("binary")
    return proofs(manifest).select("id", "leaf", "subroot", root.alias("root"), "siblings", "folded",
                                        (F.col("folded") == root).alias("verified"))
