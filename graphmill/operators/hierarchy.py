"""Parent-child links to full hierarchies by tree contraction.

Every round removes what ends somewhere (rake) and splices out an independent set of the nodes with one child and one
parent (compress), so that the number of rounds is logarithmic in the number of nodes even for long chains. What
cannot be raked or compressed away is a core of cycles; the record of the splices, run backwards, tells which of the
spliced nodes lie on them. Without its cycles a hierarchy is a forest, which is contracted to its roots; running that
record backwards recovers root, depth and path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored


def _draw(node: Column, turn: int) -> Column:
    return F.xxhash64(node, F.lit(turn))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def clean_links(links: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, parent) of type string; rows with a null end are no links. Repeated rows are kept."""
    return links.select(F.col(child).cast("string").alias("child"), F.col(parent).cast("string").alias("parent")).where(
        "child is not null and parent is not null"
    )


def _colours(edges: DataFrame, up: str, down: str) -> DataFrame:
    """`n, c`: the greatest id from which each node is reached along edges from `up` to `down`.

    A colour also jumps: who reaches the owner of my colour reaches me, so that long paths take few rounds.
    """
    held = stored(edges.select(F.explode(F.array("child", "parent")).alias("n")).distinct().select("n", F.col("n").alias("c")), "colour")
    colour = held
    while True:
        pushed = edges.join(colour, F.col(up) == F.col("n")).select(F.col(down).alias("n"), "c")
        jumped = colour.alias("a").join(colour.alias("b"), F.col("a.c") == F.col("b.n")).select("a.n", "b.c")
        grown = colour.select("n", "c", F.lit(True).alias("old")).unionByName(pushed.unionByName(jumped).withColumn("old", F.lit(False)))
        after = stored(grown.groupBy("n").agg(F.max("c").alias("c"), F.max(F.when(F.col("old"), F.col("c"))).alias("before")), "colour")
        done = after.where("c <> before").isEmpty()
        discard(held)
        held, colour = after, after.select("n", "c")
        if done:
            return colour


def _strong_parts(core: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members `node, label` of strongly connected parts with more than one node, all nodes `node` that are settled)."""
    ahead = _colours(core, "parent", "child")
    inner = (
        core.join(ahead.select(F.col("n").alias("child"), F.col("c").alias("cc")), "child")
        .join(ahead.select(F.col("n").alias("parent"), F.col("c").alias("cp")), "parent").where("cc = cp").select("child", "parent")
    )
    back = _colours(stored(inner, "inner"), "child", "parent")
    both = stored(ahead.join(back.select("n", F.col("c").alias("b")), "n").where("c = b").select(F.col("n").alias("node"), F.col("c").alias("label")), "strong")
    several = both.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("label")
    members = stored(both.join(several, "label", "left_semi").select("node", "label"), "strong")
    return members, stored(members.select("node").unionByName(ahead.where("n = c").select(F.col("n").alias("node"))).distinct(), "settled")


def strong_parts(links: DataFrame) -> DataFrame:
    """`node, label` of the nodes of a graph (`child, parent`) on cycles of two or more nodes; nodes of one part share a label."""
    left, found = stored(links.select("child", "parent").where("child <> parent").distinct(), "links"), []
    while not left.isEmpty():
        members, settled = _strong_parts(left)
        found.append(members)
        for end in ("child", "parent"):
            left = left.join(settled.select(F.col("node").alias(end)), end, "left_anti")
        left = stored(left.select("child", "parent"), "links")
    return _union(found) if found else links.sparkSession.createDataFrame([], "node string, label string")


def cyclic_members(links: DataFrame, most_rounds: int = 400) -> DataFrame:
    """Nodes on a directed cycle of any graph (nodes with several parents too): `member`, each once.

    A round rakes the nodes without a parent or without a child and splices out nodes with one of each whose draw
    beats those of both neighbours. When nothing can be raked and every node has one parent, the rest is cycles; when
    nothing can be spliced either, the core is split into strongly connected parts. A spliced node lies on a cycle if
    its neighbours at that time turn out to lie on one together.
    """
    base = links.select("child", "parent")
    inner = base.join(base.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("child", "parent").distinct()
    left = stored(inner, "links")
    loops = base.where("child = parent").select(F.col("child").alias("node")).distinct()
    found: dict[int, list[DataFrame]] = {0: [stored(loops.select("node", F.col("node").alias("label")), "loops")]}
    records: dict[int, DataFrame] = {}
    for turn in range(1, most_rounds):
        ends = left.where("child <> parent").select(
            F.explode(F.array(F.struct(F.col("child").alias("node"), F.col("parent").alias("up"), F.lit(None).cast("string").alias("down")),
                              F.struct(F.col("parent").alias("node"), F.lit(None).cast("string").alias("up"), F.col("child").alias("down")))).alias("e")
        ).select("e.*")
        nodes = ends.groupBy("node").agg(
            F.count("up").alias("ups"), F.count("down").alias("downs"), F.min("up").alias("up"), F.min("down").alias("down")
        )
        dead, chain = (F.col("ups") == 0) | (F.col("downs") == 0), (F.col("ups") == 1) & (F.col("downs") == 1)
        best = F.greatest(_draw(F.col("up"), turn), _draw(F.col("down"), turn))
        state = stored(nodes.select("node", "up", "down", dead.alias("dead"), chain.alias("chain"), (chain & (_draw(F.col("node"), turn) > best)).alias("splice"), (F.col("ups") > 1).alias("wide")), "nodes")
        n = state.agg(F.count(F.lit(1)).alias("rest"), F.count_if("dead").alias("dead"), F.count_if("chain").alias("chain"), F.count_if("splice").alias("splice"), F.count_if("wide").alias("wide")).first()
        if not n.rest:
            break
        if not n.dead and not n.wide:
            found.setdefault(turn, []).append(state.select("node", F.lit("").alias("label")))
            break
        if not n.dead and not n.chain:
            members, settled = _strong_parts(left.where("child <> parent"))
            found.setdefault(turn, []).append(members)
            gone, added = settled, None
        elif not n.splice:
            gone, added = state.where("dead").select("node"), None
        else:
            gone = state.where("dead or splice").select("node")
            added = state.where("splice").select(F.col("down").alias("child"), F.col("up").alias("parent"))
        kept = left.where("child <> parent").join(gone, F.col("child") == F.col("node"), "left_anti").join(gone, F.col("parent") == F.col("node"), "left_anti")
        after = stored(kept if added is None else kept.unionByName(added).distinct(), "links")
        if added is not None:
            records[turn] = state.where("splice").select("node", "up", "down")
            loops = after.where("child = parent").select(F.col("child").alias("node"))
            if not loops.isEmpty():
                found.setdefault(turn, []).append(stored(loops.select("node", F.concat(F.lit("loop "), "node").alias("label")), "loops"))
        else:
            discard(state)
        discard(left)
        left = after
    else:
        raise RuntimeError(f"the contraction did not end within {most_rounds} rounds")
    known: DataFrame | None = None
    for turn in range(max([*found, *records]), -1, -1):
        for new in found.get(turn, []):
            known = new if known is None else known.unionByName(new.join(known.select("node"), "node", "left_anti"))
        if turn in records and known is not None and not known.isEmpty():
            known = stored(known, "members")
            at = lambda end: known.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))  # noqa: B023, E731
            both = records[turn].join(at("up"), "up").join(at("down"), "down").where("label_up = label_down")
            known = known.unionByName(both.select("node", F.col("label_up").alias("label")))
    return known.select(F.col("node").alias("member")).distinct()


def contract(links: DataFrame, most_rounds: int = 200) -> list[DataFrame]:
    """Contracts a forest (each child has one parent, no cycles) to its roots.

    Returns one record of the removed nodes for each round: `child, parent, via`, where `via` holds the nodes spliced
    out between the two, top first; it is never longer than the path of the node. No parent in a record was removed in
    the same round: of two neighbours on a chain only one is spliced, by a draw for each node and round, and leaves are
    raked after their parents were spliced.
    """
    left = links.select("child", "parent", F.array().cast("array<string>").alias("via"))
    records: list[DataFrame] = []
    for turn in range(most_rounds):
        kids = left.groupBy(F.col("parent").alias("p")).agg(F.count(F.lit(1)).alias("kids"), F.min("child").alias("kid"))
        beats = (_draw(F.col("child"), turn) > _draw(F.col("parent"), turn)) & (_draw(F.col("child"), turn) > _draw(F.col("kid"), turn))
        marked = left.join(kids, F.col("child") == F.col("p"), "left").select(
            "child", "parent", "via", F.col("kids").isNull().alias("leaf"), (F.col("kids").eqNullSafe(1) & beats).alias("splice")
        )
        above = marked.where("splice").select(F.col("child").alias("v"), F.col("parent").alias("up"), F.col("via").alias("above"))
        turned = stored(
            marked.join(above, F.col("parent") == F.col("v"), "left").select(
                "child", "leaf", "splice", F.coalesce("up", "parent").alias("parent"),
                F.when(F.col("v").isNull(), F.col("via")).otherwise(F.concat("above", F.array("v"), "via")).alias("via"),
            ), "contracted",
        )
        n = turned.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("leaf") | F.col("splice")).alias("gone")).first()
        if n.gone:
            records.append(turned.where("leaf or splice").select("child", "parent", "via"))
        left = turned.where("not leaf and not splice").select("child", "parent", "via")
        if n.gone == n.all:
            return records
    raise RuntimeError(f"the contraction did not end within {most_rounds} rounds")


def expand(links: DataFrame, records: list[DataFrame], on_cycle: DataFrame) -> DataFrame:
    """Runs the record backwards: `node, root, depth, path, status` with status tree or below_cycle.

    Each round writes only what it adds. `on_cycle` has `member`: roots that lie on a cycle.
    """
    roots = links.select(F.col("parent").alias("node")).distinct().join(links.select(F.col("child").alias("node")), "node", "left_anti")
    marked = roots.join(on_cycle.select(F.col("member").alias("node"), F.lit(True).alias("turns")), "node", "left")
    parts = [stored(marked.select(
        "node", F.col("node").alias("root"), F.lit(0).alias("depth"), F.array("node").alias("path"), F.when(F.col("turns"), "below_cycle").otherwise("tree").alias("status")
    ), "expanded")]
    for record in reversed(records):
        above = _union(parts).select(F.col("node").alias("parent"), "root", "depth", F.col("path").alias("up"), "status")
        added = record.join(above, "parent").select(
            F.col("child").alias("node"), "root", (F.col("depth") + F.size("via") + 1).cast("int").alias("depth"),
            F.concat("up", "via", F.array("child")).alias("path"), "status",
        )
        parts.append(stored(added, "expanded"))
    return _union(parts)


def hierarchy(links: DataFrame, child: str, parent: str) -> DataFrame:
    """Full hierarchy of parent-child rows: `node_id, parent_id, root_id, depth, path, status, n_parents`.

    Null ends are no links, repeated rows count once, other columns are ignored, an empty input gives no rows.
    A node with several parents hangs under the least of them and `n_parents` says how many it has; its cycles
    are found over all links. Nodes on a cycle have status cycle, nodes that only hang below one below_cycle;
    both have null root, depth and path. A row that names itself as its parent is a cycle of one node.
    """
    every = stored(clean_links(links, child, parent).distinct(), "every")
    single = stored(every.groupBy("child").agg(F.min("parent").alias("parent"), F.count(F.lit(1)).cast("int").alias("n_parents")), "single")
    on_cycle = stored(cyclic_members(every), "cyclic")
    tree = stored(single.select("child", "parent").join(on_cycle, F.col("child") == F.col("member"), "left_anti"), "tree")
    nothing = {"root": "string", "depth": "int", "path": "array<string>"}
    rest = on_cycle.select(F.col("member").alias("node"), *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()), F.lit("cycle").alias("status"))
    hung = expand(tree, contract(tree), on_cycle).join(rest.select("node"), "node", "left_anti")
    told = hung.select("node", *(F.when(F.col("status") == "tree", F.col(c)).alias(c) for c in nothing), "status")
    return told.unionByName(rest).join(single.withColumnRenamed("child", "node"), "node", "left").select(
        F.col("node").alias("node_id"), F.col("parent").alias("parent_id"), F.col("root").alias("root_id"), "depth", "path", "status",
        F.coalesce("n_parents", F.lit(0)).alias("n_parents"),
    )


def descendants(full: DataFrame) -> DataFrame:
    """All (ancestor, descendant) pairs with their distance, from the paths of `hierarchy`."""
    return full.where("status = 'tree' and depth > 0").select(
        F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("at", "ancestor_id"), F.col("node_id").alias("descendant_id"), "depth"
    ).select("ancestor_id", "descendant_id", (F.col("depth") - F.col("at")).cast("int").alias("distance"))


def with_descendant_counts(full: DataFrame) -> DataFrame:
    counts = descendants(full).groupBy(F.col("ancestor_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_descendants"))
    return full.join(counts, "node_id", "left").withColumn("n_descendants", F.coalesce("n_descendants", F.lit(0).cast("bigint")))
