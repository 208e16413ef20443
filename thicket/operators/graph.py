"""Recursive queries over call graphs: reachability, trees, paths, inheritance, propagation.

Edges are DataFrames (src, dst, ...). Recursion runs as frontier joins: one
equi-join per level, reduced to distinct nodes before and after the shuffle,
minus what was seen; every level is written to the shared checkpoint folder, so
lineage stays flat and a lost executor costs one level. Results depend on
no row order. Null nodes are never entered; unknown start nodes reach only themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from thicket.functions import predicates as pr, sig
from thicket.session import cut_lineage


def valid_edges(edges: DataFrame, prefixes: Sequence[str] = ()) -> DataFrame:
    """Edges a call chain follows: enabled calls to methods that are no boilerplate and lie in the given packages.

    ``edges`` has caller, callee, call_type and enabled.
    """
    follow = F.col("enabled") & ~pr.is_inheritance(F.col("call_type")) & ~pr.is_boilerplate(F.col("callee"))
    return edges.where(follow & pr.starts_with_any(F.col("callee"), prefixes))


def arrows(edges: DataFrame, upward: bool = False) -> DataFrame:
    """Distinct (src, dst) from caller to callee, or from callee to caller."""
    a, b = ("callee", "caller") if upward else ("caller", "callee")
    return edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src is not null and dst is not null").distinct()


#: Rows up to which a counted node set is sent to all executors; larger ones are joined by shuffle.
BROADCAST_ROWS = 50_000


def _sized(df: DataFrame, n: int) -> DataFrame:
    """``df``, known to have ``n`` rows, marked for broadcast where that is few."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def reach(steps: DataFrame, starts: DataFrame, max_depth: int | None = None, stops: DataFrame | None = None) -> DataFrame:
    """(node, depth): all nodes within ``max_depth`` steps (none: any) and their least distance.

    ``steps`` is (src, dst), ``starts`` (node). Nodes of ``stops`` (node) are
    reached but not left, starts excepted. Runs one action per level. A level
    whose nodes are few meets the steps by broadcast, so that a hub's steps stay where
    they are; beyond that, adaptive execution splits a hub's partition.
    """
    if max_depth is None or max_depth > 1:
        steps = cut_lineage(steps)
    frontier = cut_lineage(starts.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)))
    seen, depth = frontier, 0
    total = n = frontier.count()
    while n and (max_depth is None or depth < max_depth):
        depth += 1
        leave = frontier.select(F.col("node").alias("src"))
        if stops is not None and depth > 1:
            leave = leave.join(stops.select(F.col("node").alias("src")), "src", "left_anti")
        new = steps.join(_sized(leave, n), "src").select(F.col("dst").alias("node")).distinct()
        frontier = cut_lineage(new.join(_sized(seen.select("node"), total), "node", "left_anti").withColumn("depth", F.lit(depth)))
        seen, n = seen.unionByName(frontier), frontier.count()
        total += n
    return seen


def cycle(steps: DataFrame, start: str) -> DataFrame:
    """One row (node, has_cycle, length): whether ``start`` is reached from its own next nodes, and the length of its shortest cycle, else null."""
    steps = cut_lineage(steps)
    back = reach(steps, steps.where(F.col("src") == start).select(F.col("dst").alias("node"))).where(F.col("node") == start)
    return back.agg(F.lit(start).alias("node"), (F.count("*") > 0).alias("has_cycle"), (F.min("depth") + 1).alias("length"))


def tree_edges(edges: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """Edges of ``edges`` (caller, ..) whose caller is reached in fewer than ``max_depth`` steps, with that ``depth``."""
    near = reach(arrows(edges), starts, max_depth - 1).withColumnRenamed("node", "caller")
    return edges.join(_sized(near, near.count()), "caller")


def assemble_tree(edges: DataFrame, start: str, max_depth: int, cap: int = 8000, order: Sequence[str] = ("call_id",)) -> list[dict]:
    """Depth-first call tree of one method as rows in visiting order, on the driver.

    The ``cap`` + 1 nearest nodes and the edges between them, one for each pair, are
    collected. A callee that is its own ancestor is a recursive leaf, one that was expanded before is left out, one
    at the depth limit or beyond ``cap`` nodes is lazy. A caller with callees beyond the nearest nodes is ``cut``, and lazy too.
    """
    spark = edges.sparkSession
    near = cut_lineage(reach(arrows(edges), spark.createDataFrame([(start,)], "node string"), max_depth))
    nodes = [tuple(r) for r in near.orderBy("depth", "node").limit(cap + 1).select("node", "depth").collect()]
    kept = F.broadcast(spark.createDataFrame(nodes, "node string, at int"))
    own = edges.join(kept.where(F.col("at") < max_depth).select(F.col("node").alias("caller")), "caller").where("callee is not null")
    inside = kept.select(F.col("node").alias("callee"))
    rows = own.join(inside, "callee").groupBy("caller", "callee").agg(F.min(F.struct(*order)).alias("first")).collect()
    cut: set[str] = set()
    if near.count() > len(nodes):
        cut = {r.caller for r in own.join(inside, "callee", "left_anti").select("caller").distinct().collect()}
    children: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (*r["first"], r["callee"])):
        children.setdefault(r["caller"], []).append(r["callee"])
    out: list[dict] = []
    done: set[str] = set()
    stack = [(start, None, 0, ())]
    while stack:
        node, parent, depth, path = stack.pop()
        if node in path:
            out.append({"node": node, "parent": parent, "depth": depth, "recursive": True, "lazy": False, "cut": False})
            continue
        if node in done:
            continue
        lazy = depth >= max_depth or len(out) >= cap
        out.append({"node": node, "parent": parent, "depth": depth, "recursive": False, "lazy": lazy or node in cut, "cut": not lazy and node in cut})
        if not lazy:
            done.add(node)
            stack += [(c, node, depth + 1, (*path, node)) for c in reversed(children.get(node, []))]
    return out


def simple_paths(steps: DataFrame, starts: DataFrame, max_depth: int, max_rows: int | None = None) -> DataFrame:
    """(node, depth, path): every path without repeated node of 0..``max_depth`` steps; at most ``max_rows`` per level where given.

    Their number can be exponential in the depth; with ``max_rows`` the paths of least order are kept.
    """
    level = starts.select("node").distinct().select("node", F.lit(0).alias("depth"), F.array("node").alias("path"))
    level, steps = cut_lineage(level), cut_lineage(steps)
    out = level
    for depth in range(1, max_depth + 1):
        nxt = steps.join(_sized(level, level.count()), F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        nxt = nxt.select(F.col("dst").alias("node"), F.lit(depth).alias("depth"), F.array_append("path", F.col("dst")).alias("path"))
        level = cut_lineage(nxt if max_rows is None else nxt.orderBy("path").limit(max_rows))
        out = out.unionByName(level)
    return out


def bridge(inheritance: DataFrame, calls: DataFrame, methods: DataFrame) -> DataFrame:
    """Edges (caller, callee) from methods of interfaces to the same methods of their implementations.

    ``inheritance`` has (child, parent) classes. Only methods that call nothing
    themselves are bridged; an implementation must be a caller in ``calls`` or one of ``methods`` (full_method).
    """
    callees = calls.select(F.col("callee").alias("m")).distinct()
    idle = callees.join(calls.select(F.col("caller").alias("m")), "m", "left_anti")
    of_class = idle.select("m", sig.class_name(F.col("m")).alias("parent"), F.substring_index("m", ":", -1).alias("tail"))
    wanted = of_class.join(inheritance, "parent").select(F.col("m").alias("caller"), F.concat_ws(":", "child", "tail").alias("callee"))
    known = calls.select(F.col("caller").alias("callee")).unionByName(methods.select(F.col("full_method").alias("callee"))).distinct()
    return wanted.join(known, "callee", "left_semi").select("caller", "callee").distinct()


def callees(edges: DataFrame, starts: DataFrame, inheritance: DataFrame, methods: DataFrame) -> DataFrame:
    """Direct callees (caller, callee, call_type) of the starts; methods without any get their implementations as IMPL."""
    own = valid_edges(edges).join(starts.select(F.col("node").alias("caller")), "caller", "left_semi").select("caller", "callee", "call_type")
    idle = starts.select(F.col("node").alias("caller")).join(own, "caller", "left_anti")
    parts = idle.select("caller", sig.class_name(F.col("caller")).alias("parent"), F.substring_index("caller", ":", -1).alias("tail"))
    impl = parts.join(inheritance, "parent").select("caller", F.concat_ws(":", "child", "tail").alias("callee"))
    known = edges.select(F.col("caller").alias("callee")).unionByName(methods.select(F.col("full_method").alias("callee")))
    impl = impl.join(known, "callee", "left_semi").select("caller", "callee", F.lit("IMPL").alias("call_type"))
    return own.unionByName(impl).distinct()


def propagate(steps: DataFrame, own: DataFrame, hops: int) -> DataFrame:
    """(node, mark): marks of nodes without own mark, taken from all nodes they reach within ``hops`` steps.

    ``own`` is (node, mark). Every node gets every mark in reach; nodes with a
    mark of their own pass others on but are not in the result.
    """
    back = cut_lineage(steps.select(F.col("src").alias("to"), F.col("dst").alias("node")))
    level = cut_lineage(own.select("node", "mark").where("node is not null").distinct())
    seen, n = level, level.count()
    for _ in range(hops):
        new = back.join(_sized(level, n), "node").select(F.col("to").alias("node"), "mark").distinct()
        level = cut_lineage(new.join(seen, ["node", "mark"], "left_anti"))
        n = level.count()
        if not n:
            break
        seen = seen.unionByName(level)
    return seen.join(own.select("node"), "node", "left_anti")


def ancestors(inheritance: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(child, ancestor, distance): the inheritance closure with least distances, up to ``max_depth`` (none: all of it); cycles end."""
    seen = inheritance.select("child", F.col("parent").alias("ancestor")).distinct().withColumn("distance", F.lit(1))
    seen, before = cut_lineage(seen), None
    # each round joins what is known with itself, so that the distances known double
    while (now := seen.agg(F.count("*"), F.sum("distance")).first()) != before:
        up = seen.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("next"), F.col("distance").alias("more"))
        far = seen.join(up, "ancestor").select("child", F.col("next").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        if max_depth is not None:
            far = far.where(F.col("distance") <= max_depth)
        seen, before = cut_lineage(seen.unionByName(far).groupBy("child", "ancestor").agg(F.min("distance").alias("distance"))), now
    return seen


def inheritance_roots(inheritance: DataFrame) -> DataFrame:
    """Parents that have no parent themselves: (node)."""
    return inheritance.select(F.col("parent").alias("node")).distinct().join(inheritance.select(F.col("child").alias("node")), "node", "left_anti")


def polymorphic_edges(inheritance: DataFrame, methods: DataFrame) -> DataFrame:
    """Synthetic call edges (caller, callee, call_type) from inheritance.

    ``inheritance`` is (child, parent, kind: EXTENDS or IMPLEMENTS), ``methods``
    (class_name, method_key, abstract). An abstract method calls what its
    subclasses define or inherit (_SCC from a class, _ITF from an interface); a class
    that lacks a method calls the one of its nearest superclass that has a body (_CCS).
    """
    m = methods.select("class_name", "method_key", "abstract").distinct()
    closure = ancestors(inheritance.select("child", "parent"))
    direct = inheritance.groupBy("parent").agg(F.max(F.col("kind") == "IMPLEMENTS").alias("interface"))
    # nearest concrete definition for every class and method key, its own first
    above = closure.join(m.where("not abstract").withColumnRenamed("class_name", "ancestor"), "ancestor")
    own = m.where("not abstract").select(F.col("class_name").alias("child"), F.col("class_name").alias("ancestor"), "method_key", F.lit(0).alias("distance"))
    every = own.unionByName(above.select("child", "ancestor", "method_key", "distance"))
    body = every.groupBy("child", "method_key").agg(F.min_by("ancestor", F.struct("distance", "ancestor")).alias("holder"), F.min("distance").alias("distance"))
    call = lambda c, k: F.concat_ws(":", c, k)
    missing = body.where("distance > 0").join(m.select(F.col("class_name").alias("child"), "method_key"), ["child", "method_key"], "left_anti")
    up = missing.select(call("child", "method_key").alias("caller"), call("holder", "method_key").alias("callee"), F.lit("_CCS").alias("call_type"))
    abstract = m.where("abstract").select(F.col("class_name").alias("ancestor"), "method_key")
    down = closure.select("child", "ancestor").join(abstract, "ancestor").join(body.select("child", "method_key"), ["child", "method_key"])
    down = down.join(direct.withColumnRenamed("parent", "ancestor"), "ancestor")
    down = down.select(
        call("ancestor", "method_key").alias("caller"), call("child", "method_key").alias("callee"), F.when(F.col("interface"), "_ITF").otherwise("_SCC").alias("call_type")
    )
    return up.unionByName(down).distinct()


def package_tree(classes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Compacted package tree: (by.., name, level, n_classes).

    ``classes`` has ``by``, package_name and class_name. Packages that hold no class of their own and whose only child
    counts as many classes are merged into it.
    """
    c = classes.select(*by, "package_name", "class_name").distinct()
    levels = c.select(*by, "class_name", "package_name", F.inline(sig.package_levels(F.col("package_name"))))
    nodes = levels.groupBy(*by, "level", "name").agg(F.count_distinct("class_name").alias("n_classes"), F.max(F.col("name") == F.col("package_name")).alias("own"))
    kids = nodes.where("level > 1").groupBy(*by, sig.package_name(F.col("name")).alias("name")).agg(F.max("n_classes").alias("most"))
    full = nodes.join(kids, [*by, "name"], "left")
    return full.where(F.col("own") | ~F.col("most").eqNullSafe(F.col("n_classes"))).select(*by, "name", "level", "n_classes")


def short_ref_targets(methods: DataFrame, refs: DataFrame, most: int | None = 10) -> DataFrame:
    """Up to ``most`` signatures (none: all) as (ref, full_method, rank) for each ``Class.method`` of ``refs`` (ref), in name order."""
    known = methods.select("full_method", sig.short_ref(F.col("full_method")).alias("ref")).distinct()
    w = Window.partitionBy("ref").orderBy("full_method")
    ranked = known.join(refs.select("ref").distinct(), "ref", "left_semi").withColumn("rank", F.row_number().over(w))
    return ranked if most is None else ranked.where(F.col("rank") <= most)
