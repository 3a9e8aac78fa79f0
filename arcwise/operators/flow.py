"""Maximum flow by synchronous push and relabel, and the cuts that follow from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcwise.functions.ranking import with_global_index
from arcwise.operators.components import star_labels
from arcwise.operators.connectivity import as_tree, reachable_from
from arcwise.operators.graph import Graph
from arcwise.storage import materialize


#: Problems that are sent to all tasks; more of them are joined by shuffling.
FEW = 1000


def _each(arcs: DataFrame, problems: DataFrame) -> DataFrame:
    """Every arc for every problem."""
    ids = problems.select("problem_id").distinct()
    return arcs.join(F.broadcast(ids) if ids.limit(FEW + 1).count() <= FEW else ids)


def _global_labels(res: DataFrame, ends: DataFrame, sizes: DataFrame) -> DataFrame:
    """Exact labels: steps to the sink over arcs with room, else the number of vertices and the steps to the source."""
    back = res.where("room > 0").select("problem_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    to_sink = reachable_from(back, ends.select("problem_id", F.col("sink").alias("id")), keys=("problem_id",))
    to_source = reachable_from(back, ends.select("problem_id", F.col("source").alias("id")), keys=("problem_id",))
    vertices = res.select("problem_id", F.col("src").alias("v")).distinct().join(sizes, "problem_id").join(ends, "problem_id")
    a = to_sink.select("problem_id", F.col("id").alias("v"), F.col("hops").alias("a"))
    b = to_source.select("problem_id", F.col("id").alias("v"), F.col("hops").alias("b"))
    labelled = vertices.join(a, ["problem_id", "v"], "left").join(b, ["problem_id", "v"], "left")
    height = F.when(F.col("v") == F.col("source"), F.col("n")).otherwise(F.coalesce("a", F.col("n") + F.col("b"), 2 * F.col("n")))
    return materialize(labelled.select("problem_id", "v", "n", "source", "sink", height.cast("long").alias("h")))


def max_flow(arcs: DataFrame, problems: DataFrame, refresh: int = 6, max_rounds: int = 10_000) -> DataFrame:
    """``problem_id, src, dst, flow`` of the largest flow for each row ``problem_id, source, sink``.

    ``arcs`` has ``src, dst, capacity`` and, if it has ``problem_id``, arcs of each
    problem's own. All problems move in the same rounds: every vertex with excess
    pushes along arcs that go one label down, in order of the far end, then those that
    could not get rid of it are raised. Labels are made exact every few rounds.
    ``flow(u, v) = -flow(v, u)``; both directions are returned. Arcs that problems share are
    copied for each, so the work is arcs times problems; deal many problems into several calls.
    """
    ends = problems.select("problem_id", "source", "sink")
    own = arcs if "problem_id" in arcs.columns else _each(arcs, problems)
    own = own.groupBy("problem_id", "src", "dst").agg(F.sum("capacity").alias("capacity"))
    zero = F.lit(0).cast(dict(own.dtypes)["capacity"])
    mirrored = own.union(own.select("problem_id", "dst", "src", zero)).groupBy("problem_id", "src", "dst").agg(F.sum("capacity").alias("capacity"))
    cap = materialize(mirrored)
    sizes = materialize(cap.groupBy("problem_id").agg(F.countDistinct("src").alias("n")))
    # all arcs out of the source start full
    start = cap.join(ends, "problem_id")
    push0 = start.where("src = source").select("problem_id", "src", "dst", F.col("capacity").alias("push"))
    res = materialize(_moved(cap.withColumnRenamed("capacity", "room"), push0))
    excess = push0.groupBy("problem_id", F.col("dst").alias("v")).agg(F.sum("push").alias("e"))
    state = None
    for turn in range(max_rounds):
        if turn % refresh == 0:
            labels = _global_labels(res, ends, sizes)
            current = excess if state is None else state.select("problem_id", "v", "e")
            state = materialize(labels.join(current, ["problem_id", "v"], "left").withColumn("e", F.coalesce("e", zero)))
        inner = (F.col("v") != F.col("source")) & (F.col("v") != F.col("sink"))
        active = state.where(inner & (F.col("e") > 0))
        if active.limit(1).count() == 0:
            break
        far = state.select("problem_id", F.col("v").alias("dst"), F.col("h").alias("h2"))
        out = active.select("problem_id", F.col("v").alias("src"), "e", "h").join(res.where("room > 0"), ["problem_id", "src"]).join(far, ["problem_id", "dst"])
        before = Window.partitionBy("problem_id", "src").orderBy("dst").rowsBetween(Window.unboundedPreceding, -1)
        allowed = out.where("h = h2 + 1").withColumn("gone", F.coalesce(F.sum("room").over(before), zero))
        push = materialize(allowed.select("problem_id", "src", "dst", F.when(F.col("e") - F.col("gone") >= F.col("room"), F.col("room")).otherwise(F.greatest(F.col("e") - F.col("gone"), zero)).alias("push")).where("push > 0"))
        res = materialize(_moved(res, push))
        change = push.select("problem_id", F.col("src").alias("v"), (-F.col("push")).alias("c")).union(push.select("problem_id", "dst", "push"))
        change = change.groupBy("problem_id", "v").agg(F.sum("c").alias("c"))
        state = materialize(state.join(change, ["problem_id", "v"], "left").withColumn("e", F.col("e") + F.coalesce("c", zero)).drop("c"))
        far = state.select("problem_id", F.col("v").alias("dst"), F.col("h").alias("h2"))
        stuck = state.where(inner & (F.col("e") > 0)).select("problem_id", F.col("v").alias("src"), "h").join(res.where("room > 0"), ["problem_id", "src"]).join(far, ["problem_id", "dst"])
        raised = stuck.groupBy("problem_id", F.col("src").alias("v")).agg(F.min("h2").alias("m"), F.max("h").alias("old")).where("m >= old").select("problem_id", "v", (F.col("m") + 1).alias("up"))
        state = materialize(state.join(raised, ["problem_id", "v"], "left").withColumn("h", F.coalesce("up", "h")).drop("up"))
    else:
        raise RuntimeError(f"flow did not settle in {max_rounds} rounds")
    rooms = res.select("problem_id", "src", "dst", "room")
    # room(u, v) = capacity(u, v) - flow(u, v)
    return cap.join(rooms, ["problem_id", "src", "dst"]).select("problem_id", "src", "dst", (F.col("capacity") - F.col("room")).alias("flow"))


def _moved(res: DataFrame, push: DataFrame) -> DataFrame:
    delta = push.select("problem_id", "src", "dst", (-F.col("push")).alias("room")).union(push.select("problem_id", "dst", "src", "push"))
    return res.select("problem_id", "src", "dst", "room").union(delta).groupBy("problem_id", "src", "dst").agg(F.sum("room").alias("room"))


def total_flow(flow: DataFrame, source) -> DataFrame:
    """``flow`` out of a vertex, one row."""
    return flow.where(F.col("src") == F.lit(source)).agg(F.coalesce(F.sum("flow"), F.lit(0)).alias("flow"))


def flow_between(flow: DataFrame, pairs: DataFrame) -> DataFrame:
    return pairs.select("src", "dst").join(flow.select("src", "dst", "flow"), ["src", "dst"], "left").select("src", "dst", F.coalesce("flow", F.lit(0)).alias("flow"))


def add_flow(flow: DataFrame, more: DataFrame) -> DataFrame:
    """``flow`` with the rows ``src, dst, flow`` of ``more`` added, and taken off the other direction."""
    both = more.select("src", "dst", "flow").union(more.select("dst", "src", -F.col("flow")))
    return flow.select("src", "dst", "flow").union(both).groupBy("src", "dst").agg(F.sum("flow").alias("flow"))


def set_flow(flow: DataFrame, new: DataFrame) -> DataFrame:
    both = new.select("src", "dst", "flow").union(new.select("dst", "src", -F.col("flow")))
    return flow.select("src", "dst", "flow").join(both.select("src", "dst"), ["src", "dst"], "left_anti").union(both)


def residual_arcs(arcs: DataFrame, flow: DataFrame, both_ways: bool = False) -> DataFrame:
    """``src, dst`` (and ``problem_id``) of arcs with room; with ``both_ways`` only where neither direction is full."""
    k = [c for c in ("problem_id",) if c in flow.columns]
    cap = arcs if "problem_id" in arcs.columns or not k else _each(arcs, flow)
    rooms = flow.join(cap, [*k, "src", "dst"], "left").where(F.col("flow") < F.coalesce("capacity", F.lit(0))).select(*k, "src", "dst")
    if not both_ways:
        return rooms
    return rooms.join(rooms.select(*k, F.col("dst").alias("src"), F.col("src").alias("dst")), [*k, "src", "dst"], "left_semi").where("src < dst")


def min_st_cut(arcs: DataFrame, problems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``problem_id, id, side`` (1: the source's) and ``problem_id, value``, for each problem."""
    flow = materialize(max_flow(arcs, problems))
    room = residual_arcs(arcs, flow)
    near = reachable_from(room, problems.select("problem_id", F.col("source").alias("id")), keys=("problem_id",))
    every = flow.select("problem_id", F.col("src").alias("id")).distinct()
    sides = every.join(near.select("problem_id", "id", F.lit(1).alias("side")), ["problem_id", "id"], "left").select("problem_id", "id", F.coalesce("side", F.lit(0)).alias("side"))
    value = flow.join(problems, (flow.problem_id == problems.problem_id) & (flow.src == problems.source)).groupBy(flow.problem_id).agg(F.sum("flow").alias("value"))
    return sides, value


def _capacities(g: Graph, cost) -> DataFrame:
    c = F.col(cost) if isinstance(cost, str) else cost
    e = g.edges.select("src", "dst", c.alias("capacity"))
    return e.union(e.select("dst", "src", "capacity"))


def global_min_cut(g: Graph, cost="cost", at_once: int = 64) -> tuple[DataFrame, object]:
    """``id, side`` and the cost of the cheapest split in two; one vertex or a graph in parts costs 0.

    The smallest vertex is parted from every other; ``at_once`` of these problems are solved at a time, each with its copy of the arcs.
    """
    if g.vertex_count() == 0:
        raise ValueError("a cut needs at least one vertex")
    labels = star_labels(g.edges)
    parts = materialize(g.vertices.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("c")))
    least = parts.agg(F.min("id"), F.min("c"), F.max("c")).first()
    if least[1] != least[2] or parts.count() == 1:
        return parts.select("id", (F.col("c") == F.lit(least[1])).cast("int").alias("side")), 0
    rest = parts.where(F.col("id") != F.lit(least[0])).select(F.col("id").alias("problem_id"), F.lit(least[0]).alias("source"), F.col("id").alias("sink"))
    problems = materialize(with_global_index(rest, ["problem_id"], "at"))
    arcs, best = materialize(_capacities(g, cost)), None
    for low in range(0, problems.count(), at_once):
        sides, value = min_st_cut(arcs, problems.where(F.col("at").between(low, low + at_once - 1)).select("problem_id", "source", "sink"))
        found = value.orderBy("value", "problem_id").first()
        if best is None or found["value"] < best[1]:
            best = sides.where(F.col("problem_id") == F.lit(found["problem_id"])).select("id", "side"), found["value"]
    return best


def _branches(problems: DataFrame, groups: DataFrame, tree: DataFrame) -> DataFrame:
    """``problem_id, grp, root``: for each open group, which branch of the tree at it every other group hangs on, named by its smallest group."""
    ids = problems.select("problem_id")
    others = ids.join(groups.select("grp").distinct(), F.col("problem_id") != F.col("grp"))
    inner = tree.join(ids, (F.col("a") != F.col("problem_id")) & (F.col("b") != F.col("problem_id")))
    key = lambda c: F.struct("problem_id", F.col(c).alias("g"))
    labels = star_labels(materialize(inner.select(key("a").alias("src"), key("b").alias("dst"))))
    named = labels.select("id.problem_id", F.col("id.g").alias("grp"), F.col("component.g").alias("root"))
    return others.join(named, ["problem_id", "grp"], "left").select("problem_id", "grp", F.coalesce("root", "grp").alias("root"))


def gomory_hu_tree(g: Graph, cost="cost") -> DataFrame:
    """``src, dst, cost``: a tree in which the least cost on a path is the two ends' least cut.

    Level by level: every group of vertices not yet told apart picks its two
    smallest and is split by their least cut, in the graph where each branch of
    the tree so far at that group is one vertex. All groups of a level are one table of problems; groups and the tree
    are tables too. A level's branches take a row for each open group and group.
    """
    arcs = materialize(_capacities(g, cost))
    kind, amount = dict(g.vertices.dtypes)["id"], dict(arcs.dtypes)["capacity"]
    spark = g.vertices.sparkSession
    groups = materialize(g.vertices.select("id", F.lit(0).cast("long").alias("grp")))
    tree = spark.createDataFrame([], f"a long, b long, cost {amount}")
    n_groups = 1
    while True:
        pick = groups.groupBy("grp").agg(F.min("id").alias("source"), F.count(F.lit(1)).alias("n")).where("n > 1")
        second = groups.join(pick, "grp").where("id <> source").groupBy("grp", "source").agg(F.min("id").alias("sink"))
        problems = materialize(second.select(F.col("grp").alias("problem_id"), "source", "sink"))
        n_open = problems.count()
        if not n_open:
            break
        hung = materialize(_branches(problems, groups, tree))
        # names in a problem: an own vertex by itself, a branch by the smallest group in it
        inside = groups.join(problems.select("problem_id"), F.col("grp") == F.col("problem_id")).select("problem_id", "id", F.struct(F.lit(0).cast("long").alias("b"), F.col("id").alias("v")).alias("name"))
        outside = groups.join(hung, "grp").select("problem_id", "id", (F.col("root") + 1).alias("b"))
        first = materialize(outside.groupBy("problem_id", "b").agg(F.min("id").alias("v")))
        outside = outside.join(first, ["problem_id", "b"]).select("problem_id", "id", F.struct("b", "v").alias("name"))
        names = materialize(inside.union(outside))
        a, b = names.select("problem_id", F.col("id").alias("src"), F.col("name").alias("a")), names.select("problem_id", F.col("id").alias("dst"), F.col("name").alias("b"))
        merged = arcs.join(a, "src").join(b, ["problem_id", "dst"]).where("a <> b").groupBy("problem_id", F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("capacity").alias("capacity"))
        own = lambda c: F.struct(F.lit(0).cast("long").alias("b"), F.col(c).alias("v")).alias(c)
        sides, value = min_st_cut(materialize(merged), problems.select("problem_id", own("source"), own("sink")))
        sides = materialize(sides.select("problem_id", F.col("id.b").alias("b"), F.col("id.v").alias("v"), "side"))
        new = with_global_index(problems.select("problem_id"), ["problem_id"], "at")
        new = materialize(new.select(F.col("problem_id").alias("grp"), (F.col("at") + n_groups).alias("fresh")))
        n_groups += n_open
        # branches on the sink's side hang on the new group from now on
        moved = sides.where("b > 0 AND side = 0").select("problem_id", (F.col("b") - 1).alias("root")).distinct()
        moved = materialize(moved.join(hung, ["problem_id", "root"]).select("problem_id", F.col("grp").alias("other")).join(new.toDF("problem_id", "fresh"), "problem_id"))
        for end, far in (("a", "b"), ("b", "a")):
            turned = moved.select(F.col("problem_id").alias(end), F.col("other").alias(f"_{far}"), "fresh")
            # the far end may have changed its name in this level; branches go by the names before
            tree = tree.withColumn(f"_{end}", F.col(end)) if f"_{end}" not in tree.columns else tree
            tree = tree.withColumn(f"_{far}", F.col(far)) if f"_{far}" not in tree.columns else tree
            known = turned.select(F.col(end).alias(f"_{end}"), f"_{far}", "fresh")
            tree = tree.join(known, ["_a", "_b"], "left").withColumn(end, F.coalesce("fresh", end)).drop("fresh")
        added = value.join(new.toDF("problem_id", "fresh"), "problem_id").select(F.col("problem_id").alias("a"), F.col("fresh").alias("b"), F.col("value").cast(amount).alias("cost"))
        tree = materialize(tree.select("a", "b", "cost").union(added))
        far = sides.where("b = 0 AND side = 0").select(F.col("problem_id").alias("grp"), F.col("v").alias("id"), F.lit(True).alias("far"))
        groups = materialize(groups.join(far, ["grp", "id"], "left").join(new, "grp", "left").select("id", F.when(F.col("far"), F.col("fresh")).otherwise(F.col("grp")).alias("grp")))
    names = groups.select(F.col("grp").alias("g"), "id")
    x, y = names.toDF("a", "ia"), names.toDF("b", "ib")
    return tree.join(x, "a").join(y, "b").select(F.least("ia", "ib").alias("src"), F.greatest("ia", "ib").alias("dst"), "cost")


def tree_cuts(tree: DataFrame) -> DataFrame:
    """``child, id, side, cost`` for each edge of ``src, dst, cost``, named by its lower end; side 1 is its subtree."""
    ends = tree.select(F.col("src").alias("id")).union(tree.select("dst")).distinct()
    rooted = as_tree(Graph(ends, tree))
    if rooted is None:
        raise ValueError("not a tree")
    rooted = materialize(rooted)
    up = rooted.where("parent IS NOT NULL")
    # all pairs of a vertex and one above it
    closure = layer = materialize(up.select(F.col("id").alias("child"), "id"))
    while layer.limit(1).count():
        layer = materialize(layer.join(up.select("id", F.col("parent").alias("p")), layer["child"] == up["id"]).select(F.col("p").alias("child"), layer["id"]).join(up.select(F.col("id").alias("child")), "child", "left_semi"))
        closure = closure.union(layer)
    named = up.select(F.col("id").alias("child"), F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst")).join(tree, ["src", "dst"])
    every = named.select("child", "cost").crossJoin(ends)
    inside = closure.select("child", "id", F.lit(1).alias("side")).distinct()
    return every.join(inside, ["child", "id"], "left").select("child", "id", F.coalesce("side", F.lit(0)).alias("side"), "cost")


def tree_min_cut(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, cost, child``: the cheapest edge between each pair, of equal ones that of the smallest child; an edge is named by its lower end.

    Tables of jumps of 1, 2, 4 ... steps up, each with the cheapest edge on its way, take the deeper end of a pair to
    the other's level and both to where they meet, so a pair stays one row through some log depth joins.
    """
    ends = tree.select(F.col("src").alias("id")).union(tree.select("dst")).distinct()
    rooted = as_tree(Graph(ends, tree))
    if rooted is None:
        raise ValueError("not a tree")
    rooted = materialize(rooted)
    up = rooted.where("parent IS NOT NULL")
    priced = up.withColumn("src", F.least("id", "parent")).withColumn("dst", F.greatest("id", "parent")).join(tree, ["src", "dst"])
    jumps = [materialize(priced.select("id", F.col("parent").alias("to"), F.struct("cost", F.col("id").alias("child")).alias("m")))]
    while True:
        far = jumps[-1].select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("m").alias("m2"))
        longer = materialize(jumps[-1].join(far, "to").select("id", F.col("to2").alias("to"), F.least("m", "m2").alias("m")))
        if longer.isEmpty():
            break
        jumps.append(longer)
    depth = rooted.select("id", "depth")
    placed = pairs.select("a", "b").where("a <> b").join(depth.toDF("a", "da"), "a").join(depth.toDF("b", "db"), "b")
    low = F.col("da") >= F.col("db")
    kind = jumps[0].schema["m"].dataType
    state = placed.select("a", "b", F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y"), F.abs(F.col("da") - F.col("db")).alias("gap"), F.lit(None).cast(kind).alias("best"))
    state = materialize(state)

    def jumped(state, k, both):
        ends = [(c, jumps[k].toDF(c, f"to_{c}", f"m_{c}")) for c in (("x", "y") if both else ("x",))]
        for c, jump in ends:
            state = state.join(jump, c, "left")
        go = (F.col("to_x") != F.col("to_y")) if both else (F.col("gap") >= (1 << k))
        go = F.coalesce(go, F.lit(False))
        moved = {c: F.when(go, F.col(f"to_{c}")).otherwise(F.col(c)) for c, _ in ends}
        best = F.when(go, F.least("best", *[f"m_{c}" for c, _ in ends])).otherwise(F.col("best"))
        gap = F.col("gap") if both else F.when(go, F.col("gap") - (1 << k)).otherwise(F.col("gap"))
        return materialize(state.select("a", "b", *[moved.get(c, F.col(c)).alias(c) for c in ("x", "y")], gap.alias("gap"), best.alias("best")))

    for k in range(len(jumps) - 1, -1, -1):
        state = jumped(state, k, False)
    for k in range(len(jumps) - 1, -1, -1):
        state = jumped(state, k, True)
    last = state.join(jumps[0].toDF("x", "to_x", "m_x"), "x", "left").join(jumps[0].toDF("y", "to_y", "m_y"), "y", "left")
    m = F.when(F.col("x") == F.col("y"), F.col("best")).otherwise(F.least("best", "m_x", "m_y"))
    return last.select("a", "b", m.alias("m")).select("a", "b", "m.cost", "m.child")
