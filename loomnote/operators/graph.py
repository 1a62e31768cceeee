"""Links, neighbourhoods, activation and communities on edge tables (from_path, to_path, relation_type, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..storage import counted, written

WIKILINK = r"\[\[([^\[\]\|#]+)(?:[#\|][^\[\]]*)?\]\]"


def wikilinks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "body") -> DataFrame:
    """id, target: the distinct [[links]] in each text."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text_col, F.lit(WIKILINK), 1), lambda x: F.trim(x)))
    return docs.select(id_col, F.explode(found).alias("target")).where("target <> ''")


def resolve(links: DataFrame, pages: DataFrame, raw: str = "raw", path: str = "path") -> DataFrame:
    """links with to_path and reason: a raw target is a path, a path without ending, a name or a slug; only one that a single page has resolves."""
    base = F.element_at(F.split(path, "/"), -1)
    plain = F.regexp_replace(path, r"\.md$", "")
    name = F.regexp_replace(base, r"\.md$", "")
    forms = pages.select(F.col(path).alias("p"), F.explode(F.array_distinct(F.array(F.col(path), plain, base, name))).alias("form"))
    known = forms.groupBy("form").agg(F.count_distinct("p").alias("n"), F.min("p").alias("p"))
    found = links.join(known, links[raw] == known["form"], "left")
    return found.select(*links.columns, F.when(F.col("n") == 1, F.col("p")).alias("to_path"), F.when(F.col("n").isNull(), "not-found").when(F.col("n") > 1, "ambiguous").alias("reason"))


def lint_resolve(links: DataFrame, pages: DataFrame, raw: str = "target") -> DataFrame:
    """links with to_path: the page (path) that a target names without its ending, else the only one with that file name; null if there is none."""
    known = pages.select("path", F.regexp_replace("path", r"\.md$", "").alias("form")).distinct()
    names = known.groupBy(F.element_at(F.split("form", "/"), -1).alias("name")).agg(F.count("*").alias("n"), F.min("path").alias("only")).where("n = 1").select("name", "only")
    clean = links.withColumn("__clean", F.regexp_replace(F.trim(F.col(raw)), r"\.md$", ""))
    found = clean.join(known.select("form", F.col("path").alias("__p")), F.col("__clean") == F.col("form"), "left").join(names, F.col("__clean") == F.col("name"), "left")
    return found.select(*links.columns, F.coalesce("__p", "only").alias("to_path"))


def dependents(edges: DataFrame, starts: DataFrame, hops: int = 2) -> DataFrame:
    """start, path, via of the nodes from which ``hops`` steps at most lead to each start (path), each at its shortest way, the smallest if there are several; starts themselves left out."""
    back = edges.select("from_path", "to_path").distinct()
    reached = starts.select(F.col("path").alias("start"), "path", F.array("path").alias("via"))
    seen, frontier = reached, reached
    for _ in range(hops):
        step = frontier.join(back, frontier["path"] == back["to_path"]).select("start", F.col("from_path").alias("path"), F.array_prepend("via", F.col("from_path")).alias("via"))
        frontier = step.groupBy("start", "path").agg(F.min("via").alias("via")).join(seen.select("start", "path"), ["start", "path"], "left_anti")
        seen = seen.unionByName(frontier)
    return seen.where("start <> path")


def degrees(edges: DataFrame) -> DataFrame:
    """path, inbound, outbound, total, counted in one shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("from_path").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("to_path").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.select("e.*").groupBy("path").agg(F.sum("i").alias("inbound"), F.sum("o").alias("outbound")).withColumn("total", F.col("inbound") + F.col("outbound"))


def both_ways(edges: DataFrame) -> DataFrame:
    """edges seen from either end: near, far and the other columns."""
    rest = [c for c in edges.columns if c not in ("from_path", "to_path")]
    return edges.select(F.col("from_path").alias("near"), F.col("to_path").alias("far"), *rest).unionByName(edges.select(F.col("to_path").alias("near"), F.col("from_path").alias("far"), *rest))


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """path, hop of the nodes that seeds (path) reach in so many steps, seeds left out, each at its first hop.

    Nodes are hashed by path, each once, and links pass by them: neither the links nor what they reach is sorted.
    """
    links = both_ways(edges.select("from_path", "to_path"))
    seen = seeds.select("path").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for hop in range(1, hops + 1):
        step = links.join(frontier.select(F.col("path").alias("near")).hint("shuffle_hash"), "near", "left_semi").select(F.col("far").alias("path")).distinct()
        frontier = step.join(seen.select("path").hint("shuffle_hash"), "path", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen.where("hop > 0")


def edge_weight(relation: Column, kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in params.EDGE_WEIGHTS.items() for x in kv])
    return F.coalesce(table[relation], table[kind], F.lit(1.0))


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """query_id, path, score of the nodes one step from a query's seeds (query_id, path, place), seeds left out: in the order in which a walk from the seeds one after the other, over links in order of the other end, comes to them (score: minus the number of the first seed)."""
    links = both_ways(edges.select("from_path", "to_path")).select("near", "far").distinct()
    step = seeds.join(links, seeds["path"] == links["near"]).groupBy("query_id", F.col("far").alias("path")).agg((-F.min("place")).alias("score"))
    return step.join(seeds.select("query_id", "path"), ["query_id", "path"], "left_anti")


#: Links of a task of spreading activation.
TASK_LINKS = 500_000


def activate(edges: DataFrame, seeds: DataFrame, rounds: int = params.ACTIVATION_ROUNDS, decay: float = params.ACTIVATION_DECAY, inhibition: float = params.INHIBITION, epsilon: float = params.ACTIVATION_EPSILON, outbound: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """path, activation: spreading activation from seeds (1 each, part of the result). by: columns of seeds (of queries, say) whose values spread each for themselves.

    A round sends activation * weight * decay to neighbours not yet reached; a node loses a share of the strongest
    other child of each of its parents, for which the two strongest children of a parent suffice. What a round
    reaches is a table in the shared folder, so no round repeats the work of those before. Nodes are hashed, each
    once, and links and what is sent pass by them unsorted, in so many partitions that a task's nodes and links are
    bounded, whatever the session's number; with ``by`` a node may stand there for many, and joins are Spark's choice.
    """
    by = list(by)
    weighted = edges.withColumn("w", edge_weight(F.col("relation_type"), F.col("kind"))).select("from_path", "to_path", "w")
    links = weighted.select(F.col("from_path").alias("near"), F.col("to_path").alias("far"), "w") if outbound else both_ways(weighted)
    tasks = 0 if by else -(-edges.count() * (1 if outbound else 2) // TASK_LINKS)
    parted = lambda rows, key: rows.repartition(tasks, key) if tasks > int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows
    once = lambda nodes, key: nodes if by else parted(nodes, key).hint("shuffle_hash")
    reached = frontier = written(seeds.select(*by, "path").distinct().withColumn("activation", F.lit(1.0)), "activation")
    # The two strongest children of a parent: the first, and the one after it.
    order = Window.partitionBy(*by, "near").orderBy(F.desc("c"), F.desc("far"))
    for _ in range(rounds):
        given = once(frontier.select(*by, F.col("path").alias("near"), "activation"), "near").join(parted(links, "near"), "near")
        # Not an anti-join, which the optimizer would push down to all links.
        sent = parted(given, "far").join(once(reached.select(*by, F.col("path").alias("far"), F.lit(True).alias("known")), "far"), [*by, "far"], "left").where("known IS NULL")
        child = sent.groupBy(*by, "near", "far").agg(F.sum(F.col("activation") * F.col("w") * decay).alias("c"))
        ranked = parted(child, "near").withColumns({"place": F.row_number().over(order), "first": F.first("c").over(order), "next": F.lead("c").over(order)})
        rival = F.when(F.col("place") == 1, F.coalesce("next", F.lit(0.0))).otherwise(F.col("first"))
        total = ranked.groupBy(*by, F.col("far").alias("path")).agg((F.sum("c") - inhibition * F.sum(rival)).alias("activation"))
        frontier = written(total.where(F.col("activation") > epsilon), "activation")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: columns u, v (both non-null, comparable). Returns node, root: every node of an edge with the
    smallest node it reaches. Each round keeps for every node only its links to the smallest neighbour, so a
    hub's links are never gathered in one task; each round's links are a table in the shared folder.
    """
    links = written(edges.where("u <> v").selectExpr("greatest(u, v) AS v", "least(u, v) AS u").distinct(), label)
    before = None
    while True:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").selectExpr("v", "m AS u").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(low, "v")
            .selectExpr("IF(u = m, v, u) AS v", "m AS u")
            .unionByName(low.selectExpr("v", "m AS u"))
            .where("u <> v")
            .distinct()
        )
        links = written(small, label)
        state = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == before:
            return links.selectExpr("v AS node", "u AS root").unionByName(links.selectExpr("u AS node", "u AS root").distinct()).distinct()
        before = state


def falling_least(pairs: DataFrame, label: str = "falling") -> DataFrame:
    """node, root: for each high of the pairs (low, high; low < high) the least node to which steps from a high to a low lead.

    Each round every node takes the least of what its lows have, and then of what that node has: ways double in length,
    and no group larger than a node's own pairs is formed. Rounds end when nothing changes. Pairs may repeat.
    """
    pairs = written(pairs.select("low", "high"), label)
    state = written(pairs.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("root")), label)
    while True:
        known = state.select(F.col("node").alias("at"), F.col("root").alias("to"))
        step = pairs.join(known, F.col("low") == F.col("at"), "left").groupBy(F.col("high").alias("node")).agg(F.min(F.coalesce("to", "low")).alias("least"))
        far = step.join(known, F.col("least") == F.col("at"), "left").select("node", F.coalesce("to", "least").alias("root"))
        state, moved = counted(state.withColumnRenamed("root", "before").join(far, "node").select("node", "root", (F.col("root") != F.col("before")).alias("moved")), label, F.count_if("moved"))
        if not moved:
            return state.select("node", "root")


def first_heads(pairs: DataFrame, label: str = "heads") -> DataFrame:
    """id, head for all nodes of the pairs (low, high; low < high): in order, a node joins the least head among its lows, or is one.

    A node is decided once all its lows are, or one of them is a head: in each round all such nodes are, side by side.
    """
    pairs = written(pairs.select("low", "high").distinct(), label)
    nodes = pairs.select(F.col("low").alias("id")).union(pairs.select("high")).distinct()
    state, open_ = counted(nodes.join(pairs.select(F.col("high").alias("id")).distinct().withColumn("under", F.lit(True)), "id", "left").select("id", F.when(F.col("under").isNull(), True).alias("is_head")), label, F.count_if(F.col("is_head").isNull()))
    while open_:
        lows = pairs.join(state.select(F.col("id").alias("low"), "is_head"), "low").groupBy(F.col("high").alias("id")).agg(F.bool_or(F.coalesce("is_head", F.lit(False))).alias("joins"), F.bool_or(F.col("is_head").isNull()).alias("waits"))
        fate = F.when(F.col("is_head").isNotNull(), F.col("is_head")).when(F.col("joins"), False).when(~F.col("waits"), True)
        state, open_ = counted(state.join(lows, "id", "left").select("id", fate.alias("is_head")), label, F.count_if(F.col("is_head").isNull()))
    heads = pairs.join(state.where("is_head").select(F.col("id").alias("low")), "low", "left_semi").groupBy(F.col("high").alias("id")).agg(F.min("low").alias("least"))
    return state.join(heads, "id", "left").select("id", F.when(F.col("is_head"), F.col("id")).otherwise(F.col("least")).alias("head"))


def shuffled(rows: DataFrame) -> DataFrame:
    """rows as a side of a join that is shuffled, however few they are: what a loop broadcasts goes through the driver in every round anew."""
    return rows.hint("merge")


def communities(edges: DataFrame, rounds: int = 20, least: int = 2) -> DataFrame:
    """path, community: label propagation, nodes in order, each taking its neighbours' commonest label (ties: the smallest).

    In a round a node sees the labels that smaller neighbours have taken in it and that larger ones had before. As no
    node waits for a larger one, the round is the one fixed point of that rule: all nodes begin with the labels from
    before, and those are judged again, all at once, for which a smaller neighbour has just changed, until none has.
    A step joins the links of such nodes with the labels and counts them by node and label, so no group is larger than
    a node's links, however large the component, and nothing of it is broadcast. The result equals that of the nodes one after the other.
    """
    links = written(both_ways(edges.select("from_path", "to_path").where("from_path <> to_path")).distinct(), "community-links")
    state = written(links.select(F.col("near").alias("path")).distinct().select("path", F.col("path").alias("old"), F.col("path").alias("new"), F.lit(True).alias("moved")), "community-labels")
    due = None
    for _ in range(rounds):
        while True:
            own = links if due is None else links.join(shuffled(due), "near", "left_semi")
            seen = own.join(shuffled(state.select(F.col("path").alias("far"), "old", "new")), "far").select("near", F.when(F.col("far") < F.col("near"), F.col("new")).otherwise(F.col("old")).alias("label"))
            best = seen.groupBy("near", "label").agg(F.count("*").alias("n")).groupBy(F.col("near").alias("path")).agg(F.min(F.struct(-F.col("n"), "label")).alias("b")).select("path", F.col("b.label").alias("best"))
            judged = state.select("path", "old", "new").join(shuffled(best), "path", "left")
            fresh = F.coalesce("best", "new")
            # Counted: labels that this step has changed, and in the higher bits those that the round has.
            state, n = counted(judged.select("path", "old", fresh.alias("new"), (fresh != F.col("new")).alias("moved")), "community-labels", F.count_if("moved") + F.shiftleft(F.count_if(F.col("new") != F.col("old")), 32))
            if not n & 0xFFFFFFFF:
                break
            due = links.join(shuffled(state.where("moved").select(F.col("path").alias("far"))), "far", "left_semi").where("far < near").select("near").distinct()
        if not n:
            break
        changed = state.where("new <> old")
        # The next round's first step: those with a larger neighbour that this round has changed.
        due = links.join(shuffled(changed.select(F.col("path").alias("far"))), "far", "left_semi").where("far > near").select("near").distinct()
        state = written(state.select("path", F.col("new").alias("old"), "new", F.lit(False).alias("moved")), "community-labels")
    named = state.groupBy("new").agg(F.min("path").alias("community"), F.count("*").alias("n")).where(F.col("n") >= max(2, least))
    return state.select("path", "new").join(shuffled(named), "new").select("path", "community")


def subgraph(edges: DataFrame, centres: DataFrame, within: DataFrame, hops: int = 2) -> DataFrame:
    """centre, nodes, density: the nodes within ``hops`` steps of each centre (path), as far as they are in ``within`` (path), and the edges between them over those that there could be; centres without another node left out."""
    links = both_ways(edges.select("from_path", "to_path")).select("near", "far").distinct()
    reached = frontier = centres.select(F.col("path").alias("centre"), "path").distinct()
    for _ in range(hops):
        step = frontier.join(links, frontier["path"] == links["near"]).select("centre", F.col("far").alias("path")).distinct()
        frontier = step.join(reached, ["centre", "path"], "left_anti")
        reached = reached.unionByName(frontier)
    nodes = written(reached.join(within.select("path").distinct(), "path", "left_semi"), "subgraph")
    ends = edges.select("from_path", "to_path").join(nodes.select("centre", F.col("path").alias("from_path")), "from_path").join(nodes.select("centre", F.col("path").alias("to_path")), ["centre", "to_path"])
    sized = nodes.groupBy("centre").agg(F.count("*").alias("nodes")).where("nodes > 1")
    counted = sized.join(ends.groupBy("centre").agg(F.count("*").alias("edges")), "centre", "left")
    return counted.select("centre", "nodes", (F.coalesce("edges", F.lit(0)) / (F.col("nodes") * (F.col("nodes") - 1))).alias("density"))


def entropy(edges: DataFrame, most_types: int = 9) -> DataFrame:
    """bits: Shannon entropy of the reasoning edges' types; beyond most_types the rarest count as one. One row, 0 without edges."""
    counts = edges.where(F.col("relation_type").isin(params.REASONING_EDGES)).groupBy("relation_type").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "relation_type"))
    every = F.count("*").over(Window.partitionBy())
    capped = counts.select("n", F.when((every > most_types) & (rank > most_types - 1), "other").otherwise(F.col("relation_type")).alias("t")).groupBy("t").agg(F.sum("n").alias("n"))
    share = capped.select((F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"))
    return share.agg(F.round(F.coalesce(-F.sum(F.col("p") * F.log2("p")), F.lit(0.0)), 6).alias("bits"))
