"""Transfer graph: edges, cycles, neighbourhoods and degrees as joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.functions.numbers import count_rows
from riskflow.operators.ordered import global_index
from riskflow.session import materialize, sized

SUSPICIOUS_AMOUNT = 5000
MAX_CYCLE = 5


def build_edges(tx: DataFrame) -> DataFrame:
    return tx.select(F.col("from_account").alias("src"), F.col("to_account").alias("dst"), F.col("amount_paid").alias("amount"), "ts",
                     (F.col("amount_paid") > SUSPICIOUS_AMOUNT).alias("suspicious"))


def build_nodes(tx: DataFrame) -> DataFrame:
    """One row per account; an account seen as a sender is an ACCOUNT, others are BENEFICIARY."""
    sides = F.array(F.struct(F.col("from_account").alias("id"), F.lit(0).alias("side")), F.struct(F.col("to_account").alias("id"), F.lit(1).alias("side")))
    return tx.select(F.explode(sides).alias("s")).groupBy("s.id").agg(F.min("s.side").alias("side")).select(
        "id", F.when(F.col("side") == 0, "ACCOUNT").otherwise("BENEFICIARY").alias("node_type"))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Parallel transfers count once; self-loops are no cycle."""
    return edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct()


def prune_to_core(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Drop edges that cannot lie on a cycle: their tail is never paid or their head never pays."""
    for _ in range(rounds):
        paid = edges.select(F.col("dst").alias("src")).distinct()
        paying = edges.select(F.col("src").alias("dst")).distinct()
        edges = edges.join(paid, "src", "left_semi").join(paying, "dst", "left_semi").select("src", "dst")
    return edges


def find_cycles(edges: DataFrame, max_nodes: int = MAX_CYCLE) -> DataFrame:
    """Directed simple cycles of 2 to ``max_nodes`` nodes, each once, written from its smallest node.

    A cycle is cut into a forward half from the smallest node and a backward half to it; the halves meet on (start,
    middle). Paths therefore grow to half the cycle length only, and nodes below the start are never entered. Halves meet by the
    nodes' positions in the order of names. A forward half brings the names between its ends; start, middle and the way back come with the
    backward halves, which are fewer, and halves that are used once are not written.
    """
    core = materialize(prune_to_core(materialize(distinct_edges(edges))))
    names = core.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    numbered = sized(global_index(names, ["name"], "n"))
    ends = {side: numbered.select(F.col("name").alias(side), F.col("n").alias(at)) for side, at in (("src", "a"), ("dst", "b"))}
    step = materialize(core.join(ends["src"], "src").join(ends["dst"], "dst").select("a", "b", "src", "dst"))
    start, mid = F.col("start"), F.col("mid")

    def apart(name: str, others: list[str]) -> Column:
        return reduce(lambda all_apart, o: all_apart & (F.col(name) != F.col(o)), others, F.lit(True))
    # ahead: names p1, p2 .. of the nodes between start and middle; behind: names of start and middle, and q1, q2 .. after the middle
    ahead = {1: step.where(F.col("b") > F.col("a")).select(F.col("a").alias("start"), F.col("b").alias("mid"))}
    behind = {1: step.where(F.col("a") > F.col("b")).select(F.col("b").alias("start"), F.col("a").alias("mid"), F.col("dst").alias("s"), F.col("src").alias("m"))}
    for k in range(2, (max_nodes + 1) // 2 + 1):
        passed = [f"p{i}" for i in range(1, k - 1)]
        grown = ahead[k - 1].join(step, mid == F.col("a")).where((F.col("b") > start) & apart("dst", passed)).select(
            "start", F.col("b").alias("mid"), *passed, F.col("src").alias(f"p{k - 1}"))
        ahead[k] = materialize(grown) if 2 * k <= max_nodes else grown
    for k in range(2, max_nodes // 2 + 1):
        passed = [f"q{i}" for i in range(1, k - 1)]
        grown = behind[k - 1].join(step, mid == F.col("b")).where((F.col("a") > start) & apart("src", passed)).select(
            "start", F.col("a").alias("mid"), "s", F.col("src").alias("m"), F.col("m").alias("q1"), *[F.col(q).alias(f"q{i}") for i, q in enumerate(passed, start=2)])
        behind[k] = materialize(grown)
    cycles = None
    for nodes in range(2, max_nodes + 1):
        far, near = (nodes + 1) // 2, nodes // 2
        out, back = [f"p{i}" for i in range(1, far)], [f"q{i}" for i in range(1, near)]
        met = ahead[far].join(behind[near], ["start", "mid"]).where(reduce(lambda c, p: c & apart(p, back), out, F.lit(True)))
        found = met.select(F.array("s", *out, "m", *back).alias("cycle"))
        cycles = found if cycles is None else cycles.unionByName(found)
    return cycles.select(
        F.size("cycle").alias("length"), "cycle", F.concat_ws(">", "cycle").alias("cycle_path"), F.concat_ws(",", F.array_sort("cycle")).alias("node_set"))


def cycle_members(edges: DataFrame, max_nodes: int = MAX_CYCLE) -> DataFrame:
    """(id): accounts on a directed simple cycle of 2 to ``max_nodes`` accounts; no cycle is listed.

    The shortest closed walk through an account is a simple cycle, so distinct (start, middle) pairs are enough: an account is
    a member if some middle can be reached from it and reaches it in ``max_nodes`` steps together. Lengths are tried in
    order, and accounts found leave the set of starts, so the wider half-walks grow for the rest only.
    """
    # pruning and numbering read the edges many times: the transfers are grouped once, and what is left of them is written
    core = materialize(prune_to_core(materialize(distinct_edges(edges))))
    names = core.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    numbered = sized(names.select("name", F.monotonically_increasing_id().alias("n")))
    ends = {side: numbered.select(F.col("name").alias(side), F.col("n").alias(at)) for side, at in (("src", "a"), ("dst", "b"))}
    step = materialize(core.join(ends["src"], "src").join(ends["dst"], "dst").select("a", "b"))
    left = step.select(F.col("a").alias("start")).distinct()
    ahead = {1: step.select(F.col("a").alias("start"), F.col("b").alias("mid"))}
    behind = {1: step.select(F.col("b").alias("start"), F.col("a").alias("mid"))}
    found = None
    for nodes in range(2, max_nodes + 1):
        far, near = (nodes + 1) // 2, nodes // 2
        for walks, size, here, there in ((ahead, far, "a", "b"), (behind, near, "b", "a")):
            if size not in walks:
                # walks of accounts that are already found are not made longer
                open_walks = walks[size - 1].join(left, "start", "left_semi")
                walks[size] = materialize(open_walks.join(step, F.col("mid") == F.col(here)).select("start", F.col(there).alias("mid")).distinct())
        met = materialize(ahead[far].join(left, "start", "left_semi").join(behind[near], ["start", "mid"], "left_semi").select("start").distinct())
        found = met if found is None else found.unionByName(met)
        left = materialize(left.join(met, "start", "left_anti"))
    return found.join(numbered, F.col("start") == F.col("n")).select(F.col("name").alias("id"))


def node_set_cycles(cycles: DataFrame) -> DataFrame:
    """One row per set of nodes, the grouping that merges cycles running over the same accounts."""
    return cycles.groupBy("node_set", "length").agg(count_rows().alias("directed_cycles"))


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    pairs = edges.select("src", "dst")
    back = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return materialize({"out": pairs, "in": back, "both": pairs.unionByName(back)}[direction].distinct())


def k_hop_of_each(edges: DataFrame, seeds: DataFrame, hops: int = 2, direction: str = "out") -> DataFrame:
    """(root, id, hop): the neighbourhood of every seed by itself. ``seeds`` has one column ``id``; direction is out, in or both."""
    steps = _steps(edges, direction)
    reached = frontier = seeds.select(F.col("id").alias("root"), "id").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        found = frontier.join(steps, F.col("id") == F.col("src")).select("root", F.col("dst").alias("id")).distinct()
        frontier = materialize(found.join(reached, ["root", "id"], "left_anti").withColumn("hop", F.lit(hop)))
        reached = reached.unionByName(frontier)
    return reached


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int = 2, direction: str = "out") -> DataFrame:
    """(id, hop): nodes first reached from any seed after ``hop`` steps."""
    steps = _steps(edges, direction)
    reached = frontier = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        found = frontier.join(steps, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = materialize(found.join(reached, "id", "left_anti").withColumn("hop", F.lit(hop)))
        reached = reached.unionByName(frontier)
    return reached


def neighbourhood_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def ring_risk(tx: DataFrame, members: DataFrame, high_amount: float = 10_000) -> DataFrame:
    """CRITICAL when either side is among ``members`` (id), the accounts on a cycle, else HIGH above the amount, else MEDIUM."""
    members = sized(members)
    sender = members.select(F.col("id").alias("from_account"), F.lit(True).alias("_s"))
    receiver = members.select(F.col("id").alias("to_account"), F.lit(True).alias("_r"))
    ring = F.coalesce("_s", F.lit(False)) | F.coalesce("_r", F.lit(False))
    return tx.join(sender, "from_account", "left").join(receiver, "to_account", "left").withColumn("has_circular_risk", ring).select(
        *tx.columns, "has_circular_risk",
        F.when(F.col("has_circular_risk"), "CRITICAL").when(F.col("amount_paid") > high_amount, "HIGH").otherwise("MEDIUM").alias("cluster_risk_level"))


def smurfing_flags(edges: DataFrame, more_than: int = 5) -> DataFrame:
    """Per account: the original flag (it counts what the account sends) and a fan-in flag (distinct payers)."""
    sent = edges.groupBy(F.col("src").alias("id")).agg(count_rows().alias("out_edges"))
    payers = edges.groupBy(F.col("dst").alias("id"), "src").agg(F.lit(1).alias("one")).groupBy("id").agg(count_rows().alias("distinct_payers"))
    zero = F.lit(0)
    joined = sent.join(payers, "id", "full_outer")
    return joined.select("id", F.coalesce("out_edges", zero).alias("out_edges"), F.coalesce("distinct_payers", zero).alias("distinct_payers")).withColumns({
        "smurfing_detected": F.col("out_edges") > more_than, "fan_in_detected": F.col("distinct_payers") > more_than})


def degree_table(edges: DataFrame) -> DataFrame:
    """Degree, weight and distinct counterparties of both directions. Pairs are summed first, so a busy pair is one row."""
    pairs = edges.groupBy("src", "dst").agg(count_rows().alias("n"), F.sum("amount").alias("w"))
    def side(key: str, name: str) -> DataFrame:
        return pairs.groupBy(F.col(key).alias("id")).agg(
            F.sum("n").alias(f"{name}_degree"), F.sum("w").cast("double").alias(f"{name}_weight"), count_rows().alias(f"{name}_counterparties"))
    both = side("src", "out").join(side("dst", "in"), "id", "full_outer")
    return both.select("id", *[F.coalesce(c, F.lit(0.0 if c.endswith("weight") else 0)).alias(c) for c in both.columns if c != "id"])
