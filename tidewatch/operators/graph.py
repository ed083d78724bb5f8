"""Who is linked to whom: components, two-hop networks, shared-entity campaigns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.asof import latest
from tidewatch.session import cut

MAX_NODES = 50
LARGEST_SHARE = 0.10


def entity_edges(payments: DataFrame, keys: list[str]) -> DataFrame:
    """(key, account, other): each account tied to the smallest account of every entity it used.

    Replacing the entity by its smallest account keeps the components and halves the graph. An
    entity is never expanded into pairs, so a busy one costs one edge per account.
    """
    links = F.explode(
        F.array(
            *[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("entity")) for k in keys]
        )
    ).alias("l")
    used = (
        payments.select("account", links)
        .select(F.col("account"), "l.key", "l.entity")
        .filter(F.col("entity").isNotNull())
        .distinct()
    )
    smallest = used.groupBy("key", "entity").agg(F.min("account").alias("other"))
    return used.join(smallest, ["key", "entity"]).select("key", "account", "other").distinct()


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, account, component): the smallest account reachable, per key.

    Alternates two steps until nothing moves: every node hangs its larger neighbours, then all its
    neighbours, under the smallest one. Both are an aggregate and an equi-join. Each round is
    checkpointed, so the plan stays flat and a lost executor repeats one round at most.
    """
    current = cut(edges.filter("account <> other").select("key", F.col("account").alias("u"), F.col("other").alias("v")))
    previous = None
    while True:
        both = current.unionByName(current.select("key", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("key", "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, ["key", "u"]).select("key", F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        down = large.select("key", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("key", "u").agg(F.min("v").alias("m"))
        joined = down.join(least, ["key", "u"])
        small = joined.select("key", F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("key", "u", F.col("m").alias("v"))
        )
        current = cut(small.filter("u <> v").distinct())
        state = current.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("key", "u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if state == previous:
            break
        previous = state
    return nodes.join(
        current.select("key", F.col("u").alias("account"), F.col("v").alias("component")),
        ["key", "account"],
        "left",
    ).select("key", "account", F.coalesce("component", "account").alias("component"))


def component_sizes(membership: DataFrame) -> DataFrame:
    """Per key: number and largest share of components, upper-median and 99th-percentile size."""
    sizes = membership.groupBy("key", "component").agg(F.count("*").alias("size"))
    totals = sizes.groupBy("key").agg(
        F.count("*").alias("components"), F.sum("size").alias("accounts"), F.max("size").alias("largest")
    )
    # Sizes in descending order, at position n div 2 and floor(n / 100).
    down = sizes.groupBy("key", "size").agg(F.count("*").alias("c"))
    w = Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    placed = down.select("*", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("above")).join(totals, "key")

    def at(position: Column) -> Column:
        hit = (F.col("above") <= position) & (position < F.col("above") + F.col("c"))
        return F.max(F.when(hit, F.col("size")))

    share = F.col("largest") / F.col("accounts")
    return placed.groupBy("key", "components", "accounts", "largest").agg(
        at(F.expr("components div 2")).alias("median_size"),
        at(F.floor(F.col("components") * F.lit(0.01))).alias("p99_size"),
    ).withColumn("largest_share", share).withColumn("foldable", share <= LARGEST_SHARE)


def adjacency(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, other, n): payments between a chosen node and another account, in either direction.

    Only payments that touch a chosen node are shuffled and counted.
    """
    chosen = nodes.select("node").distinct()
    there = links.select(F.col("source").alias("node"), F.col("target").alias("other")).join(chosen, "node", "left_semi")
    back = links.select(F.col("target").alias("node"), F.col("source").alias("other")).join(chosen, "node", "left_semi")
    return there.unionByName(back).filter("node <> other").groupBy("node", "other").agg(F.count("*").alias("n"))


def networks(links: DataFrame, roots: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """(root, node, degree): each root, its closest counterparties, then theirs, while room remains.

    First degree ranks by payments with the root, second by the most payments with any one
    first-degree node; ties by token. The rank limit is pushed below the shuffle by Spark.
    """
    start = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("degree"))
    first = adjacency(links, start).join(start.select("root", "node"), "node").select("root", F.col("other").alias("node"), "n")
    by_links = Window.partitionBy("root").orderBy(F.desc("n"), "node")
    first = (
        first.withColumn("r", F.row_number().over(by_links))
        .filter(F.col("r") <= max_nodes - 1)
        .select("root", "node", F.lit(1).alias("degree"))
    )
    chosen = start.unionByName(first)
    used = first.groupBy("root").agg(F.count("*").alias("used"))
    second = (
        adjacency(links, first).join(first.select("root", "node"), "node")
        .groupBy("root", F.col("other").alias("node"))
        .agg(F.max("n").alias("n"))
        .join(chosen.select("root", "node"), ["root", "node"], "left_anti")
        .withColumn("r", F.row_number().over(by_links))
        .filter(F.col("r") <= max_nodes - 1)
        .join(used, "root")
        .filter(F.col("r") <= F.lit(max_nodes - 1) - F.col("used"))
        .select("root", "node", F.lit(2).alias("degree"))
    )
    return chosen.unionByName(second)


def network_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(root, source, target, n): payments between two chosen nodes, both ends by semi-join shape."""
    ends = [nodes.select(F.col("node").alias(end)).distinct() for end in ("source", "target")]
    near = links.join(ends[0], "source", "left_semi").join(ends[1], "target", "left_semi")
    pairs = near.groupBy("source", "target").agg(F.count("*").alias("n"))
    members = nodes.select("root", "node")
    return (
        pairs.join(members.withColumnRenamed("node", "source"), "source")
        .join(nodes.select("root", F.col("node").alias("target")), ["root", "target"])
        .select("root", "source", "target", "n")
    )


def confirmed_accounts(labels: DataFrame) -> DataFrame:
    """Accounts that sent a payment whose current label is fraud."""
    current = latest(labels, ["tx_id", "account"], ["label_at", "label_id"], ["label"])
    return current.filter("label = 'FRAUD'").select("account").distinct()


def touching(links: DataFrame, nodes: DataFrame, both: bool) -> DataFrame:
    """Payments with a chosen node at either end, or at both."""
    by_source = links.join(nodes.select(F.col("node").alias("source")), "source", "left_semi")
    target = nodes.select(F.col("node").alias("target"))
    if both:
        return by_source.join(target, "target", "left_semi").select(*links.columns)
    by_target = links.join(target, "target", "left_semi")
    return by_source.select(*links.columns).unionByName(by_target.select(*links.columns)).distinct()


def campaigns(payments: DataFrame, keys: list[str], days: int = 7, minimum: int = 5) -> DataFrame:
    """Fraud rows sharing one entity within a period: one pass for all kinds of entity."""
    period = F.expr(f"t div {days * 86_400_000_000}").alias("period")
    shared = F.explode(
        F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("entity")) for k in keys])
    ).alias("s")
    return (
        payments.filter("is_fraud")
        .select(period, "amount", "account", shared)
        .select("period", "amount", "account", "s.*")
        .filter(F.col("entity").isNotNull())
        .groupBy("kind", "entity", "period")
        .agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
        .filter(F.col("n") >= minimum)
    )
