"""Operator 7: shards of even row count by balanced label propagation.

Every linked document starts in a shard given by a hash.  In each round a join
brings every document its neighbours' shards; in turns, documents below all their neighbours (no two of them
are linked, so they cannot swap) and most of the others ask for the shard that
most neighbours are in, and each shard admits askers up to its free quota.
Unlinked documents then fill the quotas exactly, so the counts of any two shards
differ by one row at most (law ``rows``).

All ranks are taken in two levels -- a count per bucket, a bounded table of
offsets, a row number inside the bucket -- so no task holds a whole shard.

Defined results: rows are nodes, so repeated rows and null or repeated ids are
placed one by one; null text has size 8, crc 0 and no links; empty texts are one
group; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import discard, saved

#: Buckets of a two-level rank; the offset table has this many rows a shard.
BUCKETS = 256
#: Links of a copy at each level of its group's tree.
FAN = 1024


def _bucket(key: Column, node: Column) -> Column:
    """Rows of one key share a sixteenth of the buckets: they stay close, and a
    hot key still spreads over sixteen tasks."""
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS // 16)) * 16 + F.pmod(F.xxhash64(node, F.lit(3)), F.lit(16))


def ranked(df: DataFrame, group: str, bucket: Column, order: list[Column], out: str) -> DataFrame:
    """Number the rows of each group from 0, without gaps.  ``group`` must have
    few values (shards)."""
    df = df.withColumn("_bucket", bucket)
    count = df.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = count.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy(group, "_bucket").orderBy(*order)
    df = df.withColumn("_inner", F.row_number().over(inner) - 1)
    # shards x BUCKETS rows at most
    return df.join(F.broadcast(offset), [group, "_bucket"]).withColumn(out, F.col("_offset") + F.col("_inner")).drop("_bucket", "_inner", "_offset")


def copy_links(nodes: DataFrame, rows: int, fan: int = FAN) -> DataFrame:
    """(a, b) links of nodes (node, key): equal keys form a tree whose root is their least node.

    Level by level, a key's nodes are dealt out by a hash and linked with the least of
    their part; only those go on to the next level, which has a ``fan``-th of the parts and
    one at last.  So a node has about ``fan`` neighbours a level however many of the ``rows`` share
    its key, a small group is one star, and no task holds a whole group.
    """
    part, levels, links = 1, [], None
    while part * fan < rows:
        part *= fan
    level = nodes.where(F.col("key").isNotNull()).select("node", "key")
    while part:
        hub = F.min("node").over(Window.partitionBy("key", F.pmod(F.xxhash64("node"), F.lit(part))))
        levels.append(saved(level.withColumn("hub", hub), "level"))
        found = levels[-1].where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
        links = found if links is None else links.unionByName(found)
        level, part = levels[-1].where("node = hub").select("node", "key"), part // fan
    links = saved(links, "links")
    discard(*levels)
    return links


def quotas(n: int, shards: int, load: dict[int, int]) -> dict[int, int]:
    """Rows of each shard: n div shards, and one more for the fullest ones."""
    extra = sorted(range(shards), key=lambda s: (-load.get(s, 0), s))[: n % shards]
    return {s: n // shards + (s in extra) for s in range(shards)}


def _loads(placed: DataFrame) -> dict[int, int]:
    """Rows by shard; as many rows as there are shards."""
    return {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}


def _map(values: dict[int, int]) -> Column:
    return F.create_map(*(F.lit(int(x)) for item in values.items() for x in item))


def propagate(linked: DataFrame, links: DataFrame, n: int, shards: int, rounds: int) -> DataFrame:
    """linked (node, shard, hub) with shards moved towards neighbours' shards; of shards with
    equal votes the one with the least neighbour is asked."""
    both = saved(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    for turn in range(rounds):
        load = _loads(linked)
        free = {s: max(0, n // shards - load.get(s, 0)) for s in range(shards)}
        seen = both.join(linked.select(F.col("node").alias("b"), F.col("shard").alias("at")), "b").groupBy("a", "at").agg(F.count(F.lit(1)).alias("votes"), (-F.min("b")).alias("first"))
        best = seen.groupBy(F.col("a").alias("node")).agg(F.max(F.struct("votes", "first", "at")).alias("best"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        own = seen.select(F.col("a").alias("node"), F.col("at").alias("shard"), F.col("votes").alias("own"))
        state = linked.join(best, "node", "left").join(own, ["node", "shard"], "left").join(least, "node", "left")
        centre = F.col("node") < F.col("least")
        turned = centre if turn % 2 else ~centre & (F.lit(turn == 0) | (F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(4)) != 0))
        asks = turned & (F.col("best.at") != F.col("shard")) & (F.col("best.votes") > F.coalesce("own", F.lit(0)))
        state = saved(state.select("node", "shard", "hub", F.when(asks, F.col("best.at")).alias("to"), F.when(asks, F.col("best.votes") - F.coalesce("own", F.lit(0))).alias("gain")), "asks")
        movers = ranked(state.where("to is not null"), "to", _bucket(F.col("hub"), F.col("node")), [F.desc("gain"), F.col("node")], "rank")
        movers = movers.where(F.col("rank") < F.element_at(_map(free), F.col("to"))).select("node", F.col("to").alias("new"))
        linked = saved(state.join(movers, "node", "left").select("node", F.coalesce("new", "shard").alias("shard"), "hub"), "labels")
    return linked


def balanced_shards(nodes: DataFrame, links: DataFrame, shards: int = 24, rounds: int = 7) -> DataFrame:
    """node, shard, slot for nodes (node) and links (a, b).

    Row counts of shards are at most one apart; slots are gapless from 0.
    """
    nodes = nodes.select("node")
    n = nodes.count()
    hub = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("hub"))
    hubs = links.select(F.col("b").alias("node"), F.col("b").alias("hub"))
    linked = hub.unionByName(hubs).groupBy("node").agg(F.min("hub").alias("hub"))
    linked = saved(linked.select("node", F.pmod(F.xxhash64("node", F.lit(5)), F.lit(shards)).cast("int").alias("shard"), "hub"), "labels")
    linked = propagate(linked, links, n, shards, rounds)
    quota = quotas(n, shards, _loads(linked))
    placed = ranked(linked, "shard", _bucket(F.col("hub"), F.col("node")), [F.col("hub"), F.col("node")], "rank")
    placed = saved(placed.withColumn("stays", F.col("rank") < F.element_at(_map(quota), F.col("shard"))), "placed")
    stays = placed.where("stays").select("node", "shard")
    # Those over quota come first in the pool, hub by hub, and then all unlinked rows.
    pool = nodes.join(stays.select("node"), "node", "left_anti").join(placed.where("not stays").select("node", "hub"), "node", "left")
    pool = pool.withColumn("all", F.lit(0)).withColumn("hub", F.coalesce("hub", "node"))
    pool = ranked(pool, "all", F.pmod(F.xxhash64("hub"), F.lit(BUCKETS * 4)), [F.col("hub"), F.col("node")], "rank")
    load, bounds, total = _loads(stays), [], 0
    for s in range(shards):
        total += quota[s] - load.get(s, 0)
        bounds.append(total)
    to = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("rank"))).cast("int")
    whole = saved(stays.unionByName(pool.select("node", to.alias("shard"))), "shards")
    return ranked(whole, "shard", F.pmod(F.xxhash64("node", F.lit(9)), F.lit(BUCKETS)), [F.col("node")], "slot")


def shard_documents(docs: DataFrame, shards: int = 24, rounds: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: documents with
    equal texts are linked and drawn together."""
    text = F.encode("text", "UTF-8")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).alias("text_crc32"), F.unhex(F.md5(text)).alias("key"))
    rows = saved(rows.withColumn("node", F.monotonically_increasing_id()), "rows")
    placed = balanced_shards(rows, copy_links(rows, rows.count()), shards, rounds)
    return rows.join(placed, "node").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
