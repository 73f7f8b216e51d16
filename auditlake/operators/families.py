"""Near-duplicate prompt families: prefix-filter candidates, exact Jaccard, components, exclusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from ..shared import saved

#: Nodes with one token in their prefix beyond which its bucket is split.
HOT = 500
#: Nodes of the sample that tells frequent tokens, and how many of these a task holds.
SAMPLE, FREQUENT = 50_000, 1 << 20
#: Places of a signature.
BITS = 256
#: Tokens of a node beyond which its signature says little, and places of the counts it has then.
LONG, PLACES = 640, 1024
#: Characters of the texts in a block of pairs' nodes.
BLOCK = 2 << 20


def candidates(nodes: DataFrame, num: int = 17, den: int = 20, hot: int = HOT, signed: bool = False) -> DataFrame:
    """(a, b), a < b: every pair that may be similar, by its first shared token.

    nodes: (node, tokens) with distinct tokens, of which only hashes leave a row. Tokens are in one order
    for all nodes, see _placed(). The first token that a similar pair shares lies in the prefix of both, and the
    second one at most a place beyond. Where more than ``hot`` nodes have a token in their prefix, its bucket is
    split by every further token up to that place; only tokens that _frequent() names are counted for that, so
    the many rare ones are shuffled once. Of a bucket only sizes and places that allow the threshold
    meet; with ``signed``, only nodes whose signatures and counts allow it too, which spares nearly all pairs of a bucket.
    """
    placed = saved(_placed(nodes.select("node", F.transform("tokens", lambda t: F.xxhash64(t)).alias("h")), num, den))
    about = ["node", "n", "signature"] if signed else ["node", "n"]
    own = placed.select(*about, "need", "prefix", F.posexplode(F.slice("prefix", F.lit(1), F.col("lead"))).alias("k", "t")).withColumn("k", F.col("k") + 1)
    often = placed.where("lead > rare").select(F.explode(F.slice("prefix", F.col("rare") + 1, F.col("lead") - F.col("rare"))).alias("t"))
    crowded = saved(often.groupBy("t").agg(F.count("*").alias("m")).where(F.col("m") > hot).select("t"))
    cold = own.join(crowded, "t", "left_anti").select("t", *about, "k")
    split = own.join(crowded, "t")
    behind = F.slice("prefix", F.col("k") + 1, F.size("prefix"))
    twos = split.select("t", F.explode(behind).alias("t2"), *about, "k").select(F.xxhash64("t", "t2").alias("t"), *about, "k")
    ones = split.where("need < 2").select("t", *about, "k")  # one token decides
    met = _meet(cold.unionByName(ones), num, den).unionByName(_meet(twos, num, den)).distinct()
    return _counted(saved(met), placed, num, den) if signed else met.select("a", "b")


def _placed(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """node, n, need, lead, rare, signature, counts and prefix, the first lead + 1 of a node's hashes h, of which rare are not frequent.

    Any order of tokens gives all pairs; rare tokens first give few. Tokens that are frequent in a sample of nodes
    come last, by their number there, and all others by hash, so a row finds its prefix alone and nothing is sorted
    over all nodes. The signature has the parity of the hashes at each of BITS places: two of them differ in at
    most as many places as the sets in tokens. Counts, of long nodes only, are hashes at each of PLACES, 255 at most.
    """
    often, times = _frequent(nodes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("h")
            h = lists.flatten().to_numpy(zero_copy_only=False)
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            count = np.zeros(len(h), np.int64)
            if len(often):
                at = np.minimum(np.searchsorted(often, h), len(often) - 1)
                count = np.where(often[at] == h, times[at], 0)
            order = np.lexsort((h, count, row))
            need = -(-n * num // den)
            lead = n - need + 1
            rare = np.minimum(np.bincount(row[count == 0], minlength=len(n)), lead + 1)
            head = order[np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(lead + 1, n)]
            starts = np.concatenate([[0], np.cumsum(np.minimum(n, lead + 1))]).astype(np.int32)
            parity = np.bincount(row * BITS + (h & (BITS - 1)), minlength=len(n) * BITS).astype(np.uint8) & 1
            words = np.packbits(parity).view(np.int64)
            signature = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (BITS // 64)), pa.array(words))
            prefix = pa.ListArray.from_arrays(pa.array(starts), pa.array(h[head]))
            far = np.flatnonzero(n * (num + den) >= 2 * LONG * num)  # a pair with 2 * LONG tokens has none smaller
            slot = np.searchsorted(far, row)
            counted = np.isin(row, far)
            table = np.bincount(slot[counted] * PLACES + (h[counted] >> 8 & (PLACES - 1)), minlength=len(far) * PLACES).clip(max=255).astype(np.uint8)
            counts = np.full(len(n), None, object)
            counts[far] = [c.tobytes() for c in table.reshape(-1, PLACES)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(n), pa.array(need), pa.array(lead), pa.array(rare), signature, pa.array(counts, pa.binary()), prefix], ["node", "n", "need", "lead", "rare", "signature", "counts", "prefix"])

    kind = dict(nodes.dtypes)["node"]
    return nodes.where(F.size("h") > 0).mapInArrow(place, f"node {kind}, n long, need long, lead long, rare long, signature array<long>, counts binary, prefix array<long>")


def _frequent(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of tokens in several nodes of a sample, sorted, and their numbers of nodes; at most FREQUENT, the most frequent ones.

    The sample is of about SAMPLE nodes, all if there are no more. It sets the order of tokens, which
    results do not depend on.
    """
    every = max(1, -(-nodes.count() // SAMPLE))
    drawn = nodes.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0)
    found = saved(drawn.select(F.explode("h").alias("t")).groupBy("t").agg(F.count("*").alias("m")).where("m > 1"))
    kept, least = 0, 0
    for r in found.groupBy(F.least("m", F.lit(1000)).alias("m")).agg(F.count("*").alias("k")).orderBy(F.desc("m")).collect():
        kept += r["k"]
        if kept > FREQUENT:
            break
        least = r["m"]
    rows = found.where(F.col("m") >= least).toPandas() if least else found.limit(0).toPandas()
    rows = rows.sort_values("t")
    return rows["t"].to_numpy(np.int64), rows["m"].to_numpy(np.int64)


def _meet(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, both sizes) of rows (t, node, n, k) with one t whose sizes and places k of t, and signatures if there are any, allow the threshold."""
    x, y = (rows.select([F.col(c).alias(c if c == "t" else f"{c}_{s}") for c in rows.columns]) for s in "xy")
    both = F.col("n_x") + F.col("n_y")
    rest = F.least(F.col("n_x") - F.col("k_x"), F.col("n_y") - F.col("k_y"))
    may = (F.least("n_x", "n_y") * den >= F.greatest("n_x", "n_y") * num) & ((rest + 1) * (num + den) >= both * num)
    if "signature" in rows.columns:
        differ = sum(F.bit_count(F.col("signature_x")[i].bitwiseXOR(F.col("signature_y")[i])) for i in range(BITS // 64))
        may = may & (differ * (num + den) <= both * (den - num))
    # exploded prefixes are many times larger than Spark's estimate, by which it would send them all through the driver
    met = x.hint("merge").join(y, (x["t"] == y["t"]) & (F.col("node_x") < F.col("node_y")) & may)
    return met.select(F.col("node_x").alias("a"), F.col("node_y").alias("b"), both.alias("both"))


def _counted(pairs: DataFrame, placed: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of pairs (a, b, both) but those of long nodes whose counts differ by more than the threshold allows.

    The parities of two long sets differ at half of all places at most, so unlike sets pass by them; the
    sum of differences of counts goes on growing with the sets, and is never more than tokens differ.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PLACES).astype(np.int16) for c in ("counts_a", "counts_b"))
                differ = np.abs(x - y).sum(1, dtype=np.int64)
                keep = differ * (num + den) <= batch.column("both").to_numpy() * (den - num)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    far = pairs.where(F.col("both") >= 2 * LONG)
    for s in "ab":
        far = far.join(placed.select(F.col("node").alias(s), F.col("counts").alias(f"counts_{s}")), s)
    kind = dict(pairs.dtypes)["a"]
    return pairs.where(F.col("both") < 2 * LONG).select("a", "b").unionByName(far.mapInArrow(near, f"a {kind}, b {kind}"))


def similar(nodes: DataFrame, pairs: DataFrame, num: int = 17, den: int = 20, column: str = "tokens", tokens: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Pairs whose Jaccard similarity is at least num / den, in integers; tokens of a node are distinct.

    A node's tokens are made from its column where its pairs are, so texts are shuffled, not their shingles,
    of the texts only those of nodes in a pair, and each once for a tile of pairs and side, see _tiles().
    """
    pairs = saved(pairs)
    weight = F.length(column) if dict(nodes.dtypes)[column] == "string" else 8 * F.size(column)
    tiles, met = _tiles(nodes.select("node", weight.cast("long").alias("w")), pairs)
    nodes = nodes.join(met, "node", "left_semi")
    left = tiles.groupBy(F.col("tile").alias("tile_a"), F.col("a").alias("node")).agg(F.collect_list("b").alias("others"))
    right = tiles.select(F.col("tile").alias("tile_b"), F.col("b").alias("node")).distinct()

    def side(rows: DataFrame, tile: str) -> GroupedData:
        texts = rows.join(nodes.select("node", F.col(column).alias("x")), "node").repartition(tile).sortWithinPartitions(tile)
        return texts.withColumn("t", tokens(F.col("x"))).drop("x").groupBy(tile)

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        lists = pa.chunked_array([*x["t"].chunks, *y["t"].chunks]).combine_chunks()
        n = lists.value_lengths().to_numpy(zero_copy_only=False)
        ends = np.cumsum(n)
        codes = lists.flatten().dictionary_encode()
        own, codes = np.zeros(len(codes.dictionary), bool), codes.indices.to_numpy()
        place = {node: len(x) + i for i, node in enumerate(y["node"].to_pylist())}
        found: list[tuple] = []
        for r, (a, others) in enumerate(zip(x["node"].to_pylist(), x["others"].to_pylist())):
            mine = codes[ends[r] - n[r] : ends[r]]
            own[mine] = True
            for b in others:
                o = place[b]
                i = int(np.count_nonzero(own[codes[ends[o] - n[o] : ends[o]]]))
                if i * den >= num * (int(n[r]) + int(n[o]) - i):
                    found.append((a, b))
            own[mine] = False
        kind = x.schema.field("node").type
        return pa.table({s: pa.array([p[k] for p in found], kind) for k, s in enumerate("ab")})

    kind = dict(pairs.dtypes)["a"]
    return side(left, "tile_a").cogroup(side(right, "tile_b")).applyInArrow(compare, f"a {kind}, b {kind}")


def _tiles(weights: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Saved (tile, a, b) of every pair, such that few tiles hold a node of many pairs, and (node, block) of their nodes.

    weights: (node, w). Nodes with the same least neighbour are a group, as near copies of one text are; a group is
    dealt to blocks of about BLOCK by hash. Pairs between the same two blocks go to one tile, and tiles with little in them
    share a number. A group of g nodes so sends g texts a block, not a text for each of its g * g / 2 pairs.
    """
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    grouped = ends.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("g"))
    grouped = saved(weights.join(grouped, "node").withColumn("w", F.col("w") + 1024))
    parts = grouped.groupBy("g").agg(F.ceil(F.sum("w") / BLOCK).alias("parts"))
    met = saved(grouped.join(parts, "g").select("node", "w", F.xxhash64("g", F.pmod(F.xxhash64("node"), "parts")).alias("block")))
    at = lambda s: met.select(F.col("node").alias(s), F.col("block").alias(f"block_{s}"), F.col("w").alias(f"w_{s}"))
    tiled = saved(pairs.join(at("a"), "a").join(at("b"), "b").select(F.xxhash64("block_a", "block_b").alias("tile"), "a", "b", "w_a", "w_b"))
    sent = [tiled.select("tile", s, F.col(f"w_{s}").alias("w")).distinct().agg(F.sum("w")).first()[0] or 0 for s in "ab"]
    return tiled.select(F.pmod("tile", F.lit(-(-sum(sent) // BLOCK) or 1)).alias("tile"), "a", "b"), met.select("node", "block")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable; a node without edges is its own component."""
    found = linked_components(edges)
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def linked_components(edges: DataFrame, store: Callable[[DataFrame], DataFrame] = saved) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the least node reachable.

    Each round points every node at the first of itself and its neighbours in an order that is drawn anew by
    hashes, follows the pointers twice and contracts the edges to what they point at. Nodes with
    nothing left to join are set aside: a round reads the edges between contracted nodes only, of
    which a drawn order leaves less than half, also on a path. Pointers are resolved from
    the last round back to the first, so every table is joined once.
    """
    left = store(_contracted(edges.select("a", "b")))
    steps: list[DataFrame] = []
    while not left.isEmpty():
        order = lambda c, turn=len(steps): F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("v"))
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        up = both.groupBy("node").agg(F.min(order("other")).alias("first"))
        up = store(up.select("node", F.least(order("node"), "first")["v"].alias("up")))
        for _ in range(2):
            above = up.select(F.col("node").alias("up"), F.col("up").alias("above"))
            up = up.join(above, "up").select("node", F.col("above").alias("up"))
        up = store(up)
        steps.append(up)
        for side in ("a", "b"):
            to = up.select(F.col("node").alias(side), F.col("up").alias("to"))
            left = left.join(to, side).drop(side).withColumnRenamed("to", side)
        left = store(_contracted(left))
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = steps[-1].select("node", F.col("up").alias("root"))
    for step in reversed(steps[:-1]):
        above = found.select(F.col("node").alias("up"), "root")
        found = step.join(above, "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    found = store(found)
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(least, "root").select("node", "component")


def _contracted(edges: DataFrame) -> DataFrame:
    """Each edge once, without loops."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def families(members: DataFrame, parts: DataFrame) -> DataFrame:
    """component, family_id (least text fingerprint), size and whether it holds a historical row.

    members: (node, fingerprint, historical)."""
    return members.join(parts, "node").groupBy("component").agg(F.concat(F.lit("qf_"), F.substring(F.min("fingerprint"), 1, 24)).alias("family_id"), F.count("*").alias("size"), F.max("historical").alias("has_historical"))


def exclude_historical(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows that are not historical and whose component holds no historical row."""
    tainted = members.join(parts, "node").groupBy("component").agg(F.max("historical").alias("h")).where("h")
    return members.where("NOT historical").join(parts, "node").join(tainted, "component", "left_anti")


def exclusion_counts(members: DataFrame, parts: DataFrame, source: str) -> DataFrame:
    """source, n, n_kept, n_excluded of the rows that are not historical; members also has the source."""
    tainted = members.join(parts, "node").groupBy("component").agg(F.max("historical").alias("tainted"))
    each = members.where("NOT historical").join(parts, "node").join(tainted, "component")
    return each.groupBy(source).agg(F.count("*").alias("n"), F.count_if(~F.col("tainted")).alias("n_kept"), F.count_if("tainted").alias("n_excluded"))
