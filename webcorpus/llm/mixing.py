"""Mixing sources to target weights by a splitting tree; DataFrame functions only.

Documents of a source are dealt into at most ``BLOCKS`` blocks by a hash of their id, which is a
fixed random permutation. A source's quota is the number of blocks its target takes, repeats
counted. A binary tree splits the vector of quotas among the output shards: at every node the
blocks that go left are a multivariate hypergeometric draw, taken source by source by inverting the
distribution function at a hashed uniform number. Shards then take disjoint runs of the permuted
blocks and are shuffled locally. Everything is a function of the data and ``SEED``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webcorpus.llm.common import WORD, stored

SEED = 42
WEIGHTS = (5, 2, 1)
SHARE = 1.5  # words of the mix over words of all sources
MOST = 2  # copies of a source, and of a document, at most
BLOCKS = 4096  # blocks per source at most
SHARDS = 64  # a power of two
BITS = 48


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, docs, place, target): one row per source, sources by code point, NULL last.

    A source stops at ``most`` times its size; what it leaves is shared by weight among the others,
    until none is above. Filling goes by the ratio of limit to weight: a source is full if its ratio
    is within the level that all sources of smaller ratio leave. One row per source meets in a window.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    ranked = sizes.withColumn("place", F.row_number().over(order))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    limit = (F.col("source_size") * most).cast("double")
    filled = ranked.withColumn("weight", weight.cast("double")).withColumn("limit", limit)
    every = Window.partitionBy()
    before = Window.orderBy(F.col("limit") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    filled = filled.withColumn("whole", share * F.sum("source_size").over(every)).withColumn("heft", F.sum("weight").over(every))
    level = (F.col("whole") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.col("heft") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    filled = filled.withColumn("full", F.col("limit") / F.col("weight") <= level)
    taken = F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(every)
    used = F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0.0)).over(every)
    rest = F.col("weight") * (F.col("whole") - taken) / (F.col("heft") - used)
    return filled.select("source", "source_size", "docs", "place", F.when(F.col("full"), F.col("limit")).otherwise(rest).alias("target"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def hypergeometric(population: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` are marked: the distribution function inverted at ``u``.

    Probabilities are taken relative to the mode's, by their recurrence, upwards and then downwards;
    beyond 12 standard deviations they are below double precision.
    """
    low = F.greatest(F.lit(0).cast("bigint"), drawn + marked - population)
    high = F.least(drawn, marked)
    mode = F.least(high, F.greatest(low, F.floor((drawn + 1.0) * (marked + 1.0) / (population + 2.0))))
    spread = (12 * F.sqrt(F.greatest(F.lit(0.0), drawn * 1.0 * marked / F.greatest(population, F.lit(1)) / F.greatest(population, F.lit(1)) * (population - marked))) + 12).cast("bigint")
    top, bottom = F.least(high, mode + spread), F.greatest(low, mode - spread)

    def up(k: Column) -> Column:  # probability of k + 1 over that of k
        return (marked - k) * 1.0 * (drawn - k) / ((k + 1.0) * (population - marked - drawn + k + 1))

    def down(k: Column) -> Column:  # probability of k - 1 over that of k
        return k * 1.0 * (population - marked - drawn + k) / ((marked - k + 1.0) * (drawn - k + 1))

    def walk(first: Column, last: Column, step: int, ratio, start: Column, aim: Column) -> Column:
        """struct<p, c, k>: the sum c of the probabilities, and the first k at which it exceeds aim."""
        begin = F.struct(start.alias("p"), F.lit(0.0).alias("c"), F.lit(-1).cast("bigint").alias("k"))
        ks = F.when(first <= last if step > 0 else first >= last, F.sequence(first, last, F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))

        def move(a: Column, k: Column) -> Column:
            c = a["c"] + a["p"]
            return F.struct((a["p"] * ratio(k)).alias("p"), c.alias("c"), F.when((a["k"] < 0) & (c > aim), k).otherwise(a["k"]).alias("k"))

        return F.aggregate(ks, begin, move)

    never = F.lit(float("inf"))
    above = walk(mode, top, 1, up, F.lit(1.0), never)["c"]
    under = walk(mode - 1, bottom, -1, down, down(mode), never)["c"]
    value = F.aggregate(
        F.array(F.struct(above.alias("above"), under.alias("under"))),
        F.lit(-1).cast("bigint"),
        lambda _, s: F.when(
            u * (s["above"] + s["under"]) < s["above"], walk(mode, top, 1, up, F.lit(1.0), u * (s["above"] + s["under"]))["k"]
        ).otherwise(walk(mode - 1, bottom, -1, down, down(mode), u * (s["above"] + s["under"]) - s["above"])["k"]),
    )
    return F.when(value < 0, F.when(u < 0.5, top).otherwise(bottom)).otherwise(value)


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(place, shard, first, blocks): each shard's run of every source's block copies.

    ``quotas`` is (place, quota). A node of the tree is one row per source; half of its blocks,
    rounded down, go left. A level draws the sources in turn, each from what the later ones leave.
    """
    nodes = quotas.select("place", F.lit(0).cast("bigint").alias("node"), F.col("quota").cast("bigint").alias("n"))
    level = 1
    while level < shards:
        packed = nodes.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("place", "n"))).alias("sources"))
        total = F.aggregate("sources", F.lit(0).cast("bigint"), lambda a, s: a + s["n"])
        packed = packed.withColumn("total", total)
        begin = F.struct(
            F.col("total").alias("population"), F.floor(F.col("total") / 2).alias("draw"), F.array().cast("array<bigint>").alias("left")
        )

        def draw(a: Column, s: Column) -> Column:
            got = F.when(a["draw"] <= 0, F.lit(0).cast("bigint")).otherwise(
                hypergeometric(a["population"], s["n"], a["draw"], uniform(F.lit(seed), F.lit(level), F.col("node"), s["place"]))
            )
            return F.aggregate(
                F.array(got),
                F.struct(a["population"].alias("population"), a["draw"].alias("draw"), a["left"].alias("left")),
                lambda _, g: F.struct((a["population"] - s["n"]).alias("population"), (a["draw"] - g).alias("draw"), F.concat(a["left"], F.array(g)).alias("left")),
            )

        halves = F.zip_with(
            "sources",
            F.aggregate("sources", begin, draw)["left"],
            lambda s, left: F.struct(s["place"].alias("place"), left.alias("left"), (s["n"] - left).alias("right")),
        )
        # Written before the next level, or the plan would double with each.
        split = stored(packed.select("node", F.explode(halves).alias("half")).select("node", "half.*"))
        nodes = split.select("place", (F.col("node") * 2).alias("node"), F.col("left").alias("n")).unionByName(
            split.select("place", (F.col("node") * 2 + 1).alias("node"), F.col("right").alias("n"))
        )
        level *= 2
    earlier = Window.partitionBy("place").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("bigint"))
    return nodes.select("place", F.col("node").cast("int").alias("shard"), first.alias("first"), F.col("n").alias("blocks"))


def _hash(seed: int) -> Column:
    """48 bits from the id, the same in any engine that has md5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("bigint")


def plan(docs: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """(doc_id, key, size, source_size, target, copies, taken, shards): what the mix takes of each row.

    ``key`` is a hash of id and text; wholly equal rows share one. All documents are taken as many
    whole times as the target holds; of the rest whole blocks are taken in their permuted order,
    and of the last block the documents whose middle lies within the rest.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = stored(
        docs.select(
            "doc_id", F.col("source").cast("string").alias("source"), words.alias("size"), F.xxhash64("doc_id", "text").alias("key"), _hash(seed).alias("hash")
        )
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    aims = stored(targets(sizes))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST))).otherwise(0)
    aims = aims.withColumn("whole", whole.cast("int")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    aims = aims.withColumn("per", F.least(F.col("docs"), F.lit(blocks)))
    # A row per source: the sources are broadcast only if Spark finds them small.
    known = aims.withColumnRenamed("source", "name")
    placed = rows.join(known, rows["source"].eqNullSafe(known["name"])).select(
        "doc_id", "key", "size", "hash", "place", "source_size", "target", "whole", "rest",
        F.shiftright(F.col("hash") * F.col("per"), BITS).alias("block"),
    )
    placed = stored(placed)
    tiles = placed.groupBy("place", "block").agg(F.sum("size").alias("words"), F.first("whole").alias("whole"), F.first("rest").alias("rest"))
    by_place = Window.partitionBy("place").orderBy("block")
    tiles = tiles.withColumn("before", F.sum("words").over(by_place) - F.col("words")).withColumn("rank", F.row_number().over(by_place) - 1)
    tiles = tiles.withColumn("count", F.count("*").over(Window.partitionBy("place")))
    # Of its extra copy a block is taken whole, in part, or not at all.
    tiles = stored(
        tiles.withColumn("room", F.col("rest") - F.col("before")).withColumn(
            "extra", F.when(F.col("room") >= F.col("words"), F.lit("all")).when(F.col("room") > 0, F.lit("part")).otherwise("none")
        )
    )
    quotas = tiles.groupBy("place").agg(
        (F.first("whole") * F.count("*") + F.count_if(F.col("extra") != "none")).cast("bigint").alias("quota")
    )
    runs = split_quotas(quotas, shards, seed)
    spots = runs.filter("blocks > 0").select(
        "place", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("spot")
    )
    copies = tiles.select(
        "place", "block", F.posexplode(F.sequence(F.lit(0), F.col("whole") - F.when(F.col("extra") == "none", 1).otherwise(0))).alias("copy", "_"),
        "rank", "count",
    ).filter("`_` = copy").withColumn("spot", F.col("copy") * F.col("count") + F.col("rank"))
    homes = copies.join(spots, ["place", "spot"]).groupBy("place", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("homes"))
    parts = tiles.join(homes, ["place", "block"], "left").select("place", "block", "extra", "room", "homes")
    both = placed.join(parts, ["place", "block"])
    inside = Window.partitionBy("place", "block").orderBy("hash", "doc_id", "key")
    # Only the one block per source that is taken in part is put in order.
    middle = F.sum("size").over(inside) - F.col("size") / 2
    part = both.filter("extra = 'part'").withColumn("more", F.when(middle <= F.col("room"), 1).otherwise(0))
    rest = both.filter("extra <> 'part'").withColumn("more", F.when(F.col("extra") == "all", 1).otherwise(0))
    found = part.unionByName(rest).withColumn("copies", F.col("whole") + F.col("more"))
    homes = F.transform(F.slice(F.coalesce("homes", F.array().cast("array<struct<copy:int,shard:int>>")), F.lit(1), F.col("copies")), lambda h: h["shard"])
    return found.select(
        "doc_id", "key", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), homes.alias("shards")
    )


def op6(docs: DataFrame) -> DataFrame:
    """What the mix takes of every row, and the shards that its copies go to.

    NULL texts have size 0. A NULL source is a source, the last. Rows that repeat an id are dealt to
    the same block. Without any word every target is 0; an empty table gives no rows.
    """
    return plan(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "shards")


def mixture(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as taken, with ``shard`` and ``copy``.

    Rows lie by shard, in an order drawn by a hash within it.
    """
    taken = plan(docs.select("doc_id", "text", "source"), shards, seed=seed)
    # Wholly equal rows have equal plans but for the last block, where each has its own.
    pairs = Window.partitionBy("doc_id", "key").orderBy(F.desc("copies"))
    homes = taken.withColumn("nth", F.row_number().over(pairs)).select(
        F.col("doc_id").alias("__llm_id"), F.col("key").alias("__llm_key"), F.col("nth").alias("__llm_nth"), F.col("shards").alias("__llm_shards")
    )
    rest = [F.col(f"`{n}`") for n in docs.columns if n not in ("doc_id", "text")]
    keyed = docs.withColumn("__llm_own", F.xxhash64("doc_id", "text"))
    keyed = keyed.withColumn("__llm_row", F.row_number().over(Window.partitionBy("doc_id", "__llm_own").orderBy(*(rest or [F.lit(0)]))))
    both = keyed.join(
        homes, F.col("doc_id").eqNullSafe(F.col("__llm_id")) & (F.col("__llm_own") == F.col("__llm_key")) & (F.col("__llm_row") == F.col("__llm_nth"))
    )
    columns = [F.col(f"`{n}`") for n in docs.columns if n not in ("shard", "copy")]
    out = both.select(*columns, F.posexplode("__llm_shards").alias("copy", "shard"), "__llm_own")
    place = F.xxhash64(F.lit(seed), "shard", "copy", "__llm_own")
    return out.repartition("shard").sortWithinPartitions("shard", place).drop("__llm_own")
