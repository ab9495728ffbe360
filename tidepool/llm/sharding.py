"""Sharding by sampled splitters, in DataFrame functions alone.

A size-weighted sample of the records' keys gives quantile boundaries; records are range-partitioned between them, and ranges
that turn out overfull are divided at further sampled keys until none is. Groups of equal texts too large for a range are
placed by themselves, whole where a shard has room, and dealt by a hash to as many units as they hold ranges. Exact running
sums inside each unit and over the units place every record, so that shards hold nearly equal bytes.
"""

from __future__ import annotations

import json
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Written

#: Rows that a range should hold, the most ranges before division, sampled keys for each range.
RANGE_ROWS, MOST_RANGES, KEYS_PER_RANGE = 8192, 4096, 16
#: A group of equal texts above a shard's bytes divided by this is placed by itself.
PLACED_PART = 100

GROUP = ("k", "c", "size")
_KEY = "array<struct<k:bigint,c:bigint,size:bigint>>"
Key = tuple[int, int, int]


def _small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table from the plan's own text; for bounded lists."""
    made = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.explode(made).alias("r")).select("r.*")


def _range_of(splitters: list[Key]) -> Column:
    """How many splitters are not above the group's key, by binary search over a constant array."""
    if not splitters:
        return F.lit(0)
    array = F.from_json(F.lit(json.dumps([dict(zip(GROUP, s, strict=True)) for s in splitters])), _KEY)
    strides = [1 << b for b in reversed(range(len(splitters).bit_length()))]

    def step(low: Column, stride: Column) -> Column:
        further = low + stride
        return F.when((further <= len(splitters)) & (F.get(array, further - 1) <= F.struct(*GROUP)), further).otherwise(low)

    return F.aggregate(F.array(*[F.lit(x) for x in strides]), F.lit(0), step)


def _sample(groups: DataFrame, rate: float, salt: str) -> list[tuple[Key, float]]:
    """Group keys drawn in proportion to their weight, decided by a hash, each with the weight that it stands for, in order."""
    drawn = F.pmod(F.xxhash64(*GROUP, F.lit(salt)), F.lit(1 << 52)) / float(1 << 52)
    rows = groups.where(drawn < F.col("w") * rate).select(*GROUP, "w").sort(*GROUP).collect()  # about ranges * KEYS_PER_RANGE
    return [((r.k, r.c, r["size"]), max(r.w, 1 / rate)) for r in rows]


def _quantiles(keys: list[tuple[Key, float]], pieces: int) -> list[Key]:
    """Keys that cut the sample's weight into about equal pieces."""
    total, done, cuts = sum(w for _, w in keys), 0.0, []
    for key, w in keys:
        if done * pieces >= total * (len(cuts) + 1):
            cuts.append(key)
        done += w
    return cuts


def _splitters(groups: DataFrame, ranges: int, total: float) -> list[Key]:
    """Splitters between which no range holds more than two parts of the weight, one part being total / ranges.

    No group is heavier than one part, so a range that is over can always be divided. Each round samples the ranges that are
    over alone, at a rate that gives about the same number of keys.
    """
    wanted = ranges * KEYS_PER_RANGE
    chosen = set(_quantiles(_sample(groups, wanted / total, "splitter"), ranges)) if total else set()
    for turn in range(1, 64):
        splitters = sorted(chosen)
        held = groups.groupBy(_range_of(splitters).alias("r")).agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
        over = {x.r: x.w for x in held.where((F.col("w") > 2 * total / ranges) & (F.col("n") > 1)).collect()}  # fewer than ranges
        if not over:
            break
        inside = groups.withColumn("r", _range_of(splitters)).where(F.col("r").isin(list(over)))
        bounds = [None, *splitters, None]
        keys = _sample(inside, wanted * 2.0**turn / sum(over.values()), f"splitter{turn}")
        for r, w in over.items():
            own = [(key, x) for key, x in keys if (bounds[r] is None or key > bounds[r]) and (bounds[r + 1] is None or key < bounds[r + 1])]
            chosen |= {key for key, _ in own[len(own) // 2 :][:1]} | set(_quantiles(own, int(w * ranges / total) + 1))
    return sorted(chosen)


def _place(big: list, shards: int, total: int) -> tuple[list[list[tuple[int, int]]], list[int]]:
    """For each big group, largest first, its pieces as (first byte, shard), and the bytes of each shard's big groups.

    A group goes whole to the emptiest shard where that leaves it at most a PLACED_PART over an equal share, or where the
    group is a single record; another is cut into pieces that fill the emptiest shards.
    """
    load, share, spare = [0] * shards, total // shards + 1, total // (shards * PLACED_PART)
    pieces = []
    for g in big:
        at = load.index(min(load))
        if g.n == 1 or load[at] + g.b <= share + spare:
            load[at] += g.b
            pieces.append([(0, at)])
            continue
        own, start = [], 0
        while start < g.b:
            at = load.index(min(load))
            length = min(g.b - start, share - load[at])
            own.append((start, at))
            load[at] += length
            start += length
        pieces.append(own)
    return pieces, load


def _fill(load: list[int], rest: int) -> list[int]:
    """Bytes that each shard takes of the rest, so that all stand at one level where they can."""
    order, level = sorted(load), 0.0
    for i in range(1, len(order) + 1):
        level = (rest + sum(order[:i])) / i
        if i == len(order) or level <= order[i]:
            break
    return [max(0, round(level) - x) for x in load]


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts each row into one of ``shards`` shards of nearly equal bytes (law ``bytes``).

    Size is the text's UTF-8 bytes plus one. Shards differ by less than the largest record and three hundredths of a shard.
    Rows of equal texts are in one shard, except groups that no shard had room for: those that would leave theirs more than a
    hundredth over an equal share. Such a group is cut into as few pieces as fill the emptiest shards.

    Null text: no bytes, size 1, crc32 0. Null id: an id below all others. Repeated rows each get a slot of their own;
    rows equal in all columns may trade theirs. However many rows share a text, and an id too, no task holds them all.
    Empty table: no rows. Extra columns: ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    wanted = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("c"),
        F.xxhash64(text).alias("k"),
        F.monotonically_increasing_id().alias("u"),  # tells repeated rows apart; fixed once written
    )
    rows = Written(wanted, "shard-keys").df
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(2 * shards, min(MOST_RANGES, n // RANGE_ROWS + 1))

    # Groups of equal texts: those above a part of a shard, or above a range, are at most PLACED_PART * shards + ranges.
    groups = rows.groupBy(*GROUP).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    groups = Written(groups.withColumn("w", F.col("b") / float(max(total, 1)) + F.col("n") / float(max(n, 1))), "shard-groups").df
    is_big = (F.col("b") * (PLACED_PART * shards) > total) | (F.col("w") > 1.0 / ranges)
    big = groups.where(is_big).sort(F.desc("b"), *GROUP).collect()
    pieces, load = _place(big, shards, total)
    small = groups.where(~is_big)
    splitters = _splitters(small, ranges, 2.0 - sum(g.w for g in big) if len(big) < n else 0.0)

    # Units: the ranges, then each big group's parts by a hash.
    parts = [max(1, round(g.w * ranges)) for g in big]
    first_unit = [len(splitters) + 1 + x for x in accumulate(parts, initial=0)]
    dealt = rows
    if big:
        table = [{"k": g.k, "c": g.c, "size": g["size"], "g": i, "first": first_unit[i], "parts": parts[i]} for i, g in enumerate(big)]
        dealt = dealt.join(F.broadcast(_small_table(spark, table, "k:bigint,c:bigint,size:bigint,g:int,first:int,parts:int")), list(GROUP), "left")
        part = F.col("first") + F.pmod(F.xxhash64("doc_id", "u"), F.col("parts")).cast("int")
        dealt = dealt.withColumn("unit", F.coalesce(part, _range_of(splitters)))
    else:
        dealt = dealt.withColumns({"g": F.lit(None).cast("int"), "unit": _range_of(splitters)})
    dealt = dealt.select("doc_id", *GROUP, "u", "g", "unit")
    held = {x.unit: x.b for x in dealt.groupBy("unit").agg(F.sum("size").alias("b")).collect()}
    before = list(accumulate((held.get(r, 0) for r in range(len(splitters))), initial=0))
    for i in range(len(big)):
        before += accumulate((held.get(u, 0) for u in range(first_unit[i], first_unit[i + 1] - 1)), initial=0)

    order = Window.partitionBy("unit").orderBy(*GROUP, "doc_id", "u")
    same = Window.partitionBy("unit", *GROUP)
    start = F.get(F.from_json(F.lit(json.dumps(before)), "array<bigint>"), F.col("unit"))
    placed = dealt.withColumn("at", start + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.withColumns({"group_at": F.min("at").over(same), "group_size": F.sum("size").over(same)})
    middle = 2 * F.col("group_at") + F.col("group_size")
    ends = list(accumulate(_fill(load, total - sum(load))))[:-1]
    chosen = sum((F.when(middle > 2 * end, 1).otherwise(0) for end in ends), F.lit(0))
    if big:
        own = F.get(F.from_json(F.lit(json.dumps([[{"s": s, "t": t} for s, t in p] for p in pieces])), "array<array<struct<s:bigint,t:int>>>"), F.col("g"))
        reached = F.filter(own, lambda p: 2 * p["s"] <= 2 * F.col("at") + F.col("size"))
        chosen = F.when(F.col("g").isNotNull(), F.element_at(reached, -1)["t"]).otherwise(chosen)
    placed = placed.withColumn("shard", chosen.cast("int"))
    placed = placed.withColumn("nth", F.row_number().over(Window.partitionBy("unit", "shard").orderBy(*GROUP, "doc_id", "u")) - 1)
    placed = Written(placed.select("doc_id", "size", F.col("c").alias("text_crc32"), "shard", "unit", "nth"), "shard-placed").df

    # Slots before each unit's in a shard: a row for each unit and shard, and units are consecutive stretches, so few.
    counts = sorted((x.shard, x.unit, x["count"]) for x in placed.groupBy("shard", "unit").count().collect())
    bases, so_far = [], {}
    for s, unit, count in counts:
        bases.append({"shard": s, "unit": unit, "base": so_far.get(s, 0)})
        so_far[s] = so_far.get(s, 0) + count
    joined = placed.join(F.broadcast(_small_table(spark, bases, "shard:int,unit:int,base:bigint")), ["shard", "unit"])
    return joined.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("nth")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
