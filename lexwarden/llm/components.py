"""Connected components of records that share entities, and splits that keep components together (problem 5).

Components come from the alternating large-star / small-star rounds of Kiveris et al. (2014) over an edge table of
entity values, not of records: all records of one entity are one node, so a source that holds a third of all rows is one
node of small degree, and no group of records is ever collected.

Defined results: a record without any entity (all null) is a component of its own, named after its row key; repeated rows
and repeated links count once; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexwarden.session import cut

MAX_ROUNDS = 40


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the least node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _signature(edges: DataFrame) -> tuple[int, int]:
    """Count and order-free hash of an edge table, two numbers to the driver."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``component``) for every node of ``edges`` (``a``, ``b`` of one type); the component is its least node.

    Self links and null ends are ignored.  Each round is cut with a checkpoint in the shared folder; the rounds needed
    grow with the logarithm of the longest path, and passing ``MAX_ROUNDS`` raises.
    """
    edges = cut(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _signature(edges)
    for _ in range(MAX_ROUNDS):
        if seen[0] == 0:
            break
        edges = cut(_small_star(_large_star(edges)))
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components: no fixed point within {MAX_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def entity_links(df: DataFrame, row_key: str | Column, entities: Sequence[Column], keep: Sequence[str | Column] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows (``row_key``, ``anchor``, ``keep``) and the components (``node``, ``component``) of their entities.

    Entity ``i`` of a row is the text ``i:value``, its first present entity is its anchor.  A row links its anchor with its
    other entities; these links are made distinct before any round, so that no rows enter the rounds.
    """
    key = F.col(row_key) if isinstance(row_key, str) else row_key
    names = [f"__e{i}" for i in range(len(entities))]
    rows = df.select(key.alias("row_key"), *keep, *[F.concat(F.lit(f"{i}:"), e.cast("string")).alias(n) for i, (n, e) in enumerate(zip(names, entities, strict=True))])
    rows = rows.withColumn("anchor", F.coalesce(*names, F.concat(F.lit("row:"), F.col("row_key").cast("string"))))
    links = reduce(DataFrame.unionByName, [rows.select(F.col("anchor").alias("a"), F.col(n).alias("b")) for n in names])
    return rows.drop(*names), components(links.where("b is not null and a <> b").distinct())


def entity_components(df: DataFrame, row_key: str | Column, entities: Sequence[Column]) -> DataFrame:
    """(``row_key``, ``component``) of each row of ``df``; rows that share a value of the same entity are together.

    Rows enter no join but the last, whose hot keys adaptive execution splits.
    """
    rows, found = entity_links(df, row_key, entities)
    joined = rows.join(found, F.col("anchor") == F.col("node"), "left")
    return joined.select("row_key", F.coalesce("component", "anchor").alias("component"))


#: A hash, as exporters use it where the record number was missing.
_HASH = r"^([0-9a-f]{20}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"
#: Exporter, separator, zero-padded record number, and a language tag that some exporters add.
_NUMBERED = r"^([a-z][a-z0-9]*?)(?:[-_: ]0*([0-9]+)|([0-9]{9}))(?:[-_.:/ ][a-z]{2,3}(?:[-_][a-z]{2,4})?)?$"


def source_key(source_id: Column) -> Column:
    """One text for all spellings of a source id: ``exporter#number``; ids without a record number stand for themselves.

    Case, outer blanks, the separator, zero padding and a language tag are set aside.  Without a separator the number is
    the nine-digit field at the end, as an exporter's name may itself end in digits.  Null stays null.
    """
    plain = F.lower(F.regexp_replace(source_id, r"(?U)^\s+|\s+$", ""))
    exporter, number = F.regexp_extract(plain, _NUMBERED, 1), F.regexp_extract(plain, _NUMBERED, 2)
    padded = F.regexp_replace(F.regexp_extract(plain, _NUMBERED, 3), "^0+", "")
    number = F.when(number != "", number).otherwise(F.when(padded != "", padded).otherwise("0"))
    return F.when(plain.rlike(_HASH) | ~plain.rlike(_NUMBERED), F.concat(F.lit("="), plain)).otherwise(F.concat_ws("#", exporter, number))


#: Components with at least this share of all rows are placed one by one; there are at most as many as it goes into 1.
HEAVY = 1 / 5000


def read_shares(targets: DataFrame) -> dict[str, float]:
    """Shares by split name that sum to 1.  Reads the target table after checking that it is small; null or negative shares raise."""
    rows = targets.select("split_name", "share").take(1001)
    if len(rows) > 1000:
        raise ValueError("split_targets: more than 1000 splits")
    if any(r["share"] is None or r["share"] < 0 or r["split_name"] is None for r in rows):
        raise ValueError("split_targets: a share or name is null, or a share is negative")
    total = sum(r["share"] for r in rows) or 1.0
    return {r["split_name"]: r["share"] / total for r in sorted(rows, key=lambda r: r["split_name"])}


def place_heavy(shares: dict[str, float], heavy: Sequence[tuple[str, float]]) -> tuple[dict[str, str], dict[str, float]]:
    """The split of each heavy (component, share of the rows), largest first into the most room; and the room left, as ranges' widths."""
    room, placed = dict(shares), {}
    for component, share in sorted(heavy, key=lambda h: (-h[1], h[0])):
        name = max(room, key=lambda n: (room[n], n))
        placed[component] = name
        room[name] -= share
    room = {n: max(0.0, r) for n, r in room.items()}
    total = sum(room.values())
    return placed, {n: r / total for n, r in room.items()} if total > 0 else dict(shares)


def split_ranges(shares: dict[str, float]) -> list[tuple[str, float, float]]:
    """(name, low, high): consecutive ranges of [0, 1) as wide as the shares, in order of name."""
    low, out = 0.0, []
    for name in sorted(shares):
        out.append((name, low, low + shares[name]))
        low = out[-1][2]
    return out


def assign_splits(members: DataFrame, targets: DataFrame, seed: int = 3407) -> DataFrame:
    """(``row_key``, ``component``, ``assigned_split``): heavy components first, the hash of the others falls into proportional ranges.

    One aggregation by component finds those with ``HEAVY`` of the rows or more, a number bounded by its inverse; they go
    where most room is left, and the ranges of the others are as wide as what remains.  So shares hold as closely as the
    largest component allows; :func:`split_report` shows them.
    """
    spark = members.sparkSession
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    total = F.broadcast(members.agg(F.count("*").alias("all_rows")))  # one number
    heavy = sizes.crossJoin(total).where(F.col("n") >= F.lit(HEAVY) * F.col("all_rows")).select("component", F.col("n") / F.col("all_rows")).collect()
    shares = read_shares(targets)
    if not shares:
        return members.select("row_key", "component", F.lit(None).cast("string").alias("assigned_split"))
    placed, left = place_heavy(shares, [tuple(r) for r in heavy])
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("component")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    chosen = reduce(lambda c, r: F.when(u >= F.lit(r[1]), F.lit(r[0])).otherwise(c), [r for r in split_ranges(left) if r[2] > r[1]], F.lit(None).cast("string"))
    sent = F.broadcast(spark.createDataFrame(list(placed.items()), "component string, heavy_split string"))
    return members.join(sent, "component", "left").select("row_key", "component", F.coalesce("heavy_split", chosen).alias("assigned_split"))


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows, components and realised share of each split against its target."""
    counts = assigned.groupBy("assigned_split", "component").count().groupBy("assigned_split").agg(
        F.sum("count").alias("n_rows"), F.count("*").alias("n_components"), F.max("count").alias("largest_component")
    )
    total = counts.agg(F.sum("n_rows").alias("all_rows"))
    wanted = targets.select(F.col("split_name").alias("assigned_split"), F.col("share").alias("target_share"))
    return (
        wanted.join(counts, "assigned_split", "full")
        .crossJoin(F.broadcast(total))  # one row of one number
        .select(
            "assigned_split",
            "target_share",
            F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
            F.coalesce("n_components", F.lit(0)).alias("n_components"),
            F.coalesce("largest_component", F.lit(0)).alias("largest_component"),
            F.round(F.coalesce("n_rows", F.lit(0)) / F.col("all_rows"), 6).alias("realised_share"),
        )
    )


def scattered_rows(df: DataFrame, row_key: str | Column, entities: Sequence[Column], split: str) -> DataFrame:
    """``row_key`` of the rows whose component has rows in more than one ``split``.

    Rows are reduced to (anchor, split) before anything is joined; only then do they meet the torn anchors in a semi-join.
    """
    rows, found = entity_links(df, row_key, entities, [F.col(split).alias("__split")])
    anchors = rows.groupBy("anchor", "__split").agg(F.count("*").alias("n")).drop("n")
    placed = cut(anchors.join(found, F.col("anchor") == F.col("node"), "left").select("anchor", "__split", F.coalesce("component", "anchor").alias("component")))  # read twice
    torn = placed.groupBy("component").agg(F.countDistinct(F.coalesce("__split", F.lit(""))).alias("n")).where("n > 1").select("component")
    return rows.join(placed.join(torn, "component", "left_semi").select("anchor").distinct(), "anchor", "left_semi").select("row_key")
