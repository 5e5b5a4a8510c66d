"""Samples that match target category proportions (problem 1).

Examples are reduced to classes: the cross-classified cell (language, view, subset) of an example and the set of targets it
belongs to, with counts of distinct examples.  A min-cost flow over targets and classes fixes how many examples each
target takes: arcs carry the wanted margins, the floors and what the classes hold, and slack arcs show what cannot be met.
The network has one node per target and class, a number bounded by the category values; it is the only thing that reaches
the driver.  The integer quotas of the classes of a target are then drawn at random in proportion to what they hold, and
rows are taken by the order of a seeded hash.

Defined results: a pool row with a null example id or a null in a field that a target names belongs to no such target;
repeated rows of an example count once per target, and an example is drawn at most once per plan; an example spelled in
several cells belongs to the targets of all of them and stands in the least; an empty pool gives an empty sample and a
report in which every target with a positive need is short.
"""

from __future__ import annotations

import random
from collections import defaultdict, deque
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexwarden.session import stored

FIELDS = ("language", "view", "subset")
CELL = ("plan", *FIELDS, "targets")
#: Bound on what the driver reads: plan rows, and classes of examples.
MAX_TARGETS, MAX_CELLS = 20_000, 200_000
#: Spellings of one language code.
CHINESE = ("zh-CN", "zh_CN", "zh-cn")
#: Costs of the slack arcs: a broken floor weighs more than a missed share, an unfilled place more than either.
FLOOR_COST, SHARE_COST, UNFILLED_COST, SPARE_STEPS = 10_000, 100, 1_000_000, 16


def pool(df: DataFrame, name: str) -> DataFrame:
    """(``pool_table``, ``example_id``, ``language``, ``view``, ``subset``) with the spellings of TESTDATA.md set right."""
    return df.where(F.col("example_id").isNotNull()).select(
        F.lit(name).alias("pool_table"),
        "example_id",
        F.when(F.col("language").isin(*CHINESE), "zh").otherwise(F.col("language")).alias("language"),
        "view",
        F.lower(F.regexp_replace("subset", r"(?U)^\s+|\s+$", "")).alias("subset"),
    )


def read_targets(targets: DataFrame) -> list:
    """The target rows on the driver, checked against ``MAX_TARGETS``."""
    rows = targets.select("target_id", "plan", "pool_table", *FIELDS, "share", "min_rows", "sample_size").take(MAX_TARGETS + 1)
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"sample_targets: more than {MAX_TARGETS} rows")
    return sorted(rows, key=lambda r: r["target_id"])


def _patterns(targets: Sequence) -> list[tuple[str, ...]]:
    """The distinct sets of fields that targets of a pool name, by pool: (pool_table, field, ...)."""
    return sorted({(t["pool_table"], *[f for f in FIELDS if t[f] is not None]) for t in targets})


def classed(pools: DataFrame, rows: Sequence) -> DataFrame:
    """(``plan``, ``example_id``, ``language``, ``view``, ``subset``, ``targets``): each example of a plan's pool once.

    ``targets`` are the ids of the plan's targets it belongs to.  One scan: a row is looked up under each set of fields
    that targets name; examples are reduced map-side, so that a hot cell or a repeated example is spread.
    """
    patterns = _patterns(rows)
    number = {p: i for i, p in enumerate(patterns)}
    wanted = pools.sparkSession.createDataFrame(
        [(number[(r["pool_table"], *[f for f in FIELDS if r[f] is not None])], *[r[f] for f in FIELDS], r["plan"], r["target_id"]) for r in rows],
        "pattern int, w_language string, w_view string, w_subset string, plan string, target_id long",
    )
    keys = []
    for i, (name, *fields) in enumerate(patterns):
        fits = F.col("pool_table") == name
        for f in fields:
            fits = fits & F.col(f).isNotNull()
        keys.append(F.when(fits, F.struct(F.lit(i).alias("pattern"), *[(F.col(f) if f in fields else F.lit(None).cast("string")).alias(f) for f in FIELDS])))
    looked = pools.select("example_id", *FIELDS, F.explode(F.array_compact(F.array(*keys))).alias("k"))
    same = (F.col("k.pattern") == F.col("pattern")) & F.col("k.language").eqNullSafe(F.col("w_language")) & F.col("k.view").eqNullSafe(F.col("w_view")) & F.col("k.subset").eqNullSafe(F.col("w_subset"))
    found = looked.join(F.broadcast(wanted), same).groupBy("plan", "example_id").agg(F.min(F.struct(*FIELDS)).alias("cell"), F.collect_set("target_id").alias("ids"))  # targets: at most MAX_TARGETS
    return found.select("plan", "example_id", *[F.col(f"cell.{f}").alias(f) for f in FIELDS], F.array_join(F.sort_array("ids").cast("array<string>"), ",").alias("targets"))


def available(pools: DataFrame, targets: DataFrame) -> DataFrame:
    """(``target_id``, ``available``): distinct examples of the pool that belong to each target; 0 where there is none."""
    rows = read_targets(targets)
    spark = pools.sparkSession
    if not rows:
        return spark.createDataFrame([], "target_id long, available long")
    counts = classed(pools, rows).groupBy("plan", "targets").agg(F.count("*").alias("n"))
    held = counts.select(F.explode(F.split("targets", ",").cast("array<long>")).alias("target_id"), "n").groupBy("target_id").agg(F.sum("n").alias("n"))
    every = spark.createDataFrame([(r["target_id"],) for r in rows], "target_id long")
    return every.join(held, "target_id", "left").select("target_id", F.coalesce("n", F.lit(0)).alias("available"))


def shortfalls(pools: DataFrame, targets: DataFrame) -> DataFrame:
    """(``target_id``, ``plan``, ``available``, ``wanted``, ``missing``, ``met``) of every target by itself.

    ``missing`` is what the slack arc of the target carries when no other target of its plan takes anything.
    """
    rows, out = read_targets(targets), []
    if rows:
        by_plan = _class_counts(classed(pools, rows).groupBy(*CELL).agg(F.count("*").alias("n")))
        for t in rows:
            held = by_plan.get(t["plan"], [])
            missing = own_slack(t, held)
            out.append((t["target_id"], t["plan"], sum(n for key, n in held if t["target_id"] in key[-1]), wanted_units(t), missing, missing == 0))
    return pools.sparkSession.createDataFrame(out, "target_id long, plan string, available long, wanted double, missing long, met boolean")


def short_targets(pools: DataFrame, targets: DataFrame) -> DataFrame:
    """``target_id`` of targets whose pool holds fewer distinct examples than their floor or their share asks for."""
    return shortfalls(pools, targets).where(~F.col("met")).select("target_id")


def wanted_units(target) -> float:
    """The larger of floor and share."""
    return max(float(target["min_rows"] or 0), (target["share"] or 0.0) * (target["sample_size"] or 0))


def own_slack(target, classes: Sequence[tuple[tuple, int]]) -> int:
    """Units that run over the slack arc of a target that has the pool to itself."""
    units = -int(-wanted_units(target) // 1)
    reach = [(key, n) for key, n in classes if target["target_id"] in key[-1]]
    net = FlowNetwork(4 + len(reach))
    net.arc(0, 2, units, 0)
    slack = net.arc(2, 3, units, FLOOR_COST)
    net.arc(3, 1, units, 0)
    for j, (_, n) in enumerate(reach):
        net.arc(2, 4 + j, n, 0)
        net.arc(4 + j, 1, n, 0)
    net.run(0, 1)
    return net.flow(slack)


def _class_counts(counts: DataFrame) -> dict[str, list[tuple[tuple, int]]]:
    """((language, view, subset, target ids), examples) by plan, on the driver, checked against ``MAX_CELLS``."""
    rows = counts.take(MAX_CELLS + 1)
    if len(rows) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} classes")
    out: dict[str, list[tuple[tuple, int]]] = defaultdict(list)
    for r in rows:
        out[r["plan"]].append(((*[r[f] for f in FIELDS], tuple(map(int, r["targets"].split(",")))), r["n"]))
    return {plan: sorted(held, key=repr) for plan, held in out.items()}


@dataclass
class _Arc:
    to: int
    room: int
    cost: int
    back: int


class FlowNetwork:
    """Min-cost flow by successive shortest paths (queue-based Bellman-Ford on the residual arcs)."""

    def __init__(self, nodes: int) -> None:
        self.arcs: list[list[_Arc]] = [[] for _ in range(nodes)]

    def arc(self, a: int, b: int, room: int, cost: int) -> tuple[int, int]:
        """Adds an arc; the returned handle serves :meth:`flow`."""
        self.arcs[a].append(_Arc(b, room, cost, len(self.arcs[b])))
        self.arcs[b].append(_Arc(a, 0, -cost, len(self.arcs[a]) - 1))
        return a, len(self.arcs[a]) - 1

    def flow(self, handle: tuple[int, int]) -> int:
        """Units on the arc."""
        arc = self.arcs[handle[0]][handle[1]]
        return self.arcs[arc.to][arc.back].room

    def run(self, source: int, sink: int) -> tuple[int, int]:
        """Sends all it can at least cost; returns units and cost."""
        sent = paid = 0
        while True:
            far = [float("inf")] * len(self.arcs)
            came: list[tuple[int, int] | None] = [None] * len(self.arcs)
            far[source], queue, queued = 0, deque([source]), [False] * len(self.arcs)
            while queue:
                u = queue.popleft()
                queued[u] = False
                for k, arc in enumerate(self.arcs[u]):
                    if arc.room > 0 and far[u] + arc.cost < far[arc.to]:
                        far[arc.to], came[arc.to] = far[u] + arc.cost, (u, k)
                        if not queued[arc.to]:
                            queued[arc.to] = True
                            queue.append(arc.to)
            if came[sink] is None:
                return sent, paid
            path, at = [], sink
            while at != source:
                u, k = came[at]
                path.append(self.arcs[u][k])
                at = u
            units = min(arc.room for arc in path)
            for arc in path:
                arc.room -= units
                self.arcs[arc.to][arc.back].room += units
            sent, paid = sent + units, paid + units * far[sink]


def _whole(shares: Sequence[float], size: int) -> list[int]:
    """Integer margins that sum to ``size`` where the shares sum to 1: floors, then the largest remainders."""
    exact = [max(0.0, s or 0.0) * size for s in shares]
    out = [int(x + 1e-9) for x in exact]
    spare = round(sum(exact)) - sum(out)
    for i in sorted(range(len(exact)), key=lambda i: (out[i] - exact[i], i))[: max(0, spare)]:
        out[i] += 1
    return out


def plan_quotas(targets: Sequence, cells: Sequence[tuple[tuple, int]], rng: random.Random) -> tuple[dict[int, int], dict[tuple, int], dict[int, int]]:
    """For the targets of one plan: units by target, quota by cell, and units missing by target.

    ``cells``: ((language, view, subset, ids of the targets that may take it), distinct examples).  The source feeds each target its margin.  What a target
    cannot place in its cells runs over its slack arc into a pot, from which targets with spare cells take it at a rising
    price, so that the sample keeps its size; what nobody can place leaves the pot at the highest price.
    """
    size = max((t["sample_size"] or 0 for t in targets), default=0)
    margin = _whole([t["share"] for t in targets], size)
    # A floor reserves no more than the pool holds, so that others can have the rest.
    floor = [min(max(0, t["min_rows"] or 0), sum(n for key, n in cells if t["target_id"] in key[-1])) for t in targets]
    margin = [max(m, f) for m, f in zip(margin, floor, strict=True)]
    over = sum(margin) - max(size, sum(floor))
    while over > 0:  # floors above the share are paid by the targets with the most room
        i = max(range(len(margin)), key=lambda i: (margin[i] - floor[i], -i))
        step = min(over, max(1, (margin[i] - floor[i]) // 2)) if margin[i] > floor[i] else over
        if margin[i] <= floor[i]:
            break
        margin[i] -= step
        over -= step
    # Nodes: source, sink, the spare pot, targets, cells.
    source, sink, pot, first_target = 0, 1, 2, 3
    first_cell = first_target + len(targets)
    net = FlowNetwork(first_cell + len(cells))
    to_cell: dict[tuple[int, int], tuple[int, int]] = {}
    slack, spare = [], [[] for _ in targets]
    for i, t in enumerate(targets):
        net.arc(source, first_target + i, margin[i], 0)
        slack.append((net.arc(first_target + i, pot, floor[i], FLOOR_COST), net.arc(first_target + i, pot, margin[i] - floor[i], SHARE_COST)))
        for step in range(SPARE_STEPS if margin[i] else 0):  # rising costs spread the spare units by margin
            spare[i].append(net.arc(pot, first_target + i, max(1, margin[i] // SPARE_STEPS), 1 + step))
        if margin[i]:
            spare[i].append(net.arc(pot, first_target + i, size, 1 + SPARE_STEPS))
    net.arc(pot, sink, sum(margin), UNFILLED_COST)
    reach: list[list[int]] = [[] for _ in targets]
    number = {t["target_id"]: i for i, t in enumerate(targets)}
    order = list(range(len(cells)))
    rng.shuffle(order)  # among flows of the same cost, a random one
    for j in order:
        key, count = cells[j]
        net.arc(first_cell + j, sink, count, 0)
        for i in (number[t] for t in key[-1] if t in number):
            to_cell[i, j] = net.arc(first_target + i, first_cell + j, count, 0)
            reach[i].append(j)
    net.run(source, sink)
    taken = {i: sum(net.flow(to_cell[i, j]) for j in reach[i]) for i in range(len(targets))}
    # What ran over the slack arcs and did not come back from the pot.
    missing = {t["target_id"]: max(0, sum(map(net.flow, slack[i])) - sum(map(net.flow, spare[i]))) for i, t in enumerate(targets)}
    # The flow says how much a target takes; which classes give it is drawn at random in proportion to what they hold.
    left = {j: count for j, (_, count) in enumerate(cells)}
    shared = {j for j, (key, _) in enumerate(cells) if len(key[-1]) > 1}
    quota: dict[tuple, int] = defaultdict(int)
    for i in range(len(targets)):
        # Classes that several targets may use keep the flow's integers; the target's own ones give the rest.
        draw = {j: net.flow(to_cell[i, j]) for j in reach[i] if j in shared}
        own = {j: left[j] for j in reach[i] if j not in shared}
        draw |= random_quotas(taken[i] - sum(draw.values()), own, rng)
        for j, k in draw.items():
            left[j] -= k
            quota[cells[j][0]] += k
    return {targets[i]["target_id"]: n for i, n in taken.items()}, dict(quota), missing


def random_quotas(units: int, counts: dict[int, int], rng: random.Random) -> dict[int, int]:
    """Integers that sum to ``units``, each the exact proportion rounded down or up, by one systematic random draw."""
    total = sum(counts.values())
    if total == 0 or units <= 0:
        return {j: 0 for j in counts}
    order = sorted(counts)
    rng.shuffle(order)
    out, run, start = {}, 0, rng.random()
    for j in order:
        low = units * run / total
        run += counts[j]
        high = units * run / total
        out[j] = min(counts[j], _ticks(high, start, run == total, units) - _ticks(low, start, False, units))
    short = units - sum(out.values())
    for j in order:  # rounding may ask one more than a cell holds
        step = min(short, counts[j] - out[j])
        out[j], short = out[j] + step, short - step
    return out


def _ticks(x: float, start: float, last: bool, units: int) -> int:
    """How many of the points start, start + 1, ... lie below ``x``; all of them at the end."""
    return units if last else max(0, min(units, int(-(-(x - start) // 1))))


def draw_sample(pools: DataFrame, targets: DataFrame, seed: int = 3407, buckets: int = 4096) -> tuple[DataFrame, DataFrame]:
    """The sample (``plan``, ``language``, ``view``, ``subset``, ``example_id``) and the report, one row per target.

    Report: ``target_id``, ``plan``, ``available``, ``wanted`` (the larger of floor and share), ``drawn``, ``missing``,
    ``met``, ``contested``.  ``missing`` is what the slack arc of the target carries when it has the pool to itself;
    ``contested`` is what its slack arcs carry, or its margin gives up to floors, beyond that when all targets share the pool.
    Within a class the examples of least hash are taken.  Counts by (cell, hash bucket) find the bucket in which
    a quota ends; rows of lower buckets are taken at once and only that bucket is ordered, so that no cell, however
    large, is sorted in one task.
    """
    spark = pools.sparkSession
    rows = read_targets(targets)
    report_schema = "target_id long, plan string, available long, wanted double, drawn long, missing long, met boolean, contested long"
    sample_schema = "plan string, language string, view string, subset string, example_id string"
    if not rows:
        return spark.createDataFrame([], sample_schema), spark.createDataFrame([], report_schema)
    placed = classed(pools, rows).withColumn("h", F.xxhash64(F.lit(seed), "plan", "example_id")).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    placed, _ = stored(placed)  # read twice
    cells = list(CELL)
    counts = placed.groupBy(*cells, "bucket").agg(F.count("*").alias("n"))
    by_plan = _class_counts(counts.groupBy(*cells).agg(F.sum("n").alias("n")))
    quotas, report = [], []
    for plan in sorted({t["plan"] for t in rows}):
        own = [t for t in rows if t["plan"] == plan]
        held = by_plan.get(plan, [])
        drawn, quota, unplaced = plan_quotas(own, held, random.Random(f"{seed}:{plan}"))
        quotas += [(plan, *key[:-1], ",".join(map(str, key[-1])), n) for key, n in quota.items() if n > 0]
        for t in own:
            n, missing = sum(k for key, k in held if t["target_id"] in key[-1]), own_slack(t, held)
            report.append((t["target_id"], plan, n, wanted_units(t), drawn[t["target_id"]], missing, missing == 0, max(unplaced[t["target_id"]] - missing, int(wanted_units(t)) - missing - drawn[t["target_id"]], 0)))
    want = F.broadcast(spark.createDataFrame(quotas, "plan string, language string, view string, subset string, targets string, quota long"))
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"s.{c}")) for c in cells]
    upto = counts.alias("s").join(want.alias("w"), same).select(*[F.col(f"s.{c}").alias(c) for c in cells], "bucket", "n", "quota")
    # At most ``buckets`` rows per cell are ordered here.
    upto = upto.withColumn("below", F.sum("n").over(Window.partitionBy(*cells).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    upto = upto.select(*cells, "bucket", (F.col("quota") - F.coalesce("below", F.lit(0))).alias("room"), "n").where("room > 0")
    same = [F.col(f"u.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*cells, "bucket"]]
    reached = placed.alias("s").join(upto.alias("u"), same).select("s.*", "u.room", "u.n")
    whole = reached.where("n <= room")
    edge = reached.where("n > room").withColumn("rank", F.row_number().over(Window.partitionBy(*cells, "bucket").orderBy("h", "example_id"))).where("rank <= room")
    out = ["plan", *FIELDS, "example_id"]
    return whole.select(*out).unionByName(edge.select(*out)), spark.createDataFrame(report, report_schema)
