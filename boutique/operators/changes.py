"""Batches with several changes to one row, applied as one call after the other would.

``seq`` orders a batch (null last; ties by the change's content). Three steps:

* :func:`ordered` numbers the changes; without a ``seq`` column they have no order, and all
  changes of a key that has more than one are refused;
* :func:`settle` decides the changes whose validity depends on the changes before them: a
  unique value (an email, a seller's place for a product) that another row holds, gives up
  or takes, and a balance that must not become negative;
* :func:`fold` takes, per key and field, the last non-null value among the accepted changes.

Only contended values need an order. A value that one row alone wants, and no other holds,
is granted at once. The others split the rows into components (rows that want or hold a
common contended value, directly or through others); a component's changes are decided in
``seq`` order by one task, its first ``boutique.serialLines`` of them at a time, all
components in parallel.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutique.operators import quality as qa
from boutique.operators.allocation import SERIAL_LINES
from boutique.operators.components import connected
from boutique.operators.ordered import row_numbers, running_sum
from boutique.session import materialize, ship_package

N = "_n"


def content_order(changes: DataFrame) -> list[Column]:
    """The order of a batch: ``seq`` (null last), then all other columns."""
    others = sorted(c for c in changes.columns if c not in ("seq", "errors"))
    return [F.col("seq").asc_nulls_last(), *[F.col(c).asc_nulls_first() for c in others]]


def ordered(changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(changes with their number ``_n``, refused changes (key, errors)); materialized."""
    if "seq" in changes.columns:
        numbered = materialize(row_numbers(changes, N, content_order(changes)))
        return numbered, numbered.limit(0).select(F.col(key).cast("string").alias("key"), F.array(F.lit("")).alias("errors"))
    flagged = materialize(qa.with_unique_flag(changes, key, "_once").withColumn(N, F.monotonically_increasing_id()))
    refused = flagged.filter(~F.col("_once")).select(
        F.col(key).cast("string").alias("key"), F.array(F.lit(f"{key}: duplicated in batch")).alias("errors"))
    return flagged.filter("_once").drop("_once"), refused


def fold(accepted: DataFrame, key: str, fields: Iterable[str]) -> DataFrame:
    """One row per key: of each field the last non-null value. Combined map-side, so a key
    with any number of changes is one row per task before it moves."""
    return accepted.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(N))).alias(c) for c in fields])


# ------------------------------------------------------------------------------- settling
_DECIDED = "_n long, taken boolean, negative boolean, large boolean"
_COLUMNS = ["_n", "holder", "wanted", "set_a", "set_b", "held", "a", "b", "owner"]
LARGEST = 2_147_483_647


def _decide(key: tuple[pa.Scalar, ...], events: pa.Table) -> pa.Table:
    """The changes of one component, one after the other."""
    state: dict[str, tuple] = {}
    owners: dict[str, str | None] = {}
    out: list[tuple] = []
    for n, holder, wanted, set_a, set_b, held, a, b, owner in zip(*(events.sort_by(N).column(c).to_pylist() for c in _COLUMNS), strict=True):
        held, a, b = state.get(holder, (held, a, b))
        a, b = a if set_a is None else set_a, b if set_b is None else set_b
        moves = wanted is not None and wanted != held
        taken = moves and owners.get(wanted, owner) not in (None, holder)
        negative, large = a - b < 0, a - b > LARGEST
        if not (taken or negative or large):
            if moves:
                owners[held], owners[wanted], held = None, holder, wanted
            state[holder] = (held, a, b)
        out.append((n, taken, negative, large))
    return pa.Table.from_pydict(dict(zip(("_n", "taken", "negative", "large"), map(list, zip(*out, strict=True)), strict=True)))


def _with_state(events: DataFrame, holders: DataFrame) -> DataFrame:
    """Events with what their row holds (held, a, b) and the other row that holds what they want."""
    owners = holders.groupBy("held").agg(F.min("holder").alias("_low"), F.max("holder").alias("_high")).withColumnRenamed("held", "wanted")
    j = events.join(holders, "holder").join(owners, "wanted", "left")
    return j.select("_n", "holder", "wanted", "set_a", "set_b", "held", "a", "b",
                    F.nullif(F.when(F.col("_low") == F.col("holder"), F.col("_high")).otherwise(F.col("_low")), F.col("holder")).alias("owner"))


def settle(events: DataFrame, holders: DataFrame, most: int | None = None, pieces: int | None = None) -> DataFrame:
    """(_n, taken, negative, large) for every event, decided in the order of ``_n``.

    ``events``: (_n, holder, wanted, set_a, set_b), the value a row wants to hold (null: as it
    is) and its new balance terms (null: as they are). ``holders``: (holder, held, a, b), one
    row per holder, values held by one row each (if several hold one, each blocks the others).
    A change is refused if another row holds what it wants, or if a - b leaves 0 .. 2**31 - 1.
    """
    ship_package(events.sparkSession)
    most = most or int(events.sparkSession.conf.get("boutique.serialLines", str(SERIAL_LINES)))
    state = materialize(_with_state(events, holders))
    # Contended: wanted or held by more than one row.
    wants = state.filter(F.col("wanted").isNotNull())
    claims = materialize(wants.select(F.col("wanted").alias("value"), "holder").unionByName(
        wants.filter(F.col("owner").isNotNull()).select(F.col("wanted").alias("value"), F.col("owner").alias("holder"))).unionByName(
        # Whoever holds a wanted value, if only to say that it is its own.
        wants.filter(F.col("wanted").eqNullSafe(F.col("held"))).select(F.col("wanted").alias("value"), "holder")).distinct())
    contended = claims.groupBy("value").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("value")
    node = lambda kind, c: F.xxhash64(F.lit(kind), F.col(c))
    edges = materialize(claims.join(contended, "value", "left_semi").select(node("row", "holder").alias("a"), node("value", "value").alias("b")))
    several = state.groupBy("holder").agg(F.count(F.lit(1)).alias("_events"))
    state = state.join(several, "holder").withColumn("_node", node("row", "holder"))
    if edges.isEmpty():
        state = state.withColumn("component", F.when(F.col("_events") > 1, F.col("_node")))
    else:
        roots = connected(edges).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        state = state.join(roots, "_node", "left").withColumn("component", F.coalesce("_root", F.when(F.col("_events") > 1, F.col("_node")))).drop("_root")
    state = materialize(state.drop("_node", "_events"))
    balance = F.coalesce("set_a", "a") - F.coalesce("set_b", "b")
    alone = state.filter(F.col("component").isNull()).select(
        "_n", F.lit(False).alias("taken"), (balance < 0).alias("negative"), (balance > LARGEST).alias("large"))
    left = state.filter(F.col("component").isNotNull()).select("_n", "holder", "wanted", "set_a", "set_b", "held", "a", "b", "owner", "component")
    decided = alone
    while (n := left.count()) > most:
        placed = running_sum(left, {"before": F.lit(1)}, [N], ["component"], inclusive=False, per_piece=pieces, rows=n)
        placed = materialize(placed)
        first = placed.filter(F.col("before") < most).drop("before")
        now = materialize(first.groupBy("component").applyInArrow(_decide, _DECIDED))
        decided = decided.unionByName(now)
        granted = first.join(now.filter("not (taken or negative or large)"), N)
        news = fold(granted, "holder", ["wanted", "set_a", "set_b"])
        holders = materialize(holders.join(news, "holder", "left").select(
            "holder", F.coalesce("wanted", "held").alias("held"), F.coalesce("set_a", "a").alias("a"), F.coalesce("set_b", "b").alias("b")))
        rest = placed.filter(F.col("before") >= most)
        left = materialize(_with_state(rest.select("_n", "holder", "wanted", "set_a", "set_b"), holders).join(rest.select(N, "component"), N))
    return materialize(decided.unionByName(left.groupBy("component").applyInArrow(_decide, _DECIDED)))


def settle_unordered(events: DataFrame, holders: DataFrame) -> DataFrame:
    """(_n, taken, repeated, negative, large) without an order, one event per row at most: what
    another row holds at the start is taken; of several events for one value none stands."""
    state = _with_state(events, holders)
    free = state.filter(F.col("wanted").isNotNull() & F.col("owner").isNull())
    repeated = free.groupBy("wanted").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    balance = F.coalesce("set_a", "a") - F.coalesce("set_b", "b")
    return materialize(state.join(repeated, "wanted", "left").select(
        "_n", F.col("owner").isNotNull().alias("taken"), F.coalesce("repeated", F.lit(False)).alias("repeated"),
        (balance < 0).alias("negative"), (balance > LARGEST).alias("large")))
