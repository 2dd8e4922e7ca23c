"""Mixing sources to target weights, in DataFrame operations alone.

A tree of levels (say domain, language, source) gets a token budget at its root.  Each level
hands its budget down in proportion to weights; what a child cannot use, because its documents
times the allowed epochs are too few, goes to its siblings first, and only a whole subtree's
shortage reaches the level above.  Each leaf then takes its documents in a seeded order, epoch
after epoch, until its budget is met.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm.frames import fresh, sized, written

EXACT = "decimal(38,0)"
#: Aim for this many rows in a step of a leaf's order.
STEP_ROWS = 4096


def word_count(text: str) -> Column:
    """Words of a text, as what ASCII white space separates; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _fill(nodes: DataFrame, parents: list[str], order: list[str]) -> DataFrame:
    """Adds ``budget``: the parent's budget ``given`` shared by ``weight``, no child beyond
    its ``most``; whole tokens, rounded down.

    Children are filled in the order of most / weight.  A child is full if filling all to its
    ratio stays within the budget; the others share what the full ones leave.  Products are
    exact decimals.
    """
    most, weight = F.col("most").cast(EXACT), F.col("weight").cast(EXACT)
    ratio = F.when(F.col("weight") > 0, F.col("most") / F.col("weight"))
    by = Window.partitionBy(*parents) if parents else Window.partitionBy()
    line = by.orderBy(ratio.asc_nulls_last(), *order)
    nodes = nodes.withColumns(
        {
            "upto": F.sum(most).over(line.rowsBetween(Window.unboundedPreceding, 0)),
            "rest": F.sum(weight).over(line.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    given = F.col("given").cast(EXACT)
    needed = (F.col("upto") - most) * weight + most * F.col("rest")
    nodes = nodes.withColumn("full", (F.col("weight") > 0) & (needed <= given * weight))
    left = given - F.sum(F.when(F.col("full"), most).otherwise(F.lit(0))).over(by)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(weight)).over(by)
    share = F.when(open_weight > 0, F.floor(left * weight / open_weight)).otherwise(F.lit(0))
    share = F.least(share.cast("long"), F.col("most"))
    budget = F.when(F.col("full"), F.col("most")).otherwise(share)
    return nodes.withColumn("budget", budget).drop("upto", "rest", "full", "given", "most", "weight")


def leaf_budgets(
    leaves: DataFrame, levels: Sequence[str], weights: Sequence[Column], share: tuple[int, int], epochs: int
) -> DataFrame:
    """The token budget of each leaf of ``leaves`` (levels, tokens), which has a row per leaf.

    ``weights`` has a whole-number expression over the levels for each level; zero or null
    gets nothing, and what lies below such a node is no capacity of the nodes above it.  The
    root's budget is ``share`` (numerator, denominator) of all tokens.
    """
    levels = list(levels)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    whole = [F.greatest(F.coalesce(w.cast("long"), F.lit(0)), F.lit(0)) for w in weights]
    reached = F.lit(True)
    for w in whole:
        reached = reached & (w > 0)
    usable = F.when(reached, F.col("tokens")).otherwise(F.lit(0))
    given = None
    for depth in range(1, len(levels) + 1):
        nodes = leaves.groupBy(*levels[:depth]).agg((F.sum(usable) * epochs).alias("most"))
        nodes = nodes.withColumn("weight", whole[depth - 1])
        parents = levels[: depth - 1]
        if given is None:
            nodes = nodes.withColumn("given", F.lit(total * share[0] // share[1]).cast("long"))
        else:
            nodes = nodes.join(given.withColumnRenamed("budget", "given"), parents)
        given = _fill(nodes, parents, [levels[depth - 1]])
    return leaves.join(given, levels)


def _selection(
    docs: DataFrame,
    levels: Sequence[tuple[str, Column]],
    weights: Sequence[Column],
    tokens: Column,
    share: tuple[int, int],
    epochs: int,
    seed: int,
    id_col: str,
) -> DataFrame:
    """One row per leaf: levels, budget, whole epochs, and the key and id of the last row that
    the leaf takes in the epoch after those (null: none)."""
    names = [n for n, _ in levels]
    rows = docs.select(
        *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels],
        F.col(id_col).alias("doc_id"),
        F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(0)).cast("long").alias("tokens"),
    )
    rows = written(rows, "mix-rows")
    leaves = rows.groupBy(*names).agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")
    )
    leaves = written(leaves, "mix-leaves")
    budgets = leaf_budgets(leaves, names, weights, share, epochs)
    some = F.col("tokens") > 0
    whole = F.when(some, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    digits = F.ceil(F.log(16.0, F.greatest(F.col("rows") / STEP_ROWS, F.lit(1.0))))
    leaves = written(
        budgets.withColumns(
            {
                "whole": whole,
                "part": F.when(some, F.col("budget") - whole * F.col("tokens")).otherwise(F.lit(0)),
                "digits": digits.cast("int") + 1,
            }
        ),
        "mix-budgets",
    )
    # the leaf's order in steps of a few thousand rows: sum the steps, then look into one
    open_leaves = leaves.filter("part > 0").select(*names, "whole", "part", "digits")
    keyed = rows.join(sized(open_leaves), names)
    keyed = keyed.withColumn("key", order_key(F.col("doc_id"), F.col("whole"), seed))
    keyed = keyed.withColumn("step", F.expr("substring(key, 1, digits)"))
    steps = keyed.groupBy(*names, "step").agg(F.sum("tokens").alias("sum"), F.first("part").alias("part"))
    line = Window.partitionBy(*names).orderBy("step")
    before = F.coalesce(F.sum("sum").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = (
        steps.withColumn("before", before)
        .filter("before < part")
        .groupBy(*names)
        .agg(F.max(F.struct("step", "before")).alias("last"))
        .select(*names, F.col("last.step").alias("step"), F.col("last.before").alias("before"))
    )
    inside = keyed.join(sized(written(last, "mix-steps")), [*names, "step"])
    inside = inside.groupBy(*names, "key", "doc_id").agg(
        F.sum("tokens").alias("tokens"), F.first("part").alias("part"), F.first("before").alias("before")
    )
    line = Window.partitionBy(*names).orderBy("key", "doc_id")
    upto = F.coalesce(F.sum("tokens").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = (
        inside.filter(F.col("before") + F.lit(0) < F.col("part"))
        .withColumn("upto", F.col("before") + upto)
        .filter("upto < part")
        .groupBy(*names)
        .agg(F.max(F.struct("key", "doc_id")).alias("cut"))
    )
    return written(leaves.join(cuts, names, "left").select(*names, "budget", "whole", "cut"), "mix-cuts")


def order_key(doc_id: Column, epoch: Column, seed: int) -> Column:
    """Where a document stands in its leaf's order of one epoch."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), text))


def mix(
    docs: DataFrame,
    levels: Sequence[tuple[str, Column]],
    weights: Sequence[Column],
    tokens: Column,
    share: tuple[int, int] = (1, 1),
    epochs: int = 1,
    seed: int = 0,
    id_col: str = "doc_id",
) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with the columns ``docs`` has and then the
    levels' names, ``epoch`` and ``leaf_budget`` (names that ``docs`` has already get a
    trailing underscore).

    ``levels`` are (name, expression over ``docs``) from the root's children to the leaves,
    ``weights`` whole numbers as expressions over the levels' names.  An epoch that the leaf's
    budget covers is taken whole; of the next, a document is taken if those before it have not
    met the budget, so a leaf exceeds its budget by less than its last document.

    Null levels are the empty string, null or negative tokens none; a document of a leaf
    without tokens is never taken.  Rows that repeat an id in a leaf are taken together; an
    empty table gives an empty result.
    """
    names = [n for n, _ in levels]
    leaves = _selection(docs, levels, weights, tokens, share, epochs, seed, id_col)
    own, out = {}, list(docs.columns)
    for n in (*names, "epoch", "leaf_budget", "whole", "cut", "key"):
        own[n] = fresh(out, n)
        out.append(own[n])
    rows = docs.withColumns(
        {own[n]: F.coalesce(c.cast("string"), F.lit("")) for n, c in levels}
    )
    leaves = leaves.withColumnsRenamed({"budget": "leaf_budget"})
    leaves = leaves.withColumnsRenamed({n: own[n] for n in leaves.columns})
    rows = rows.join(sized(leaves), [own[n] for n in names])
    rows = rows.withColumn(
        own["epoch"], F.explode(F.sequence(F.lit(0).cast("long"), F.col(own["whole"])))
    )
    key = order_key(docs[id_col], F.col(own["epoch"]), seed)
    at = F.struct(key.alias("key"), docs[id_col].alias("doc_id"))
    taken = (F.col(own["epoch"]) < F.col(own["whole"])) | F.coalesce(at <= F.col(own["cut"]), F.lit(False))
    return rows.filter(taken).select(
        *[docs[c] for c in docs.columns], *[own[n] for n in names], own["epoch"], own["leaf_budget"]
    )
