"""Keys that are only partly known: rows match where their exact keys are equal and every loose key is equal or blank on one side.

Two rows with known sets ``A`` and ``B`` of loose keys match if they agree on what both know. So a table is indexed under every
subset of what its rows know: a row stands there once a subset, with the pattern of all it knows. A row that looks for partners asks once a
pattern, for the subset that both know. All questions are equality joins against least values, which are pre-aggregated: no pair
of rows is ever made, and a key that very many rows share costs no more than its rows. Null keys match nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import dropped, written


def wildcard(a, b) -> Column:
    """Blank matches anything."""
    return (a == "") | (b == "") | (a == b)


def _known(loose: list[str]) -> Column:
    """A bit for each loose key that is not blank."""
    return reduce(lambda a, x: a + x, (F.when(F.col(c) != "", 1 << i).otherwise(0) for i, c in enumerate(loose)), F.lit(0))


def _shared(mask, loose: list[str]) -> list[Column]:
    """The loose keys of ``mask``; the others blank."""
    return [F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.col(c)).otherwise("").alias(f"_v{i}") for i, c in enumerate(loose)]


def _whole(keys: list[str]) -> Column:
    return reduce(lambda a, c: a & F.col(c).isNotNull(), keys, F.lit(True))


def least_index(rows: DataFrame, exact: list[str], loose: list[str], least: dict[str, Column]) -> DataFrame:
    """``rows`` under all subsets of what they know: ``exact, _pattern, _mask, _v0.., `` and the least of each value."""
    masks = F.filter(F.sequence(F.lit(0), F.lit((1 << len(loose)) - 1)), lambda m: m.bitwiseAND(F.col("_pattern")) == m)
    at = rows.where(_whole(exact + loose)).withColumns({f"_l{i}": c for i, c in enumerate(least.values())}).withColumn("_pattern", _known(loose)).withColumn("_mask", F.explode(masks))
    keys = [*exact, "_pattern", "_mask", *[f"_v{i}" for i in range(len(loose))]]
    return at.select(*exact, "_pattern", "_mask", *_shared(F.col("_mask"), loose), *[f"_l{i}" for i in range(len(least))]).groupBy(*keys).agg(*[F.min(f"_l{i}").alias(n) for i, n in enumerate(least)])


def least_match(rows: DataFrame, index: DataFrame, exact: list[str], loose: list[str], values: list[str], keep: list[str]) -> DataFrame:
    """``rows(keep)`` with the least ``values`` of the index's rows that match; null for none. ``keep`` must name a row."""
    every = F.sequence(F.lit(0), F.lit((1 << len(loose)) - 1))
    own = rows.where(_whole(exact + loose)).withColumn("_own", _known(loose)).withColumn("_pattern", F.explode(every)).withColumn("_mask", F.col("_own").bitwiseAND(F.col("_pattern")))
    asked = own.select(*keep, *exact, "_pattern", "_mask", *_shared(F.col("_mask"), loose))
    hit = asked.join(index, [*exact, "_pattern", "_mask", *[f"_v{i}" for i in range(len(loose))]])
    return hit.groupBy(*keep).agg(*[F.min(v).alias(v) for v in values])


def settle_greedy(firsts: DataFrame, exact: list[str], loose: list[str]) -> DataFrame:
    """Representatives of ``firsts(exact, loose, _keep, o)``, ``o`` being an order no two rows share: a row represents if it is kept by force or no
    representative before it matches.

    All rows whose earlier partners are settled are settled in one round, so rounds number the longest chain of
    rows that wait for each other, which the patterns of blanks keep short, not the rows of a key."""
    cols = [*exact, *loose, "_keep", "o"]
    known = written(firsts.where("_keep").select(*cols), "represent")
    waiting = written(firsts.where("not _keep").select(*cols), "waiting")
    pieces, spent = [known], []
    while waiting.limit(1).count():
        index = least_index(reduce(DataFrame.union, pieces).withColumn("_w", F.lit(False)).union(waiting.withColumn("_w", F.lit(True))), exact, loose, {"rep": F.when(~F.col("_w"), F.col("o")), "wait": F.when(F.col("_w"), F.col("o"))})
        asked = waiting.join(least_match(waiting, index, exact, loose, ["rep", "wait"], ["o"]), "o", "left")
        # one that still waits before it may yet represent; a representative before it settles it at once
        covered = F.coalesce(F.col("rep") < F.col("o"), F.lit(False))
        state = F.when(covered, "covered").when(F.coalesce(F.col("wait") < F.col("o"), F.lit(False)), "waits").otherwise("represents")
        seen = written(asked.withColumn("_state", state).select(*cols, "_state"), "round")
        pieces.append(seen.where("_state = 'represents'").select(*cols))
        spent.append(waiting)
        waiting = written(seen.where("_state = 'waits'").select(*cols), "waiting")
    dropped(waiting, *spent)
    return reduce(DataFrame.union, pieces)
