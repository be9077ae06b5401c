"""Mixing sources to target weights: hierarchical token budgets, then a seeded token-prefix of each leaf.

The tree is domain, language, source; leaves are the (domain, language, source) combinations that hold tokens.

Budget. A node's budget is dealt to its children in proportion to their weights. A child takes at most its capacity
(``max_epochs`` times the tokens below it); what it cannot take goes to its siblings by their weights,
and only what all children together cannot take stays with the parent's own siblings. That is so because
a parent is dealt no more than its whole capacity in the first place. Budgets are whole tokens, rounded down.

Selection. A leaf's documents are put in a seeded order, another one for each epoch. A budget of several times the
leaf's tokens takes whole epochs first; the last one is cut to the longest prefix that fits.

No leaf is sorted or summed in one task. Order keys are md5 digests, so their first digits deal a leaf evenly over
4,096 slices; the slices' sums find the slice with the cut, and only its few documents are ordered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, broadcast_if_small, fresh, stored

SLICE_DIGITS = 3
LEVELS = ("domain", "lang", "source")


def token_count(text: Column) -> Column:
    """Words between blanks; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string")).cast("binary"))


def _weight(node: Column, weights: dict[str, int], default: int) -> Column:
    chosen = reduce(lambda so_far, kv: so_far.when(node == kv[0], kv[1]), weights.items(), F.when(F.lit(False), 0))
    return chosen.otherwise(default).cast("long")


def deal(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Deal ``budget`` to the children of each parent by ``weight``, no child over its ``capacity``.

    Children in order of capacity per weight: one is filled as long as its share of what is left, by weight, reaches its
    capacity. The others share the rest. All sums are of whole numbers; tokens times weights must stay below 2**63.
    """
    by_parent = Window.partitionBy(*parent)
    filling = by_parent.orderBy(F.col("capacity") / F.col("weight"), child).rowsBetween(Window.unboundedPreceding, -1)
    sums = children.where("weight > 0").withColumns(
        {
            "_spent": F.coalesce(F.sum("capacity").over(filling), F.lit(0)),
            "_heavier": F.sum("weight").over(by_parent) - F.coalesce(F.sum("weight").over(filling), F.lit(0)),
        }
    )
    full = sums.withColumn("_full", F.expr("(budget - _spent) * weight >= capacity * _heavier"))
    left = full.withColumns(
        {
            "_rest": F.col("budget") - F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(0)).over(by_parent),
            "_sharers": F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(by_parent),
        }
    )
    share = F.expr("_rest * weight div _sharers")
    return left.withColumn("budget", F.when(F.col("_full"), F.col("capacity")).otherwise(F.least("capacity", share))).drop(
        "_spent", "_heavier", "_full", "_rest", "_sharers"
    )


def budgets(
    leaves: DataFrame, total: int, weights: dict[str, dict[str, int]], default_weight: int = 1, max_epochs: int = 2
) -> DataFrame:
    """(domain, lang, source, tokens, budget) per leaf.

    ``leaves`` has one row (domain, lang, source, tokens) per leaf. ``weights`` maps a level's name to the weight of each
    node name; others get ``default_weight``. A weight of 0 deals nothing.
    """
    nodes = leaves.where("tokens > 0").withColumn("capacity", F.col("tokens") * max_epochs)
    dealt = None
    for depth, level in enumerate(LEVELS):
        path, parent = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        level_nodes = nodes.groupBy(*path).agg(F.sum("capacity").cast("long").alias("capacity"), F.sum("tokens").alias("tokens"))
        weighted = level_nodes.withColumn("weight", _weight(F.col(level), weights.get(level, {}), default_weight))
        if dealt is None:
            dealt = deal(weighted.withColumns({"budget": F.lit(int(total)).cast("long"), "_top": F.lit(0)}), ["_top"], level).drop("_top")
        else:
            dealt = deal(weighted.join(dealt.select(*parent, "budget"), parent), parent, level)
    return dealt.select(*LEVELS, "tokens", "budget")


def choose(
    sized: DataFrame,
    share: float,
    weights: dict[str, dict[str, int]],
    seed: int = 42,
    default_weight: int = 1,
    max_epochs: int = 2,
) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, epoch): a row per document and epoch in which it is taken.

    ``sized`` has the first five columns.
    ``share`` is the token budget as a share of all tokens. Names must not be null.
    """
    sized = stored(sized, "sized")
    leaves = stored(sized.groupBy(*LEVELS).agg(F.sum("tokens").cast("long").alias("tokens")), "leaves")
    everything = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = budgets(leaves, int(everything * share), weights, default_weight, max_epochs).where("budget > 0")
    plan = stored(
        plan.withColumn("whole", F.expr("budget div tokens")).withColumn("rest", F.expr("budget - whole * tokens")), "budgets"
    )
    small = broadcast_if_small(plan.select(*LEVELS, "whole", "rest"))
    taken = sized.join(small, list(LEVELS))
    # only the epoch that is cut needs an order
    last = taken.where("rest > 0").withColumn("key", order_key(seed, F.col("whole"), F.col("doc_id")))
    last = last.withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    before = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        last.groupBy(*LEVELS, "slice", "rest")
        .agg(F.sum("tokens").alias("n"))
        .withColumn("carried", F.coalesce(F.sum("n").over(before), F.lit(0)))
    )
    # the slice in which the budget runs out; there is one, as the rest is less than the leaf's tokens
    cut = stored(sums.where("carried <= rest and carried + n > rest").select(*LEVELS, "slice", "carried"), "cuts")
    in_slice = Window.partitionBy(*LEVELS, "slice").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    cut = broadcast_if_small(cut)
    whole_slices = last.join(cut.withColumnRenamed("slice", "cut"), list(LEVELS)).where("slice < cut")
    in_cut = (
        last.join(cut, [*LEVELS, "slice"])
        .withColumn("upto", F.col("carried") + F.sum("tokens").over(in_slice))
        .where("upto <= rest")
    )
    out = ["doc_id", *LEVELS, "tokens"]
    first_epochs = taken.where("whole > 0").select(*out, F.explode(F.expr("sequence(0L, whole - 1)")).alias("epoch"))
    in_prefix = [*out, F.col("whole").alias("epoch")]
    return first_epochs.unionByName(whole_slices.select(*in_prefix)).unionByName(in_cut.select(*in_prefix))


def sized_documents(docs: DataFrame, domain: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, domain, lang, source, tokens) for :func:`choose`.

    A null language or source is the node ``unknown``. Rows without a doc_id or without a word are left out: they hold no
    tokens to take. Rows that share a doc_id are taken together as one document of their summed tokens, filed under the least
    names among them.
    """
    named = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(domain, F.lit("unknown")).alias("domain"),
        F.coalesce(F.col("lang"), F.lit("unknown")).alias("lang"),
        F.coalesce(F.col("source"), F.lit("unknown")).alias("source"),
        token_count(F.col(text)).alias("tokens"),
    )
    return (
        named.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min(F.struct("domain", "lang", "source")).alias("leaf"), F.sum("tokens").alias("tokens"))
        .where("tokens > 0")
        .select("doc_id", "leaf.*", "tokens")
    )


def mixed(
    docs: DataFrame, domain: Column, share: float, weights: dict[str, dict[str, int]], seed: int = 42, max_epochs: int = 2
) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, source, ...) that are taken, one per epoch, with ``mix_epoch`` from 0 on.

    A column of that name in ``docs`` stays; the new one then gets underscores before its name.
    """
    taken_id, epoch = fresh("taken_id", docs), fresh("mix_epoch", docs)
    taken = choose(sized_documents(docs, domain), share, weights, seed, max_epochs=max_epochs)
    taken = taken.select(F.col("doc_id").alias(taken_id), F.col("epoch").alias(epoch))
    return docs.join(taken, docs["doc_id"] == F.col(taken_id)).select(*docs.columns, epoch)
