"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions (but for very many leaves).

Weights go down a tree (domain, language, source): each node divides its budget among its children by weight, and a
child never gets more than its subtree holds. What a child can't take goes to its siblings first, as long as they hold
more; only what the whole family can't take has gone to the parent's siblings before. Each leaf then takes the prefix
of its documents in seeded epochs that its budget pays for: every epoch is another order of all its documents.

Leaves may hold any number of documents: their order is a hash, and sums over slices of its range find the slice where
a budget ends. Only documents of those slices are sorted, so no task gathers a hot leaf. The tree has a row for each
leaf; up to MAX_LEAVES of them are budgeted by the driver, a larger tree level by level, a family in a task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

MAX_LEAVES = 1_000_000
SLICES = 1 << 12
Path = tuple


def fill(budget: int, children: dict, weights: dict) -> dict:
    """Whole tokens for each child: shares by weight, none above what it holds; shortages go to the others by weight.

    Fractions go to the children with the largest remainders (ties: in sorted order). Children of weight 0 get what no
    other can take, in equal shares.
    """
    out, left = dict.fromkeys(children, 0), min(budget, sum(children.values()))
    for positive in (True, False):
        open_ = {c for c in children if children[c] > 0 and (weights.get(c, 1.0) > 0) is positive}
        share = {c: weights.get(c, 1.0) if positive else 1.0 for c in open_}
        while open_ and left > 0:
            total = sum(share[c] for c in sorted(open_, key=str))
            full = {c for c in open_ if left * share[c] / total >= children[c]}
            if not full:
                exact = {c: left * share[c] / total for c in open_}
                out |= {c: int(exact[c]) for c in open_}
                rest = left - sum(out[c] for c in open_)
                for c in sorted(open_, key=lambda c: (-(exact[c] - int(exact[c])), str(c)))[:rest]:
                    out[c] += 1
                left = 0
                break
            out |= {c: children[c] for c in full}
            left -= sum(children[c] for c in full)
            open_ -= full
    return out


def budgets(held: dict[Path, int], total: int, weights: dict[Path, float], epochs: int) -> dict[Path, int]:
    """Budget of each leaf. held: tokens of each leaf's documents; a leaf can give epochs times as many. weights: of
    nodes, by their path from the root; 1 where none is stated."""
    capacity: dict[Path, int] = defaultdict(int)
    children: dict[Path, set] = defaultdict(set)
    for leaf, tokens in held.items():
        for depth in range(len(leaf) + 1):
            capacity[leaf[:depth]] += tokens * epochs
            if depth:
                children[leaf[: depth - 1]].add(leaf[:depth])
    out, level = {}, {(): min(total, capacity[()])}
    for _ in range(len(next(iter(held), ()))):
        level = {c: n for node, budget in level.items() for c, n in fill(budget, {c: capacity[c] for c in children[node]}, weights).items()}
    out.update(level)
    return {leaf: out.get(leaf, 0) for leaf in held}


def budget_table(leaves: DataFrame, names: list[str], total: int, weights: dict[Path, float], epochs: int) -> DataFrame:
    """The same as a table: names, tokens and budget of each leaf. leaves: names and tokens."""
    spark = leaves.sparkSession

    def sharing(depth: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def share(family: pd.DataFrame) -> pd.DataFrame:
            paths = list(zip(*(family[n] for n in names[:depth])))
            found = fill(int(family["budget"].iloc[0]), dict(zip(paths, map(int, family["capacity"]))), weights)
            return pd.DataFrame([(*p, n) for p, n in found.items()], columns=[*names[:depth], "budget"])

        return share

    level = None
    for depth in range(1, len(names) + 1):
        kids = leaves.groupBy(*names[:depth]).agg(F.sum(F.col("tokens") * epochs).alias("capacity"))
        above = names[: depth - 1]
        kids = kids.join(level, above) if above else kids.withColumn("budget", F.lit(total).cast("long"))
        schema = ", ".join(f"{n} string" for n in names[:depth]) + ", budget long"
        level = cut(kids.groupBy(*(above or [F.lit(0).alias("root")])).applyInPandas(sharing(depth), schema), "budgets")
    return level.join(leaves, names) if level is not None else spark.createDataFrame([], "tokens long, budget long")


def word_count(text: Column) -> Column:
    """Runs of other bytes than ASCII white space."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit("[^ \t-\r]+"))).cast("long")


def _order(seed: int, epoch: Column, doc_id: Column, text: Column) -> Column:
    """Place of a document in an epoch, from 0 to 2**60: the same for equal rows in every run."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.when(doc_id.isNull(), F.md5(F.coalesce(text, F.lit("")))).otherwise(F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _free(name: str, taken: list[str]) -> str:
    """The name, or with as many underscores after it as make it new (names differ by more than case)."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def added(docs: DataFrame) -> tuple[str, str, str]:
    """Names of the columns that a mixture adds to docs: mix_epoch, mix_tokens and mix_leaf unless docs has those."""
    epoch, tokens, leaf = (_free(n, docs.columns) for n in ("mix_epoch", "mix_tokens", "mix_leaf"))
    return epoch, tokens, leaf


def mix(
    docs: DataFrame,
    levels: list[tuple[str, Callable[[], Column]]],
    share: float | None = None,
    total: int | None = None,
    weights: dict[Path, float] | None = None,
    epochs: int = 1,
    seed: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
    tokens: Callable[[Column], Column] = word_count,
) -> DataFrame:
    """The rows of docs that the budgets pay for, with all their columns and mix_epoch, mix_tokens, mix_leaf (added last,
    with an underscore after them if docs has such a column).

    levels: names of the tree's levels from the root down and functions that give their columns; nulls are the node
    "none". total: tokens in all; share: of all tokens, if no total is given. A document is taken in an epoch if the
    tokens before it are below what its leaf's budget leaves for that epoch, so a leaf exceeds its budget by less than
    one document; documents without tokens cost nothing and come along if reached. Equal rows are next to each other.
    """
    spark = docs.sparkSession
    out_names, docs_names = added(docs), docs.columns
    # within, columns have names of their own, whatever docs has
    rows = docs.select(
        *(F.coalesce(c().cast("string"), F.lit("none")).alias(f"mix_{n}") for n, c in levels),
        tokens(F.col(text_column)).alias("mix_tokens"), F.col(id_column).alias("mix_id"), F.col(text_column).alias("mix_text"),
        *(F.col(f"`{c}`").alias(f"mix_column{i}") for i, c in enumerate(docs_names)),
    )
    names = [f"mix_{n}" for n, _ in levels]
    leaves = rows.groupBy(*names).agg(F.sum("mix_tokens").alias("tokens"))
    found = leaves.limit(MAX_LEAVES + 1).collect()
    few = len(found) <= MAX_LEAVES
    if not few:
        leaves = cut(leaves, "leaves")
    if total is None:
        whole = sum(r[-1] for r in found) if few else leaves.agg(F.sum("tokens")).first()[0]
        total = int(whole * (1.0 if share is None else share))
    # each epoch but a leaf's last is whole: only what the last one takes is a prefix
    if few:
        held = {tuple(r[:-1]): r[-1] for r in found}
        plan = budgets(held, total, weights or {}, epochs)
        paid = [(*leaf, e, min(n - e * held[leaf], held[leaf]), n - e * held[leaf] >= held[leaf]) for leaf, n in plan.items() for e in range(epochs) if n > e * held[leaf]]
        pays = F.broadcast(spark.createDataFrame(paid, ", ".join(f"{n} string" for n in names) + ", mix_epoch int, mix_budget long, mix_whole boolean"))
    else:
        plan = budget_table(leaves, names, total, weights or {}, epochs).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        left = F.col("budget") - F.col("mix_epoch") * F.col("tokens")
        pays = plan.where(left > 0).select(*names, "mix_epoch", F.least(left, "tokens").alias("mix_budget"), (left >= F.col("tokens")).alias("mix_whole"))
    taken = rows.join(pays, names)
    taken = taken.withColumn("mix_place", F.when(F.col("mix_whole"), F.lit(0)).otherwise(_order(seed, F.col("mix_epoch"), F.col("mix_id"), F.col("mix_text"))))
    taken = taken.withColumn("mix_slice", F.shiftright("mix_place", 60 - (SLICES.bit_length() - 1)).cast("int"))
    key = [*names, "mix_epoch"]
    sums = taken.where("not mix_whole").groupBy(*key, "mix_slice").agg(F.sum("mix_tokens").alias("t"), F.first("mix_budget").alias("b"))
    before = F.sum("t").over(Window.partitionBy(*key).orderBy("mix_slice")) - F.col("t")
    edge = sums.select(*key, "mix_slice", "t", "b", before.alias("before")).where("before < b").groupBy(*key).agg(F.max_by(F.struct("mix_slice", "before", "t", "b"), "mix_slice").alias("e"))
    edge = edge.select(*key, F.col("e.mix_slice").alias("mix_edge"), (F.col("e.b") - F.col("e.before")).alias("mix_left"))
    # a row for each leaf and epoch
    marked = taken.join(F.broadcast(edge) if few else edge, key, "left")
    sure = marked.where("mix_whole or mix_slice < mix_edge")
    last = marked.where("not mix_whole and mix_slice = mix_edge")
    run = Window.partitionBy(*key).orderBy("mix_place", "mix_id", "mix_text").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("mix_before", F.coalesce(F.sum("mix_tokens").over(run), F.lit(0))).where("mix_before < mix_left").drop("mix_before")
    out = sure.unionByName(last)
    epoch, count, leaf = out_names
    return out.select(*(F.col(f"mix_column{i}").alias(c) for i, c in enumerate(docs_names)), F.col("mix_epoch").alias(epoch), F.col("mix_tokens").alias(count), F.concat_ws("/", *names).alias(leaf))
