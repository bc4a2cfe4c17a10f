"""A mix of sources to target weights: budgets down a tree, token prefixes of seeded epochs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.llm.common import fresh, settled, text_or_empty
from cohortlake.llm.decontaminate import when_small

NONE = "(none)"
ROOT = "_root"
EXACT = "decimal(38,0)"


@dataclass(frozen=True)
class Level:
    """A level of the tree: the label of a document on it, and the weight of a label among
    its siblings, a whole number (null or negative: 0, no share)."""

    name: str
    label: Column
    weight: Column


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def _shares(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Split each parent's budget over its children by weight, none beyond its capacity.

    What a full child leaves over goes to its siblings by their weights, so shortages are
    made good among siblings first; a budget is never more than its node's capacity, so
    what siblings cannot take has already gone elsewhere above.  Children fill up in the
    order of capacity by weight: one does if the level at which all that are left would
    stand is no lower than that.  Whole tokens that rounding leaves go one each to the
    greatest fractions, then by label.
    """
    by = Window.partitionBy(*parent)
    order = by.orderBy((F.col("cap").cast("double") / F.col("weight").cast("double")).asc(), F.col(name).asc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(EXACT)
    ranked = children.withColumns(
        {
            "cap_before": F.coalesce(F.sum("cap").over(before), zero).cast(EXACT),
            "weight_left": (F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(before), zero)).cast(EXACT),
        }
    )
    full = F.col("cap") * F.col("weight_left") <= (F.col("parent_budget") - F.col("cap_before")) * F.col("weight")
    ranked = ranked.withColumn("full", full)
    left = F.col("parent_budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), zero)
    rest = F.sum(F.when(~F.col("full"), F.col("weight"))).over(by)
    ranked = ranked.withColumns({"left": left.cast(EXACT), "rest": rest.cast(EXACT)})
    product = (F.col("left") * F.col("weight")).cast(EXACT)
    part = F.when(F.col("full"), F.col("cap")).otherwise((product - product % F.col("rest")) / F.col("rest"))
    fraction = F.when(F.col("full"), zero).otherwise(product % F.col("rest"))
    ranked = ranked.withColumns({"part": part.cast(EXACT), "fraction": fraction.cast(EXACT)})
    over = F.col("parent_budget") - F.sum("part").over(by)
    place = F.row_number().over(by.orderBy(F.col("full").asc(), F.col("fraction").desc(), F.col(name).asc()))
    return ranked.withColumn("budget", (F.col("part") + F.when(place <= over, 1).otherwise(0)).cast(EXACT))


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], budget: Column, max_epochs: int) -> DataFrame:
    """``levels, tokens, budget`` of every leaf, from its tokens and the weight of its label
    on each level (``weight_<level>``).

    ``budget`` is an expression over ``total``, the tokens of all leaves.  A leaf holds its
    tokens ``max_epochs`` times.  The tree's nodes are counted rows; a node's children are
    ranked in a window of their own.
    """
    nodes = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast(EXACT))
    for name in levels:
        weight = F.greatest(F.coalesce(f"weight_{name}", F.lit(0)), F.lit(0)).cast(EXACT)
        nodes = nodes.withColumn(f"weight_{name}", weight).withColumn(
            "cap", F.when(F.col(f"weight_{name}") > 0, F.col("cap")).otherwise(F.lit(0)).cast(EXACT)
        )
    nodes = nodes.withColumn(ROOT, F.lit(0))
    total = nodes.agg(F.sum("tokens").alias("total"), F.sum("cap").alias("most"))
    whole = total.select(F.least(budget.cast(EXACT), F.col("most")).cast(EXACT)).scalar()
    budgets, parent = None, [ROOT]
    for depth, name in enumerate(levels):
        path = [ROOT, *levels[: depth + 1]]
        children = nodes.groupBy(*path).agg(
            F.sum("cap").cast(EXACT).alias("cap"), F.max(f"weight_{name}").alias("weight")
        ).filter("cap > 0")
        held = children.withColumn("parent_budget", whole) if budgets is None else children.join(budgets, parent)
        budgets = _shares(held, parent, name).select(*path, F.col("budget").alias("parent_budget"))
        parent = path
    budgets = budgets.drop(ROOT).withColumnRenamed("parent_budget", "budget")
    found = leaves.select(*levels, "tokens").join(budgets, list(levels), "left")
    return found.withColumn("budget", F.coalesce("budget", F.lit(0)).cast("bigint"))


def _boundary(rows: DataFrame, names: list[str], bucket: str, start: str) -> DataFrame:
    """Per leaf the bucket in which the running sum of tokens reaches ``rest``, and the sum
    before it.  Buckets are summed first; a leaf has 4,096 of them at most."""
    sums = rows.groupBy(*names, bucket).agg(F.sum("n").alias("s"), F.max("rest").alias("rest"), F.max(start).alias("a"))
    running = Window.partitionBy(*names).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.col("a") + F.coalesce(F.sum("s").over(running), F.lit(0)))
    reached = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("s") >= F.col("rest"))
    return sums.filter(reached).select(*names, F.col(bucket).alias(f"cut_{bucket}"), F.col("before").alias(f"before_{bucket}"))


def mix(
    docs: DataFrame, levels: Sequence[Level], budget: Column, id_col: str = "doc_id", text_col: str = "text",
    seed: int = 0, max_epochs: int = 4, tokens: Column | None = None, key: bool = False,
) -> DataFrame:
    """``id_col``, the level names, ``epoch, n_tokens, taken``: a row per document and epoch
    that gives tokens to the mix.

    Tokens are words (or the ``tokens`` column).  Leaves of the tree of levels get budgets
    by weight.  A leaf's budget is whole epochs of its documents and a last one that ends
    after as many tokens as are left: its documents go by a digest of seed, epoch, id and
    text, and the one across the end gives its first ``taken`` tokens.

    Null labels form the leaf ``(none)``; null and empty texts have no tokens and give no
    rows; rows that repeat an id are documents of their own, and wholly equal rows take
    equal places.  A budget above what the leaves hold in ``max_epochs`` is cut to that; a
    null or negative one is 0.  No documents give no rows.  With ``key`` a digest of id and
    text is added, to find the texts again.
    """
    names = [x.name for x in levels]
    if {"id", "n", "tokens", "budget", "epoch", "taken", "n_tokens", id_col, text_col} & set(names):
        raise ValueError("a level has the name of a column of the result")
    size = count_words(text_or_empty(text_col)) if tokens is None else tokens
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.md5(text.cast("binary")).alias("digest"),
        F.xxhash64(id_col, text).alias("row_key"),
        F.coalesce(size, F.lit(0)).cast("bigint").alias("n"),
        *[F.coalesce(x.label.cast("string"), F.lit(NONE)).alias(x.name) for x in levels],
        *[x.weight.alias(f"weight_{x.name}") for x in levels],
    ).filter("n > 0")
    rows = settled(rows)
    leaves = rows.groupBy(*names).agg(
        F.sum("n").alias("tokens"), *[F.max(f"weight_{x}").alias(f"weight_{x}") for x in names]
    )
    asked = F.greatest(F.coalesce(budget, F.lit(0)), F.lit(0))
    plan = leaf_budgets(leaves, names, asked, max_epochs).filter("budget > 0")
    whole = F.floor(F.col("budget").cast(EXACT) / F.col("tokens").cast(EXACT)).cast("bigint")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    plan = when_small(plan.select(*names, "whole", "rest"))
    placed = rows.drop(*[f"weight_{x}" for x in names]).join(plan, names)
    text_key = F.concat_ws("|", F.lit(str(seed)), F.col("whole") + 1, F.coalesce(F.col("id").cast("string"), F.lit("")), "digest")
    # 60 bits of the digest, in two steps of 12 and the rest.
    placed = placed.withColumn("h", F.conv(F.substring(F.md5(text_key.cast("binary")), 1, 15), 16, 10).cast("bigint"))
    placed = placed.withColumns({"b1": F.shiftright("h", 48), "b2": F.shiftright("h", 36), "zero": F.lit(0).cast("bigint")})
    first = when_small(_boundary(placed.filter("rest > 0"), names, "b1", "zero"))
    placed = placed.join(first, names, "left")
    second = when_small(_boundary(placed.filter("b1 = cut_b1"), names, "b2", "before_b1"))
    placed = placed.join(second, names, "left")
    # What shares both steps with the end of the prefix: one in 16 million of a leaf's rows.
    inside = F.coalesce(F.col("b2") == F.col("cut_b2"), F.lit(False))
    running = Window.partitionBy(*names).orderBy("h", "n").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.filter(inside).withColumn("sum", F.col("before_b2") + F.coalesce(F.sum("n").over(running), F.lit(0)))
    edge = edge.withColumn("last", F.greatest(F.lit(0), F.least(F.col("n"), F.col("rest") - F.col("sum")))).drop("sum")
    clear = placed.filter(~inside).withColumn(
        "last", F.when((F.col("rest") > 0) & (F.col("b2") < F.col("cut_b2")), F.col("n")).otherwise(F.lit(0))
    )
    taken = clear.unionByName(edge)
    epochs = F.concat(
        F.when(F.col("whole") > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), "whole"), lambda e: F.struct(e.alias("epoch"), F.col("n").alias("taken")))).otherwise(F.array()),
        F.when(F.col("last") > 0, F.array(F.struct((F.col("whole") + 1).alias("epoch"), F.col("last").cast("bigint").alias("taken")))).otherwise(F.array()),
    )
    out = taken.withColumn("e", F.explode(epochs))
    columns = [F.col("id").alias(id_col), *names, F.col("e.epoch").alias("epoch"), F.col("n").alias("n_tokens"), F.col("e.taken").alias("taken")]
    return out.select(*columns, *([F.col("row_key").alias("key")] if key else []))


def mixed_texts(docs: DataFrame, levels: Sequence[Level], budget: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``mix`` with the text each gives: whole, or its first ``taken`` words as
    they stand there, without white space after the last.

    Wholly equal rows of ``docs`` give as many rows of the mix as they take."""
    chosen = mix(docs, levels, budget, id_col, text_col, key=True, **options)
    key, text = fresh(chosen, "text_key", "given")
    texts = docs.select(F.xxhash64(id_col, text_or_empty(text_col)).alias(key), F.col(text_col).alias(text)).dropDuplicates([key])
    rows = chosen.join(texts, F.col("key") == F.col(key))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    part = F.array_join(F.slice(words, 1, F.col("taken").cast("int")), "")
    part = F.regexp_replace(part, r"[\x20\x09-\x0D]+\z", "")
    given = F.when(F.col("taken") >= F.col("n_tokens"), F.col(text)).otherwise(part)
    return rows.withColumn(text_col, given).drop("key", key, *([text] if text != text_col else []))
