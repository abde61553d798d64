"""Mixing sources to target weights: budgets through a tree of domains, languages and sources.

``quotas`` splits a token budget over the tree. Each node asks for its weight's part of its parent's
budget and can hold its documents' words times ``epochs``. What a node cannot hold goes to its
siblings by their weights, and only if the whole subtree is full to the parent's siblings: budgets go
from the root down, each level filled by weight up to the subtrees' capacities. All numbers are
integers; a level's last tokens go one each to the first unfilled siblings by name.

``copies`` turns a leaf's quota into documents: as many whole epochs as fit, then the first documents
of one more epoch, in the order of a seeded hash of epoch and id, until the quota is reached (the
document that reaches it is taken whole). The end of that prefix is found from sums over hash
digits, three times one in 4096: no leaf is sorted or gathered, also if it holds a third of all rows.

Only column functions are used. Unlisted nodes weigh ``DEFAULT_WEIGHT``; a node of weight 0 gets
nothing. A null language or source is a node of its own, named by an empty string. Null texts have
no tokens; documents without tokens ride along if their place is in the prefix. Rows that repeat an id
share a place and are taken together. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.runtime import cut

DEFAULT_WEIGHT = 1
SEED = 11
LEAF = ["domain", "lang", "source"]
_DIGITS = 3
_SPACE = r"[ \t-\r]"


def count_words(text: Column) -> Column:
    """Runs of characters other than blank and 0x09-0x0D; 0 for null."""
    text = F.coalesce(text, F.lit(""))
    ends = F.substring(text, 1, 1).rlike(_SPACE).cast("int") + F.right(text, F.lit(1)).rlike(_SPACE).cast("int")
    return F.when(text == "", 0).otherwise(F.size(F.split(text, f"{_SPACE}+")) - ends).cast("long")


def source_domain(domains: int = 4) -> Column:
    """Domains for the given tables: the number in a source's name, by residue."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)", 1).try_cast("long")
    return F.concat(F.lit("domain"), F.coalesce(F.pmod(number, F.lit(domains)), F.lit(0)).cast("string"))


def _place(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _weight(names: Column, weights: dict[str, int]) -> Column:
    if not weights:
        return F.lit(DEFAULT_WEIGHT).cast("long")
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.element_at(table, names), F.lit(DEFAULT_WEIGHT)).cast("long")


def _fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``got``: the parts of ``budget`` that siblings of ``weight`` and ``capacity`` get."""
    siblings = Window.partitionBy(*(parent or [F.lit(0)]))
    by_need = siblings.orderBy(F.try_divide("capacity", "weight").asc_nulls_last(), name)
    so_far = by_need.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nodes = nodes.withColumn("budget", F.least("budget", F.sum(F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0)).over(siblings)))
    nodes = nodes.withColumns(
        {"held": F.sum("capacity").over(so_far), "above": F.sum("weight").over(siblings) - F.sum("weight").over(so_far)}
    )
    full = (F.col("weight") > 0) & ((F.col("budget") - F.col("held")) * F.col("weight") >= F.col("capacity") * F.col("above"))
    nodes = nodes.withColumn("full", full)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(siblings)
    rest = F.col("budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(siblings)
    nodes = nodes.withColumns({"open_weight": open_weight, "rest": rest})
    part = F.expr("case when full or weight = 0 then 0 else rest * weight div open_weight end")
    nodes = nodes.withColumn("part", part)
    order = siblings.orderBy((F.col("full") | (F.col("weight") == 0)).cast("int"), name)
    nodes = nodes.withColumns({"spare": F.col("rest") - F.sum("part").over(siblings), "turn": F.row_number().over(order)})
    got = F.when(F.col("full"), F.col("capacity")).when(F.col("weight") == 0, F.lit(0)).otherwise(
        F.col("part") + (F.col("turn") <= F.col("spare")).cast("long")
    )
    return nodes.withColumn("got", got.cast("long"))


def quotas(counted: DataFrame, budget_percent: int, epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """(domain, lang, source, tokens, quota) per leaf of ``counted`` (domain, lang, source, n_tokens).

    The budget is a percentage of all tokens; ``weights`` has names and integers per level.
    """
    leaves = cut(counted.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")))
    leaves = leaves.withColumn("capacity", F.col("tokens") * epochs)
    budget = leaves.agg(F.expr(f"coalesce(sum(tokens), 0) * {budget_percent} div 100").alias("budget"))
    for depth, name in enumerate(LEAF):
        parent = LEAF[:depth]
        nodes = leaves.groupBy(*parent, name).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("weight", _weight(F.col(name), weights.get(name, {})))
        nodes = nodes.join(budget, parent) if parent else nodes.join(F.broadcast(budget), F.lit(True))
        budget = cut(_fill(nodes, parent, name).select(*parent, name, F.col("got").alias("budget")))
    return leaves.join(budget, LEAF).select(*LEAF, "tokens", F.col("budget").alias("quota"))


def _cuts(counted: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """Adds to ``leaves`` the whole ``epochs`` and ``last``, the place at which one more epoch ends."""
    leaves = leaves.where("quota > 0").withColumns(
        {"epochs": F.expr("quota div tokens"), "rest": F.col("quota") % F.col("tokens")}
    )
    leaves = cut(leaves)
    part = leaves.where("rest > 0").select(*LEAF, "epochs", F.col("rest").alias("need"))
    rows = counted.join(part, LEAF).withColumn("place", _place(F.col("epochs"), seed))
    rows = rows.select(*LEAF, "n_tokens", "place", "need")
    for step in range(3):
        # the last step compares whole places, of which one digit group of a leaf has few
        digits = F.substring("place", 1 + step * _DIGITS, _DIGITS if step < 2 else 32)
        sums = rows.groupBy(*LEAF, digits.alias("digits")).agg(F.sum("n_tokens").alias("n"), F.first("need").alias("need"), F.max("place").alias("last"))
        before = Window.partitionBy(*LEAF).orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        edge = sums.where("before < need and before + n >= need")
        edge = cut(edge.select(*LEAF, "digits", (F.col("need") - F.col("before")).alias("need"), "last"))
        if step < 2:
            rows = rows.drop("need").withColumn("digits", digits).join(edge.drop("last"), [*LEAF, "digits"]).drop("digits")
    return leaves.join(edge.select(*LEAF, "last"), LEAF, "left")


def plan(
    docs: DataFrame, domain: Column, budget_percent: int, epochs: int, weights: dict[str, dict[str, int]], seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """Stored counts of ``docs`` (doc_id, text, lang, source), and what each leaf gives: quota, epochs, last."""
    counted = docs.select("doc_id", *_keys(domain), count_words(F.col("text")).alias("n_tokens"))
    counted = cut(counted)
    return counted, cut(_cuts(counted, quotas(counted, budget_percent, epochs, weights), seed))


def _keys(domain: Column) -> list[Column]:
    return [domain.alias("domain"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]]


def copies(rows: DataFrame, leaves: DataFrame, domain: Column, seed: int = SEED) -> DataFrame:
    """(row, epoch): each of ``rows`` once per epoch in which it is taken; ``row`` holds its columns, whatever their names."""
    own = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    keyed = rows.select(own, "doc_id", *_keys(domain)).join(leaves.select(*LEAF, "epochs", "last"), LEAF)
    taken = F.col("epochs") + F.coalesce((_place(F.col("epochs"), seed) <= F.col("last")).cast("long"), F.lit(0))
    keyed = keyed.withColumn("taken", taken).where("taken > 0")
    return keyed.select("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("taken") - 1)).alias("epoch"))
