"""Mixing sources to target weights down a tree of domain, language and source.

A source's domain comes from a mapping table (source, domain) or a column `domain`; else it is "other".

A leaf can give `epochs` times its tokens. Budgets go down the tree: a node's budget is shared among its children by weight, a
child never gets more than its subtree can give, and what it can't take goes to its siblings by weight, before the node itself
falls short; only then do the node's siblings get it, since its own capacity was the bound one level up.
Level by level this is water-filling, done with running sums over the children sorted by capacity / weight.

A leaf's budget is whole epochs and a rest. Every epoch has its own order, by a seeded hash of the document; the rest is a prefix in
tokens of the next epoch's order, the last document cut. The order is summed up in two levels: hash ranges of about RANGE documents, then within
one, so that a leaf of any size is never in one task.

Tokens are words (runs of characters other than the six ASCII white space ones). Null text has none. Null lang or source are a
child named "" of their own. A child without a given weight has weight 1; one with weight 0 gets nothing, and what stands below it counts in no
ancestor's capacity, so that siblings get its part. Budgets are whole tokens at every level and add up to their parent's. A budget over the
capacity gives all. Rows are told apart by id and text; equal rows have the same place in the order and each is taken. Extra columns
are kept only where said.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_checked, materialize

RANGE = 4096
SPACES = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Target:
    """weights: by level, child -> weight. share: budget as a part of all tokens (may pass 1, with epochs). epochs: most uses of a document."""

    domains: dict[str, float] = field(default_factory=dict)
    langs: dict[str, float] = field(default_factory=dict)
    sources: dict[str, float] = field(default_factory=dict)
    share: float = 1.0
    epochs: int = 4
    seed: int = 20


def with_domain(docs: DataFrame, domains: DataFrame | None) -> DataFrame:
    """docs with __domain: from the mapping (source, domain), else from their own column domain; "other" where neither says."""
    own = F.col("domain").cast("string") if "domain" in docs.columns else F.lit(None).cast("string")
    if domains is None:
        return docs.withColumn("__domain", F.coalesce(own, F.lit("other")))
    known = materialize(domains.where("source is not null").groupBy("source").agg(F.min("domain").alias("__mapped")))
    return join_checked(docs, known, ["source"], "left").withColumn("__domain", F.coalesce("__mapped", own, F.lit("other"))).drop("__mapped")


def word_count(text: str = "text") -> Column:
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")
    body = F.trim(clean)
    return F.when(body == "", 0).otherwise(F.length(body) - F.length(F.replace(body, F.lit(" "), F.lit(""))) + 1).cast("long")


def weight(column: str, given: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for name, value in given.items():
        out = F.when(F.col(column) == name, float(value)).otherwise(out)
    return out


def fill(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """children (parent, child, w, cap) with the parent's budget -> the child's budget, in whole tokens. level = the common level at which all
    unfilled children stand. Tokens that rounding leaves go to the children with the largest fractions, one each, so none is lost."""
    whole = Window.partitionBy(*parent)
    order = whole.orderBy("ratio", child)
    w = children.withColumn("ratio", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(0.0))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    w = w.withColumn("budget", F.least(F.col("budget"), F.sum("cap").over(whole)))
    w = w.withColumn("level", F.when(left > 0, (F.col("budget") - before) / left))
    # the first child whose own ratio is not below the level that holds from it on sets the level
    held = F.min(F.when(F.col("ratio") >= F.col("level") - 1e-9, F.struct("ratio", child, "level"))).over(whole)["level"]
    w = w.withColumn("real", F.least(F.col("cap"), F.coalesce(held, F.max("ratio").over(whole)) * F.col("w")))
    w = w.withColumn("floor", F.floor(F.col("real") + 1e-6).cast("double"))
    spare = F.col("budget") - F.sum("floor").over(whole)
    turn = F.row_number().over(whole.orderBy((F.col("floor") < F.col("cap")).desc(), (F.col("real") - F.col("floor")).desc(), child))
    return w.withColumn("budget", F.col("floor") + F.when((turn <= spare) & (F.col("floor") < F.col("cap")), 1.0).otherwise(0.0)).drop("w", "ratio", "level", "real", "floor")


def budgets(leaves: DataFrame, target: Target) -> DataFrame:
    """leaves (domain, lang, source, tokens) -> also budget, in whole tokens. What stands below a weight of 0, at any level, has no capacity."""
    tree = (("domain", target.domains), ("lang", target.langs), ("source", target.sources))
    reachable = reduce(lambda a, b: a & b, [weight(c, given) > 0 for c, given in tree])
    caps = leaves.withColumn("cap", F.when(reachable, F.col("tokens").cast("double") * target.epochs).otherwise(0.0))
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(target.share)).cast("double").alias("budget"))
    node = lambda *path: caps.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("w", weight(path[-1], dict(tree)[path[-1]]))
    domains = fill(node("domain").crossJoin(total).withColumn("root", F.lit(0)), ["root"], "domain").select("domain", "budget")
    langs = fill(node("domain", "lang").join(domains, "domain"), ["domain"], "lang").select("domain", "lang", "budget")
    sources = fill(caps.withColumn("w", weight("source", target.sources)).join(langs, ["domain", "lang"]), ["domain", "lang"], "source")
    return sources.select("domain", "lang", "source", "tokens", F.col("budget").cast("long").alias("budget"))


def mix(docs: DataFrame, target: Target = Target(), domains: DataFrame | None = None) -> DataFrame:
    """doc_id, th, domain, lang, source, tokens, epochs_full, tokens_last: how often each row is taken whole, and the tokens
    of one more use (0: none). Only rows taken at all."""
    leaf = ["domain", "lang", "source"]
    named = with_domain(docs, domains).select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.col("__domain").alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), word_count().alias("tokens")
    )
    table = materialize(named)
    leaves = materialize(table.groupBy(*leaf).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    plan = materialize(budgets(leaves.drop("docs"), target)).join(leaves.select(*leaf, F.ceil(F.col("docs") / RANGE).alias("ranges")), leaf)
    wanted = plan.where("budget > 0").select(*leaf, "ranges", F.floor(F.col("budget") / F.greatest("tokens", F.lit(1))).alias("epochs_full"), F.pmod("budget", F.greatest("tokens", F.lit(1))).alias("rest"))
    used = join_checked(table.where("tokens > 0"), materialize(wanted), leaf, "inner")
    place = F.xxhash64(F.lit(target.seed), F.col("epochs_full"), "doc_id", "th")
    placed = used.withColumn("place", place).withColumn("range", F.floor((F.col("place").cast("double") + 2.0**63) / (2.0**64 / F.col("ranges"))))
    sums = placed.groupBy(*leaf, "range").agg(F.sum("tokens").alias("in_range"))
    before = F.coalesce(F.sum("in_range").over(Window.partitionBy(*leaf).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = materialize(sums.withColumn("before", before))
    known = join_checked(placed, ranges, [*leaf, "range"], "inner").where((F.col("before") < F.col("rest")) | (F.col("epochs_full") > 0))
    edge = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("in_range") > F.col("rest"))
    inside = known.where(edge).withColumn("start", F.col("before") + F.coalesce(F.sum("tokens").over(Window.partitionBy(*leaf, "range").orderBy("place", "doc_id", "th").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    others = known.where(~edge).withColumn("start", F.when(F.col("before") < F.col("rest"), F.lit(0).cast("long")).otherwise(F.col("rest")))
    both = inside.unionByName(others)
    last = F.greatest(F.lit(0).cast("long"), F.least("tokens", F.col("rest") - F.col("start")))
    whole_range = ~edge & (F.col("before") < F.col("rest"))
    out = both.withColumn("tokens_last", F.when(whole_range, F.col("tokens")).otherwise(last))
    out = out.select("doc_id", "th", *leaf, "tokens", F.col("epochs_full").cast("int").alias("epochs_full"), F.col("tokens_last").cast("long").alias("tokens_last"))
    return out.where("epochs_full > 0 or tokens_last > 0")


def mixed_documents(docs: DataFrame, target: Target = Target(), domains: DataFrame | None = None) -> DataFrame:
    """The columns of docs: each chosen row once for each use; of a last, partial use the text is its prefix of that many tokens."""
    chosen = materialize(mix(docs, target, domains).groupBy("doc_id", "th").agg(F.max("epochs_full").alias("__full"), F.max("tokens_last").alias("__last"), F.max("tokens").alias("__tokens")))
    marked = docs.withColumn("th", F.xxhash64(F.coalesce("text", F.lit("")))) if "th" not in docs.columns else docs.withColumn("__th", F.col("th")).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = join_checked(marked, chosen, ["doc_id", "th"], "inner")
    cuts = F.concat(F.when(F.col("__full") > 0, F.array_repeat(F.col("__tokens"), F.col("__full"))).otherwise(F.array().cast("array<bigint>")), F.when(F.col("__last") > 0, F.array("__last")).otherwise(F.array().cast("array<bigint>")))
    rows = joined.withColumn("__take", F.explode(cuts))
    pattern = F.concat(F.lit(r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){"), F.col("__take").cast("string"), F.lit("}+"))
    text = F.when(F.col("__take") >= F.col("__tokens"), F.col("text")).otherwise(F.regexp_substr(F.col("text"), pattern))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__take") >= F.col("__tokens"), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    if "__th" in rows.columns:
        rows = rows.drop("th").withColumnRenamed("__th", "th")
    return rows.select(*docs.columns)
