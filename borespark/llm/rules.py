"""Quality rules with a bitmask ledger, in DataFrame functions alone.

1. `ledger`: every rule is evaluated once for each document; the ledger holds the measurements and one long, whose bit i says that rule i failed.
2. `decide`: a policy is a version and a set of rules, that is a mask; a document stays if no bit of its failures is in the mask. New policies
   need the ledger alone, never the texts.
3. `ablations`: for each policy and each of its rules, how many documents fail it, how many fail it alone, and how many the policy without
   it would keep. Failures are first counted by their bits (2**rules combinations at most, pre-aggregated), so the rest is bitwise arithmetic on that small table.

Repeated three-word windows are found inside each row: windows' hashes, with their place in the low bits, are sorted, neighbours with equal
hashes give the places that may repeat, and these are compared as words. Nothing is shuffled for it.

Words are runs of characters other than the six ASCII white space ones. Null text has no words. Null ids, repeated rows and ties are rows
like others. An empty table gives an empty ledger and no ablations. A text of any length is one row's work. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPACE = r"[\x20\x09-\x0D]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits")


@dataclass(frozen=True)
class Rule:
    """fails: SQL over the measurements."""

    name: str
    fails: str


#: Bit i of a ledger is rule i; new rules go to the end, so that old ledgers keep their meaning. The first two are the base rules.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("word_length", "word_chars > 12 * n_words or word_chars < 2 * n_words"),
    Rule("digits", "100 * n_digits > 40 * word_chars"),
)
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    version: int
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        names = [r.name for r in rules]
        return reduce(lambda m, name: m | 1 << names.index(name), self.rules, 0)


#: Every version holds the base rules.
POLICIES = (Policy(1, BASE), Policy(2, (*BASE, "symbols", "repeated_lines")), Policy(3, (*BASE, "symbols", "repeated_lines", "word_length", "digits")))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeat_words(words: Column) -> Column:
    """How many of an array's words stand in a three-word window found twice or more in it."""
    shift = lambda x, k: F.call_function("shiftrightunsigned", x, k)

    def of(w: Column) -> Column:
        windows = F.greatest(F.size(w) - 2, F.lit(0))
        return bound(F.length(F.bin(windows.cast("long"))).cast("int"), lambda k: hashed(w, windows, k))

    def hashed(w: Column, windows: Column, k: Column) -> Column:
        """k: bits that a place needs."""
        high = lambda h: F.call_function("shiftleft", shift(h, k), k)
        packed = F.transform(F.slice(w, F.lit(1), windows), lambda x, i: high(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))).bitwiseOR(i.cast("long")))
        return bound(F.sort_array(packed), lambda p: places(w, p, k))

    def places(w: Column, p: Column, k: Column) -> Column:
        near = lambda x, j: shift(x.bitwiseXOR(F.get(p, j)), k) == 0
        may = F.filter(p, lambda x, j: near(x, j + 1) | near(x, j - 1))
        low = lambda x: x.bitwiseXOR(F.call_function("shiftleft", shift(x, k), k)).cast("int")
        spelled = F.transform(may, lambda x: bound(low(x), lambda i: F.struct(F.array(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("words"), i.alias("at"))))
        return bound(F.array_sort(spelled), lambda s: F.when(F.size(s) == 0, F.lit(0)).otherwise(covered(s)))

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, j: (x["words"] == F.get(s, j + 1)["words"]) | (x["words"] == F.get(s, j - 1)["words"]))
        zero = F.struct(F.lit(0).alias("stop"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct((i + 3).alias("stop"), (a["n"] + i + 3 - F.greatest(i, a["stop"])).alias("n"))
        return F.aggregate(F.array_sort(F.transform(again, lambda x: x["at"])), zero, step)["n"]

    return bound(words, of)


def measured(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col and MEASURES, each a long, for every row of docs."""
    t = F.coalesce(F.col(text), F.lit(""))
    solid = F.btrim(t, F.lit(" \t\n\x0b\f\r"))
    words = F.when(solid == "", F.array().cast("array<string>")).otherwise(F.split(solid, f"{SPACE}+", -1))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = bound(words, lambda w: F.struct(F.size(w).alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    of_lines = bound(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    found = docs.select(F.col(id_col), of_words.alias("w"), of_lines.alias("x"), F.length(F.regexp_replace(t, f"{SPACE}+", "")).alias("word_chars"), F.regexp_count(t, F.lit("[#*$%&|<>]")).alias("n_symbols"), F.regexp_count(t, F.lit("[0-9]")).alias("n_digits"))
    flat = {"n_words": "w.n_words", "n_repeat_words": "w.n_repeat_words", "n_lines": "x.n_lines", "n_dup_lines": "x.n_dup_lines"}
    return found.select(id_col, *[F.col(flat.get(m, m)).cast("long").alias(m) for m in MEASURES])


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, the measurements, and failed: bit i is set if rule i fails. Written once, as policies and ablations read it again."""
    if len(rules) > 63:
        raise ValueError("a ledger holds 63 rules at most")
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)])
    return materialize(measured(docs, id_col, text).withColumn("failed", bits))


def decide(book: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with policy (its version), base_failed and kept."""
    against = lambda p: F.col("failed").bitwiseAND(F.lit(p.mask(rules)).cast("long")) != 0
    return book.withColumn("policy", F.lit(policy.version)).withColumn("base_failed", against(Policy(0, BASE))).withColumn("kept", ~against(policy))


def ablations(book: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """policy, rule, n_docs, n_kept, n_failed (by the rule), n_only (by it and no other rule of the policy), n_kept_without."""
    seen = book.groupBy("failed").agg(F.count("*").alias("n"))
    names = [r.name for r in rules]
    asked = F.array(*[F.struct(F.lit(p.version).alias("policy"), F.lit(p.mask(rules)).cast("long").alias("mask"), F.lit(name).alias("rule"), F.lit(1 << names.index(name)).cast("long").alias("bit")) for p in policies for name in p.rules])
    rows = seen.select("failed", "n", F.explode(asked).alias("q")).select("failed", "n", "q.*").withColumn("under", F.col("failed").bitwiseAND(F.col("mask")))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0).cast("long")))
    counts = rows.groupBy("policy", "rule").agg(F.sum("n").alias("n_docs"), total(F.col("under") == 0).alias("n_kept"), total(F.col("under").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), total(F.col("under") == F.col("bit")).alias("n_only"))
    return counts.withColumn("n_kept_without", F.col("n_kept") + F.col("n_only"))
