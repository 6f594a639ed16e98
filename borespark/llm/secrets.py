"""Secret scans over whole texts with a trigram inverted index, in DataFrame functions alone.

Each rule's expression gives a Boolean trigram query (trigrams.py). The index holds postings (trigram, document) for the
trigrams that some rule asks for; a document's postings meet in one mask, the queries are evaluated on it, and only the
candidates' texts are verified with the expression. Rules without a mandatory trigram are verified on every text.

Spans are kind:start:end in code points, end exclusive, leftmost and without overlap within a kind.
Null text counts as empty. A null id is a document like any other. Rows with the same id and the same text are verified once
and each row gets the result. Ties of start are ordered as the rules are listed. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_checked, materialize
from .trigrams import trigram_query, trigrams_of


@dataclass(frozen=True)
class Rule:
    """pattern: as Java and Python read it alike; group and least: that group's match needs so many characters, else it is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The three base rules, then those that the method adds.
RULES = (
    Rule("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20, True),  # a shorter run holds no match of 20 characters, so the bound can stand in the pattern
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("bearer", r"[bB]earer\x20+([A-Za-z0-9._~+/=-]+)", 1, 20),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("private_key", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----", 0, 1),
    Rule("url_login", r"[a-z]+://[^\s:/@]+:([^\s:/@]+)@", 1, 3),
)


def holds(query: object, place: dict[str, int], mask: str = "mask") -> Column:
    """Whether a document's mask satisfies a query."""
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        word, bit = divmod(place[query], 63)
        return F.col(mask)[word].bitwiseAND(F.lit(1 << bit)) != 0
    out = None
    for part in query[1:]:
        one = holds(part, place, mask)
        out = one if out is None else out & one if query[0] == "and" else out | one
    return out


def held(query: object, low: Column, place: dict[str, int]) -> Column:
    """array<int>: the trigrams of a query that a text holds, as far as they can satisfy it: those of a conjunction are looked for only where its
    leading one, that with the fewest common letters, is found."""
    none = F.array().cast("array<int>")
    one = lambda g: F.when(F.contains(low, F.lit(g)), F.array(F.lit(place[g]))).otherwise(none)
    if query is True:
        return none
    if isinstance(query, str):
        return one(query)
    parts = sorted((q for q in query[1:] if isinstance(q, str)), key=lambda g: (sum(c in "etaoinsrhl " for c in g), g))
    deeper = [held(q, low, place) for q in query[1:] if not isinstance(q, str)]
    if query[0] == "or" or not parts:
        return F.concat(*map(one, parts), *deeper)
    return F.when(F.contains(low, F.lit(parts[0])), F.concat(F.array(F.lit(place[parts[0]])), *map(one, parts[1:]), *deeper)).otherwise(none)


def postings(docs: DataFrame, queries: list[object], place: dict[str, int]) -> DataFrame:
    """(gram, id, h): one row for each trigram of each text that the queries ask for; docs has id, text, h."""
    low = docs.select("id", "h", F.lower("text").alias("low")).where(F.length("low") >= 3)
    grams = F.array_distinct(F.concat(*[held(q, F.col("low"), place) for q in queries]))
    return low.select(F.explode(grams).alias("gram"), "id", "h")


def candidates(index: DataFrame, rules: list[Rule], place: dict[str, int]) -> DataFrame:
    """(id, h, rules): postings of a document meet in a mask (pre-aggregated before the shuffle); only documents that satisfy a query stay."""
    bits = lambda w: F.bit_or(F.when(F.floor(F.col("gram") / 63) == w, F.expr("shiftleft(1L, cast(gram % 63 as int))")).otherwise(F.lit(0).cast("long")))
    size = max(place.values(), default=0) // 63 + 1
    masks = index.groupBy("id", "h").agg(F.array(*[bits(w) for w in range(size)]).alias("mask"))
    hits = F.array_compact(F.array(*[F.when(holds(trigram_query(r.pattern), place), F.lit(i)) for i, r in enumerate(rules)]))
    return masks.select("id", "h", hits.alias("hits")).where(F.size("hits") > 0)


def spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, kind_no, stop>> of a rule's accepted matches. The text between matches gives their places."""
    r = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    whole = F.transform(F.regexp_extract_all(text, r, F.lit(0)), lambda x: F.length(x))
    tested = F.transform(F.regexp_extract_all(text, r, F.lit(rule.group)), lambda x: F.length(x)) if rule.group else whole
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind_no:int,stop:int>>").alias("found"))
    rows = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), tested.alias("tested"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        stop = start + x["whole"]
        new = F.struct(start.alias("start"), F.lit(order).alias("kind_no"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(x["tested"] >= rule.least, F.array_append(state["found"], new)).otherwise(state["found"]).alias("found"))

    return F.when(F.size(whole) == 0, zero["found"]).otherwise(F.aggregate(rows, zero, step)["found"])


def written(found: Column, kinds: list[str]) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    return F.concat_ws(",", F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["stop"].cast("string"))))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, found (all spans, sorted by start, then by the rules' order), one row for each row of docs."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.withColumn("h", F.xxhash64("text"))
    queries = [trigram_query(r.pattern) for r in rules]
    order = {r: i for i, r in enumerate(rules)}
    indexed = [r for r, q in zip(rules, queries, strict=True) if q is not True]
    scanned = [r for r, q in zip(rules, queries, strict=True) if q is True]
    place = {g: i for i, g in enumerate(sorted(set().union(*map(trigrams_of, queries))))}
    hits = materialize(candidates(postings(base, queries, place), indexed, place))
    joined = join_checked(base, hits, ["id", "h"], "left")
    every = [F.when(F.array_contains("hits", i), spans(F.col("text"), r, order[r])).otherwise(F.array().cast("array<struct<start:int,kind_no:int,stop:int>>")) for i, r in enumerate(indexed)]
    every += [spans(F.col("text"), r, order[r]) for r in scanned]
    return joined.select(F.col("id").alias(id_col), F.array_sort(F.concat(*every)).alias("found"))


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans, and their number."""
    found, kinds = scan(docs, rules), [r.kind for r in rules]
    base = [i for i, r in enumerate(rules) if r.base]
    count = lambda i: F.size(F.filter("found", lambda s: s["kind_no"] == i)).cast("long")
    digest = F.sha2(written(F.filter("found", lambda s: s["kind_no"].isin(base)), kinds), 256)
    return found.select("doc_id", *[count(i).alias(f"n_{rules[i].kind}") for i in base], digest.alias("base_sha256"), written(F.col("found"), kinds).alias("spans"), F.size("found").cast("long").alias("n_spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its text replaced by mark; overlapping spans become one mark. Columns and rows stay; null text stays null."""
    base = docs.withColumn("__id", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = scan(base.select("__id", "text").where("text is not null"), rules, id_col="__id").where(F.size("found") > 0)
    found = materialize(found.groupBy("__id").agg(F.max("found").alias("found")))
    joined = join_checked(base, found.withColumnRenamed("found", "__found"), ["__id"], "left")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        cut = s["start"] >= state["at"]
        kept = F.when(cut, F.concat(state["out"], F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"]), F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), kept.alias("out"))

    folded = F.aggregate("__found", zero, step)
    clean = F.concat(folded["out"], F.substring(F.col("text"), folded["at"] + 1, 2147483647 - 1))
    return joined.withColumn("text", F.when(F.col("__found").isNull(), F.col("text")).otherwise(clean)).drop("__id", "__found")
