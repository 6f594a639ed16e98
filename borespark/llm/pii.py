"""Personal data by weak supervision, in DataFrame functions alone.

1. Candidate spans: matches of the base patterns, and of looser ones that the base rules don't cover.
2. Labelers vote on each candidate (1 yes, 0 no, null no opinion): the pattern's own check (for account numbers their check digits), a
   gazetteer (top-level domains, issuer digits, country codes, given names; the word lists are parameters), the words before it, and its edges.
3. Expectation-maximisation estimates each labeler's reliability for each kind, from the counts of vote patterns.
4. A logistic span classifier is trained on the posteriors; candidates of the looser kinds that it accepts are added. Base spans stay in any
   case; what fails its kind's own check is evidence for training and never added.

Vote patterns and feature patterns are bounded in number (3**4 votes, 2**8 features, for each kind), so steps 3 and 4 work
on a table whose size doesn't depend on the corpus. Texts are read once and never shuffled.

Spans are kind:start:end in code points, end exclusive, by kind as listed, then start. Null text counts as empty. Null ids and
repeated rows are rows like others. No candidates: no spans. An added span that overlaps a base span is dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "local_phone", "spelt_mail", "iban", "person", "card_in_run", "phone_in_run")

#: Fixed values. Possessive forms accept the same matches as the greedy ones, without backtracking.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "spelt_mail": r"[A-Za-z0-9._-]{2,64}\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\[dot\]|\(dot\))\x20?)[A-Za-z0-9-]++)++",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "person": r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20\p{Lu}\p{Ll}+(?:\x20\p{Lu}\p{Ll}+)?",
    # numbers that stand beside others, so that the base rule's one long match fails its check
    "card_in_run": r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9])",
    "phone_in_run": r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {"email": "@", "phone": "+", "spelt_mail": "at", "ip": ".", "phone_in_run": "+"}
DOMAINS = (
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "io", "ai", "app", "dev", "cloud", "online", "shop", "site", "tech", "xyz", "eu", "example",
    "ar", "at", "au", "be", "bg", "br", "ca", "ch", "cl", "cn", "co", "cz", "de", "dk", "ee", "es", "fi", "fr", "gr", "hr", "hu", "ie", "il", "in", "is", "it", "jp", "kr", "lt", "lu", "lv", "mx", "nl", "no", "nz", "pe", "pl", "pt", "ro", "rs", "ru", "se", "sg", "si", "sk", "tr", "ua", "uk", "us", "za",
)
NAMES = (
    "Anna", "Maria", "John", "James", "Mary", "Robert", "Patricia", "Jennifer", "Linda", "Elizabeth", "William", "Richard", "Joseph", "Susan", "Jessica", "Sarah", "Karen", "Daniel", "Matthew", "Anthony", "Mark", "Emily", "Emma", "Olivia", "Sophia", "George", "Peter", "Paul", "Thomas", "Michael", "David", "Laura",
    "Hans", "Klaus", "Jürgen", "Wolfgang", "Stefan", "Andreas", "Ursula", "Monika", "Petra", "Sabine", "Heike", "Lukas", "Felix", "Lena", "Pierre", "Jean", "Marie", "Michel", "Philippe", "Alain", "Nathalie", "Isabelle", "Sylvie", "Camille", "Louis", "Chloé",
    "Juan", "Carlos", "Luis", "Carmen", "José", "Antonio", "Manuel", "Francisco", "Javier", "Miguel", "Ana", "Isabel", "Lucía", "Pilar", "Rosa", "Elena",
)
#: Country codes of account numbers.
COUNTRIES = ("AT", "BE", "BG", "CH", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GB", "GR", "HR", "HU", "IE", "IS", "IT", "LI", "LT", "LU", "LV", "MC", "MT", "NL", "NO", "PL", "PT", "RO", "SE", "SI", "SK", "SM")
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|address|client|adresse",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|telefon|llama",
    "local_phone": "phone|call|tel|mobile|fax|telefon|llama",
    "spelt_mail": "mail|contact|write|kontakt|correo|courriel",
    "iban": "iban|account|konto|bank|compte|cuenta",
    "person": "name|contact|patient|customer|kunde|client",
    "card_in_run": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone_in_run": "phone|call|tel|mobile|fax|telefon|llama",
}


def matches(text: Column, kind: str) -> Column:
    """array<struct<start, stop, found>> of a pattern's matches; the text between matches gives their places."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    rows = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("found"))
    none = F.array().cast("array<struct<start:int,stop:int,found:string>>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        stop = start + F.length(x["found"])
        return F.struct(stop.alias("at"), F.array_append(state["out"], F.struct(start.alias("start"), stop.alias("stop"), x["found"].alias("found"))).alias("out"))

    some = F.when(F.size(found) > 0, F.aggregate(rows, zero, step)["out"]).otherwise(none)
    return F.when(F.contains(text, F.lit(NEEDS[kind])), some).otherwise(none) if kind in NEEDS else some


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def checked(kind: str, found: Column) -> Column:
    """The base rule's own check, or the looser kind's."""
    n = F.length(digits(found))
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)) <= 255)
    if kind in ("card", "card_in_run"):
        return (n >= 16) & (n <= 19) & F.when((n >= 16) & (n <= 19), F.call_function("luhn_check", digits(found))).otherwise(False)
    if kind in ("phone", "phone_in_run"):
        return (n >= 8) & (n <= 15)
    if kind == "iban":
        plain = F.regexp_replace(found, r"\x20", "")
        return F.length(plain).between(15, 34) & (remainder_97(F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))) == 1)
    return F.lit(True)


def remainder_97(text: Column) -> Column:
    """The remainder by 97 of digits and capital letters, these read as 10 to 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, "(?<=.)(?=.)"), F.lit(0), lambda r, c: ((r * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97).cast("int"))


def known(kind: str, found: Column, domains: tuple[str, ...], names: tuple[str, ...]) -> Column:
    """The gazetteer's vote."""
    if kind in ("email", "spelt_mail"):
        return F.regexp_extract(F.lower(found), "([a-z]+)$", 1).isin(*domains)
    if kind == "ip":
        return found.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.")
    if kind in ("card", "card_in_run"):
        return digits(found).rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))")
    if kind in ("phone", "phone_in_run"):
        return found.rlike(r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])")
    if kind == "local_phone":
        return digits(found).rlike(r"^[2-9][0-9]{2}[2-9]")
    if kind == "iban":
        return F.substring(found, 1, 2).isin(*COUNTRIES)
    return F.arrays_overlap(F.split(found, r"[\x20.]+"), F.array(*map(F.lit, names)))


def vote(yes: Column, otherwise: int | None = 0) -> Column:
    return F.when(yes, F.lit(1)).otherwise(F.lit(otherwise).cast("int"))


def candidates(docs: DataFrame, id_col: str, text: str, domains: tuple[str, ...] = DOMAINS, names: tuple[str, ...] = NAMES) -> DataFrame:
    """(id, found): for each row its candidates as structs kind_no, start, stop, base, votes, features."""
    t = F.coalesce(F.col(text), F.lit(""))

    def described(kind: str) -> Column:
        k = KINDS.index(kind)

        def one(x: Column) -> Column:
            m, begin = x["found"], F.greatest(x["start"] - 40, F.lit(0))
            before, after = F.substring(t, begin + 1, x["start"] - begin), F.substring(t, x["stop"] + 1, F.lit(1))
            good, listed = checked(kind, m), known(kind, m, domains, names)
            near = F.lower(before).rlike(rf"(?:{CONTEXT[kind]})[^.\n]*$")
            apart = ~before.rlike(r"[\p{L}\p{N}_]$") & ~after.rlike(r"^[\p{L}\p{N}_]")
            votes = F.array(vote(good), vote(listed), vote(near, None), vote(apart))
            n = F.length(digits(m))
            flags = [good, listed, near, apart, n >= 8, n >= 16, m.rlike(r"[\x20.-]"), F.length(m) >= 16]
            features = F.array(F.lit(1.0), *[F.when(c, 1.0).otherwise(0.0) for c in flags], *[F.lit(float(k == i)) for i in range(len(KINDS))])
            return F.struct(F.lit(k).alias("kind_no"), x["start"].alias("start"), x["stop"].alias("stop"), (good & F.lit(kind in BASE)).alias("base"), good.alias("good"), votes.alias("votes"), features.alias("features"))

        return F.transform(matches(t, kind), one)

    return docs.select(F.col(id_col).alias("id"), F.concat(*[described(k) for k in KINDS]).alias("found"))


def reliabilities(patterns: Column, rounds: int = 20) -> Column:
    """EM over an array of (votes, n): struct p, yes (P(vote 1 | personal)), no (P(vote 1 | not)). Priors of a few votes keep the classes apart."""
    labelers = 4
    start = F.struct(F.lit(0.5).alias("p"), F.array(*[F.lit(0.8)] * labelers).alias("yes"), F.array(*[F.lit(0.2)] * labelers).alias("no"))

    def step(state: Column, _: Column) -> Column:
        weighed = F.transform(patterns, lambda q: F.struct(q["votes"].alias("votes"), q["n"].alias("n"), (q["n"] * posterior(state, q["votes"])).alias("r")))
        total = lambda value: F.aggregate(weighed, F.lit(0.0), lambda a, q: a + value(q))
        said = lambda q, j: F.when(q["votes"][j] == 1, 1.0).otherwise(0.0)
        gave = lambda q, j: F.when(q["votes"][j].isNull(), 0.0).otherwise(1.0)
        yes = [(total(lambda q, j=j: q["r"] * said(q, j)) + 8) / (total(lambda q, j=j: q["r"] * gave(q, j)) + 10) for j in range(labelers)]
        no = [(total(lambda q, j=j: (q["n"] - q["r"]) * said(q, j)) + 2) / (total(lambda q, j=j: (q["n"] - q["r"]) * gave(q, j)) + 10) for j in range(labelers)]
        return F.struct(((total(lambda q: q["r"]) + 1) / (total(lambda q: q["n"]) + 2)).alias("p"), F.array(*yes).alias("yes"), F.array(*no).alias("no"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)


def posterior(state: Column, votes: Column) -> Column:
    """P(personal | votes), votes taken as independent given the class."""
    said = lambda rate: [F.when(votes[j].isNull(), 1.0).when(votes[j] == 1, state[rate][j]).otherwise(1 - state[rate][j]) for j in range(4)]
    a, b = reduce(lambda x, y: x * y, said("yes"), state["p"]), reduce(lambda x, y: x * y, said("no"), 1 - state["p"])
    return a / (a + b)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def classifier(patterns: Column, width: int, rounds: int = 60, rate: float = 2.0, shrink: float = 1e-3) -> Column:
    """Weights of a logistic regression on an array of (features, n, r): n candidates, r of them personal by the posteriors."""
    zeros = F.array(*[F.lit(0.0)] * width)
    count = F.aggregate(patterns, F.lit(0.0), lambda a, q: a + q["n"])

    def step(w: Column, _: Column) -> Column:
        slope = F.aggregate(patterns, zeros, lambda g, q: F.zip_with(g, q["features"], lambda s, f: s + (q["n"] * logistic(dot(w, q["features"])) - q["r"]) * f))
        return F.zip_with(w, slope, lambda x, s: x - rate * (s / F.greatest(count, F.lit(1.0)) + shrink * x))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), zeros, step)


def find(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", least: float = 0.5, domains: tuple[str, ...] = DOMAINS, names: tuple[str, ...] = NAMES) -> DataFrame:
    """id_col, found: array of structs kind_no, start, stop, base for every row of docs, base spans and the accepted others."""
    table = materialize(candidates(docs, id_col, text, domains, names))
    counts = table.select(F.explode("found").alias("x")).groupBy("x.kind_no", "x.votes", "x.features").agg(F.count("*").cast("double").alias("n"))
    by_votes = counts.groupBy("kind_no", "votes").agg(F.sum("n").alias("n")).groupBy("kind_no").agg(F.collect_list(F.struct("votes", "n")).alias("patterns"))
    rates = by_votes.select("kind_no", reliabilities(F.col("patterns")).alias("state"))
    soft = counts.join(F.broadcast(rates), "kind_no").select("features", "n", (F.col("n") * posterior(F.col("state"), F.col("votes"))).alias("r"))
    width = 9 + len(KINDS)
    merged = soft.groupBy("features").agg(F.sum("n").alias("n"), F.sum("r").alias("r")).agg(F.collect_list(F.struct("features", "n", "r")).alias("patterns"))
    weights = materialize(merged.select(classifier(F.col("patterns"), width).alias("w")))
    scored = table.crossJoin(F.broadcast(weights))
    chosen = F.filter("found", lambda x: x["base"] | ((x["kind_no"] >= len(BASE)) & x["good"] & (logistic(dot(F.col("w"), x["features"])) >= least)))
    base = F.filter("found", lambda x: x["base"])
    clear = F.filter(chosen, lambda x: x["base"] | ~F.exists(base, lambda y: (y["start"] < x["stop"]) & (x["start"] < y["stop"])))
    slim = F.transform(clear, lambda x: F.struct(x["kind_no"].alias("kind_no"), x["start"].alias("start"), x["stop"].alias("stop"), x["base"].alias("base")))
    return scored.select(F.col("id").alias(id_col), F.array_sort(slim).alias("found"))


def written(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["stop"].cast("string"))))


def pii(docs: DataFrame, **options) -> DataFrame:
    """doc_id, counts of base spans by kind, digest of the base spans, all spans, and their number."""
    base = F.filter("found", lambda s: s["base"])
    count = lambda k: F.size(F.filter("found", lambda s: s["base"] & (s["kind_no"] == KINDS.index(k)))).cast("long")
    return find(docs, **options).select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"))
