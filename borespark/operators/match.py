"""Joins: projects, domains, pad history, routing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import arg_max, contains_any, hits, normalize_api, normalize_name
from ..plans import dims
from ..sources.scratch import sent_if_small, written


def names_match(a: Column, b: Column) -> Column:
    """Equal, or one within the other, after normalisation; both must be non-empty."""
    x, y = normalize_name(a), normalize_name(b)
    return F.coalesce((x != "") & (y != "") & ((x == y) | F.contains(x, y) | F.contains(y, x)), F.lit(False))


def match_score(e: dict[str, Column], p: dict[str, Column], aliases: Column | None = None) -> tuple[Column, Column]:
    """(confidence, matched identifiers) of an entity's fields against a project's."""
    api = F.coalesce((normalize_api(e["api"]) != "") & (normalize_api(e["api"]) == normalize_api(p["api"])), F.lit(False)) if "api" in e and "api" in p else F.lit(False)
    well = names_match(e["well_name"], p["well_name"]) if "well_name" in e and "well_name" in p else F.lit(False)
    if aliases is not None:
        well = well | F.coalesce(F.exists(aliases, lambda a: names_match(e["well_name"], a)), F.lit(False))
    found = {"api": api, "well_name": well} | {k: names_match(e[k], p[k]) for k in ("field", "operator", "pad", "basin") if k in e and k in p}
    total = sum((F.when(c, dims.MATCH_WEIGHTS[k]).otherwise(0.0) for k, c in found.items()), F.lit(0.0))
    return F.round(total / 10, 3), F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in found.items()]))


def project_match(entities: DataFrame, projects: DataFrame, *, block: list[str] | None = None) -> DataFrame:
    """file_id, project_name, confidence, matched for pairs that share something: an API, or names of which one lies in the other.

    Distinct normalised names are matched first (name_links), so a name counts once however many rows have it. Rows then meet in cells, each a block of entities
    and a block of projects, with all of their links in it (pairs_in_cells): a pair is whole where it is made, so pairs are neither shuffled nor sorted on disk.
    block: pairs are kept that match in one of these fields; all present are scored."""
    fields = [f for f in dims.MATCH_WEIGHTS if f in entities.columns and f in projects.columns]
    e, p = name_members(entities, "file_id", fields), name_members(projects, "project_name", fields)
    links = written(name_links(e, p).select("field", F.col("entity_name").alias("name"), F.col("project_name").alias("project_class")))
    classes = written(links.select("field", "project_class").distinct().withColumn("class", F.monotonically_increasing_id()))
    asks = shuffled(shuffled(e, links, ["field", "name"]), classes, ["field", "project_class"]).select(F.col("id").alias("file_id"), "class").distinct()
    bit = F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(fields) for x in (f, 1 << i)]), F.col("field"))
    holds = shuffled(p.withColumnRenamed("name", "project_class"), classes, ["field", "project_class"]).select(F.col("id").alias("project_name"), "class", bit.alias("bit")).distinct()
    pairs = pairs_in_cells(written(asks), written(holds), len(fields))
    pairs = pairs if block is None else pairs.where(F.col("found").bitwiseAND(sum(1 << fields.index(f) for f in set(block) & set(fields))) != 0)
    sets = [[f for i, f in enumerate(fields) if found >> i & 1] for found in range(1 << len(fields))]
    confidence = F.array(*[F.round(F.lit(sum((dims.MATCH_WEIGHTS[f] for f in s), 0.0)) / 10, 3) for s in sets])
    matched = F.array(*[F.array(*map(F.lit, s)).cast("array<string>") for s in sets])
    scored = pairs.select("file_id", "project_names", confidence[F.col("found")].alias("confidence"), matched[F.col("found")].alias("matched"))
    return scored.select("file_id", F.explode("project_names").alias("project_name"), "confidence", "matched")


def pairs_in_cells(asks: DataFrame, holds: DataFrame, n_fields: int, *, rows: int = 2**17, links: int = 2**25) -> DataFrame:
    """file_id, found (the bits of the fields in which they are linked), project_names: each linked pair once, of written tables asks (file_id, class) and holds
    (project_name, class, bit) without equal rows.

    Entities and projects are dealt out to blocks by their ids; a row goes only to the cells in which its class has rows of the other side. There are so many blocks
    that a cell has some `rows` rows and `links` links at most; where links are few, so that most cells would be all but empty, there are fewer."""
    per_class = lambda x, n: x.groupBy("class").agg(F.count("*").cast("double").alias(n))
    total = shuffled(per_class(asks, "a"), per_class(holds, "h"), ["class"]).agg(F.sum(F.col("a") * F.col("h"))).first()[0] or 0.0
    n_asks, n_holds = asks.count(), holds.count()
    p_blocks = -(-n_holds // rows) or 1
    e_blocks = min(max(-(-n_asks * 4 // rows), math.ceil(total / links / p_blocks)), n_asks) or 1
    fewer = math.sqrt(min(1.0, total / rows / (e_blocks * p_blocks)))
    e_blocks, p_blocks = math.ceil(e_blocks * fewer) or 1, math.ceil(p_blocks * fewer) or 1
    a = asks.withColumn("e_block", F.pmod(F.xxhash64("file_id"), F.lit(e_blocks)))
    h = holds.withColumn("p_block", F.pmod(F.xxhash64("project_name"), F.lit(p_blocks)))
    places = lambda x, c: x.groupBy("class").agg(F.collect_set(c).alias(c)).withColumnRenamed("class", "of")
    sent = lambda x, other, c: x.join(places(other, c).hint("merge"), F.col("class") == F.col("of")).withColumn(c, F.explode(c))
    cell = (F.col("e_block") * p_blocks + F.col("p_block")).cast("int").alias("cell")
    kind = lambda x, c: x.schema[c].dataType
    a = sent(a, h, "p_block").select(cell, "file_id", F.lit(None).cast(kind(holds, "project_name")).alias("project_name"), "class", F.lit(0).alias("bit"))
    h = sent(h, asks.withColumn("e_block", F.pmod(F.xxhash64("file_id"), F.lit(e_blocks))), "e_block").select(cell, F.lit(None).cast(kind(asks, "file_id")).alias("file_id"), "project_name", "class", "bit")
    schema = T.StructType([T.StructField("file_id", kind(asks, "file_id")), T.StructField("found", T.IntegerType()), T.StructField("project_names", T.ArrayType(kind(holds, "project_name")))])
    return a.union(h).repartitionById(min(e_blocks * p_blocks, 10_000), F.col("cell")).groupBy("cell").applyInArrow(linked_pairs(n_fields), schema)


def linked_pairs(n_fields: int, chunk: int = 2**18):
    """For the rows of one cell: for each entity and each set of fields in which it is linked, the list of projects that it is linked with in just these.

    An entity linked with many of the cell's projects has its bits marked on an array of them; others are worked on together, some `chunk` links at a time, in sorted order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(list(batches))
        coded = lambda t, c: t.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
        is_ask = pc.equal(cell.column("bit"), 0)
        asks, holds = cell.filter(is_ask), cell.filter(pc.invert(is_ask))
        e, p = coded(asks, "file_id"), coded(holds, "project_name")
        at, kind, bit = p.indices.to_numpy().astype(np.int64), holds.column("class").to_numpy(), holds.column("bit").to_numpy()
        order = np.lexsort((at, kind))
        at, kind, bit = at[order], kind[order], bit[order].astype(np.uint8)
        own = e.indices.to_numpy().astype(np.int64)
        order = np.argsort(own, kind="stable")
        own, asked = own[order], asks.column("class").to_numpy()[order]
        first, end = np.searchsorted(kind, asked, "left"), np.searchsorted(kind, asked, "right")
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        weight = np.add.reduceat(end - first, starts)  # an entity's links
        starts = np.append(starts, len(own))
        many = weight > max(len(p.dictionary) // 16, 4096)
        width = max(len(p.dictionary) - 1, 1).bit_length()

        def marked(i: int) -> tuple[np.ndarray, ...]:
            bits = np.zeros(len(p.dictionary), np.uint8)
            for k in range(starts[i], starts[i + 1]):
                bits[at[first[k] : end[k]]] |= bit[first[k]]
            what = np.flatnonzero(bits.astype(bool))
            found = bits[what]
            n, order = np.bincount(found), np.argsort(found, kind="stable")
            kinds = np.flatnonzero(n)
            return np.full(len(kinds), i), kinds, np.append(0, np.cumsum(n[kinds])), what[order]

        def sorted_links(some: np.ndarray) -> tuple[np.ndarray, ...]:
            rows = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in some.tolist()])
            size = end[rows] - first[rows]
            here = np.repeat(first[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            links = np.sort((np.repeat(own[rows] << width, size) | at[here]) << n_fields | bit[here])
            pair = links >> n_fields
            new = np.flatnonzero(np.diff(pair, prepend=-1))
            found, pair = np.bitwise_or.reduceat(links & ((1 << n_fields) - 1), new), pair[new]
            who, what = pair >> width, pair & ((1 << width) - 1)
            order = np.lexsort((what, found, who))
            who, found, what = who[order], found[order], what[order]
            new = np.flatnonzero((np.diff(who, prepend=-1) != 0) | (np.diff(found, prepend=-1) != 0))
            return who[new], found[new], np.append(new, len(who)), what

        def lists(who: np.ndarray, found: np.ndarray, borders: np.ndarray, what: np.ndarray) -> pa.RecordBatch:
            names = pa.ListArray.from_arrays(pa.array(borders, pa.int32()), p.dictionary.take(pa.array(what)))
            return pa.RecordBatch.from_arrays([e.dictionary.take(pa.array(who)), pa.array(found, pa.int32()), names], ["file_id", "found", "project_names"])

        for i in np.flatnonzero(many).tolist():
            yield lists(*marked(i))
        few = np.flatnonzero(~many)
        for some in np.split(few, np.flatnonzero(np.diff(np.cumsum(weight[few]) // chunk)) + 1) if len(few) else []:
            yield lists(*sorted_links(some))

    return run


def name_members(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """field, name, id: each row under its normalised names, an alias as one more well name. Null and empty names are left out."""
    one = lambda f, c: F.struct(F.lit(f).alias("field"), (normalize_api(c) if f == "api" else normalize_name(c)).alias("name"))
    names = F.array(*[one(f, F.col(f)) for f in fields])
    if "aliases" in rows.columns and "well_name" in fields:
        names = F.concat(names, F.coalesce(F.transform("aliases", lambda a: one("well_name", a)), F.array().cast("array<struct<field:string,name:string>>")))
    return rows.select(F.inline(F.array_distinct(names)), F.col(key).alias("id")).where("name <> ''")


def name_links(entities: DataFrame, projects: DataFrame) -> DataFrame:
    """field, entity_name, project_name, confidence for classes (name_members of either side) whose names match.

    A class is one row however many rows share its name. "Name in name" goes through postings: of a name's three-letter parts, the one that the fewest names of
    the other side hold is its posting, and only names that hold it are looked at; a name with a part that none of them holds is dropped at
    once. Names of one or two letters meet parts of that length. The confidence of a pair of rows is the sum over the fields in which their classes are linked."""
    e, p = (written(m.select("field", "name").distinct()) for m in (entities, projects))
    same = shuffled(e, p, ["field", "name"]).select("field", "name", F.col("name").alias("part"))
    both = same.toDF("field", "entity_name", "project_name").union(names_within(e, p).toDF("field", "entity_name", "project_name")).union(names_within(p, e).select("field", "part", "name")).distinct()
    weights = F.create_map(*[F.lit(x) for kv in dims.MATCH_WEIGHTS.items() for x in kv])
    return both.withColumn("confidence", F.round(weights[F.col("field")] / 10, 3))


def shuffled(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that never sends a side through the driver: rows exploded from names are taken for as small as the files that the names lie in."""
    return left.join(right.hint("merge"), on, how)


def parts_of(name: Column, length: int) -> Column:
    """The distinct parts of so many letters."""
    n = F.length(name)
    return F.when(n < length, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), n - length + 1), lambda i: F.substring(name, i, F.lit(length)))))


def names_within(long: DataFrame, short: DataFrame) -> DataFrame:
    """field, name, part: names of long that hold a shorter name of short. APIs match whole, never in parts."""
    long, short = (x.where("field <> 'api'") for x in (long, short))
    held = long.select("field", "name", F.explode(parts_of(F.col("name"), 3)).alias("gram"))
    spread = held.groupBy("field", "gram").agg(F.count("*").alias("n"))
    asked = short.where(F.length("name") >= 3).select("field", F.col("name").alias("part"), F.explode(parts_of(F.col("name"), 3)).alias("gram"))
    rarest = shuffled(asked, spread, ["field", "gram"], "left").groupBy("field", "part").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("missing")).where("missing = 0").drop("missing")
    found = shuffled(held, rarest, ["field", "gram"]).where(F.contains("name", F.col("part")) & (F.length("name") > F.length("part")))
    tiny = sent_if_small(written(short.where(F.length("name") < 3).select("field", F.col("name").alias("part"))).hint("merge"))
    pieces = long.select("field", "name", F.explode(F.concat(parts_of(F.col("name"), 1), parts_of(F.col("name"), 2))).alias("part")).where(F.length("name") > F.length("part"))
    return found.select("field", "name", "part").union(pieces.join(tiny, ["field", "part"]).select("field", "name", "part"))


def best_project(matches: DataFrame) -> DataFrame:
    return matches.withColumn("rn", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("confidence"), "project_name"))).where("rn = 1").drop("rn")


def merge_domains(parts: list[DataFrame], key: str = "well_id") -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, key, "full_outer")
    return out


def concat_domain_rows(parts: dict[str, DataFrame], name: str = "file_id") -> DataFrame:
    """Rows of several files in one table, each under its file's name; columns that a file lacks are null."""
    every = [df.withColumn(name, F.lit(k)) for k, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), every)


def depth_tolerance(depth: Column) -> Column:
    return F.when(depth < 10000, 300.0).otherwise(1000.0)


def nearest(k: int, extra: list[str]):
    """For cogrouped queries and events of one cell: of each query its k most similar events, so that pairs never become rows."""

    def unit(column: pa.ChunkedArray, d: int) -> np.ndarray:
        flat = np.array(column.combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(-1, d)
        size = np.sqrt((flat * flat).sum(1, keepdims=True))
        return np.divide(flat, size, out=np.full_like(flat, np.nan), where=size > 0)

    def run(queries: pa.Table, events: pa.Table) -> pa.Table:
        take_q, take_h, cosines = [], [], []
        size = lambda t, c: np.array([-1 if v is None else len(v) for v in t.column(c).to_pylist()])
        q_size, h_size = size(queries, "own"), size(events, "embedding")
        own, well, at, reach, depth = (np.asarray(t.column(c)) for t, c in ((queries, "own_key"), (events, "well_key"), (queries, "own_depth"), (queries, "reach"), (events, "depth")))
        order = np.unique(np.array(events.column("event_id").to_pylist(), object), return_inverse=True)[1] if len(events) else np.empty(0, np.int64)
        for i0 in range(0, len(queries), 256):
            part = np.arange(i0, min(i0 + 256, len(queries)))
            score = np.full((len(part), len(events)), np.nan)
            for d in set(q_size[part].tolist()) & set(h_size.tolist()) - {-1, 0}:
                i, j = np.flatnonzero(q_size[part] == d), np.flatnonzero(h_size == d)
                score[np.ix_(i, j)] = unit(queries.column("own").take(pa.array(part[i])), d) @ unit(events.column("embedding").take(pa.array(j)), d).T
            near = (np.abs(depth[None, :] - at[part, None]) <= reach[part, None]) & (well[None, :] != own[part, None])
            for r, i in enumerate(part.tolist()):
                j = np.flatnonzero(near[r])
                rank = np.where(np.isnan(score[r, j]), -np.inf, score[r, j])  # without a similarity: last
                if len(j) > k:
                    keep = rank >= -np.partition(-rank, k - 1)[k - 1]
                    j, rank = j[keep], rank[keep]
                j = j[np.lexsort((order[j], -rank))[:k]]
                take_q += [i] * len(j)
                take_h += j.tolist()
                cosines += score[r, j].tolist()
        found = events.take(pa.array(take_h, pa.int64()))
        similarity = pa.array(cosines, pa.float64(), from_pandas=True)
        return pa.Table.from_arrays([queries.column("query_id").take(pa.array(take_q, pa.int64())), *[found.column(c) for c in ("event_id", "pad_id", "well_id", "depth")], similarity, *[found.column(c) for c in extra]], ["query_id", "event_id", "pad_id", "well_id", "depth", "cos", *extra])

    return run


def pad_history_risks(current: DataFrame, history: DataFrame, *, k: int = 5, tolerance: float | None = None, block: int = 4096) -> DataFrame:
    """current (query_id, pad_id, depth, embedding) with the k most similar events of other wells on the same pad within a depth
    tolerance; ties by event_id, events without a similarity last.

    The range join is by depth bins: history goes to its own bin, queries to the bins they reach. A bin of more than `block` events or queries is dealt out as cells
    of blocks of both. A cell gives each of its queries its k best; only these meet again."""
    step = 300.0 if tolerance is None else float(tolerance)
    reach = F.lit(step) if tolerance is not None else depth_tolerance(F.col("depth"))
    bins = F.explode(F.sequence(F.floor((F.col("depth") - reach) / step), F.floor((F.col("depth") + reach) / step)))
    extra = [c for c in ("raw_text", "npt_hours", "severity") if c in history.columns]
    q = current.where("depth is not null and pad_id is not null").select("query_id", "pad_id", F.xxhash64("well_id").alias("own_key"), F.col("depth").cast("double").alias("own_depth"), F.col("embedding").alias("own"), reach.cast("double").alias("reach"), bins.alias("bin"))
    h = history.where("depth is not null and pad_id is not null").select("event_id", "pad_id", "well_id", F.xxhash64("well_id").alias("well_key"), F.col("depth").cast("double").alias("depth"), "embedding", *extra, F.floor(F.col("depth") / step).alias("bin"))
    cell = ["pad_id", "bin"]
    hot = lambda x, n: x.groupBy(*cell).agg(F.ceil(F.count("*") / block).alias(n))
    parts = hot(q, "q_parts").join(hot(h, "h_parts"), cell).where("q_parts > 1 or h_parts > 1")
    parts = sent_if_small(written(parts))
    one = lambda c: F.coalesce(c, F.lit(1))
    dealt = lambda x, key, own, other: x.join(parts, cell, "left").withColumn(f"{own}_part", F.pmod(F.xxhash64(key), one(F.col(f"{own}_parts")))).withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0).cast("long"), one(F.col(f"{other}_parts")) - 1))).drop("q_parts", "h_parts")
    h = h.toDF(*h.columns)  # columns of its own, as both sides may come from one table
    keys = [*cell, "q_part", "h_part"]
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"query_id {kind(q, 'query_id')}, event_id {kind(h, 'event_id')}, pad_id {kind(h, 'pad_id')}, well_id {kind(h, 'well_id')}, depth double, cos double" + "".join(f", {c} {kind(h, c)}" for c in extra)
    near = dealt(q, "query_id", "q", "h").groupBy(*keys).cogroup(dealt(h, "event_id", "h", "q").groupBy(*keys)).applyInArrow(nearest(k, extra), schema)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cos"), "event_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "event_id", "pad_id", "well_id", "depth", F.round("cos", 3).alias("similarity"), *extra)


def predictive_flags(matches: DataFrame) -> DataFrame:
    return matches.where("rank = 1").select("query_id", F.lit("PREDICTIVE_RISK").alias("code"), F.format_string("Similar event on pad %s (similarity %s): %s", F.col("pad_id").cast("string"), F.col("similarity").cast("string"), F.substring("raw_text", 1, 100)).alias("message"))


def route_files(files: DataFrame, lexicon: dict[str, list[str]] | None = None, safety: list[str] | None = None, *, head: tuple[int, int] | None = None) -> DataFrame:
    """path, domain: by type, by discipline where the type says auto; documents with safety words go to hse too; a domain nobody
    is routed to gets every file (files: path, detected_type, text). Whole texts are read; head: so many first characters only, for
    disciplines and for safety words (the reference's are 3000 and 2000)."""
    lexicon = lexicon or dims.DISCIPLINES
    whole = F.coalesce("text", F.lit(""))
    low, low_safety = (F.lower(whole if head is None else F.substring(whole, 1, n)) for n in head or (None, None))
    best = arg_max({c: hits(low, t) / len(t) for c, t in lexicon.items()})
    names = F.create_map(*[F.lit(x) for kv in dims.TYPE_ROUTES.items() for x in kv])
    domain_of = F.create_map(*[F.lit(x) for kv in dims.DISCIPLINE_ROUTES.items() for x in kv])
    direct = F.coalesce(F.try_element_at(names, F.col("detected_type")), F.lit("auto"))
    domain = F.when(direct == "auto", F.coalesce(F.try_element_at(domain_of, F.when(best["score"] < 0.05, "unknown").otherwise(best["name"])), F.lit("drilling"))).otherwise(direct)
    also = F.when(F.col("detected_type").isin("pdf_document", "word_document", "text_file") & contains_any(low_safety, safety or dims.SAFETY_ROUTE), F.lit("hse"))
    routes = files.select("path", F.explode(F.array_distinct(F.array_compact(F.array(domain, also)))).alias("domain"))
    every = ["drilling", "logs", "completions", "production", "directional", "hse"]
    spark = files.sparkSession
    empty = spark.createDataFrame([(d,) for d in every], "domain string").join(routes.select("domain").distinct(), "domain", "left_anti")
    return routes.union(files.select("path").crossJoin(F.broadcast(empty)))


def routing_summary(routes: DataFrame) -> DataFrame:
    return routes.groupBy("domain").agg(F.count("*").alias("files"))


def drop_finished(work: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("task_id", "domain")) -> DataFrame:
    return work.join(done, list(keys), "left_anti")
