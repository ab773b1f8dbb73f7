"""Extraction records -> ontology checks -> resolved property graph."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import context as cx
from lodestone.functions import text as tx
from lodestone.sources.shared import shared_copy

# The ontology (fixed values).
ENTITY_TYPES = ("Person", "Company", "Organization", "Team", "Country", "Location", "Venue", "Sport", "Outcome", "Entity")
EDGES = {
    "INITIATED_BY": ("initiated_by", ("Person", "Company", "Organization", "Team", "Country")),
    "TOOK_PLACE_AT": ("took_place_at", ("Location", "Venue", "Country")),
    "AFFECTED": ("affected", ("Person", "Company", "Organization", "Team", "Country", "Location")),
    "RESULTED_IN": ("resulted_in", ("Outcome",)),
}
RECORD = (
    "chunk_id string, doc_id string, entities array<struct<name:string,type:string,description:string>>, "
    "action_events array<struct<name:string,action_type:string,description:string,impact_summary:string,"
    "initiated_by:array<string>,took_place_at:array<string>,affected:array<string>,resulted_in:array<string>>>"
)


class Graph(NamedTuple):
    vertices: DataFrame  # vtype, vid, name, description, mentioned_in
    events: DataFrame  # vid, name, action_type, description, impact_summary, mentioned_in
    edges: DataFrame  # etype, from_type, from_id, to_type, to_id
    aliases: DataFrame  # raw_name, vtype, vid


def _ord(pos: str) -> Column:
    return F.struct("chunk_ord", F.col(pos).alias("item"))


def entities(records: DataFrame) -> DataFrame:
    """records(RECORD, chunk_ord) -> a row per entity that is named and typed."""
    rows = records.select("chunk_id", "chunk_ord", F.posexplode("entities").alias("pos", "e")).select("chunk_id", _ord("pos").alias("ord"), tx.strip(F.col("e.name")).alias("name"), F.col("e.type").alias("vtype"), F.col("e.description").alias("description"))
    rows = rows.where(F.col("vtype").isin(*ENTITY_TYPES) & (F.coalesce("name", F.lit("")) != "")).withColumn("vid", tx.normalize_name(F.col("name")))
    return rows.where("vid <> ''")


def mode(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key; of ties the first seen."""
    counts = rows.where(F.coalesce(value, F.lit("")) != "").groupBy(*keys, value).agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), "first")).alias(value))


def _first_text(name: str) -> Column:
    """The first text that is not empty."""
    return F.coalesce(F.min_by(tx.strip(F.col(name)), F.when(F.coalesce(name, F.lit("")) != "", F.col("ord"))), F.lit("")).alias(name)


def entity_merge(ents: DataFrame) -> DataFrame:
    """entities() -> vtype, vid, name, description, mentioned_in."""
    keys = ["vtype", "vid"]
    rest = ents.groupBy(*keys).agg(_first_text("description"), F.sort_array(F.collect_set("chunk_id")).alias("mentioned_in"))
    return mode(ents, keys, "name").join(rest, keys)


def alias_map(ents: DataFrame) -> DataFrame:
    """raw_name -> the (vtype, vid) it is first seen with."""
    return ents.groupBy(F.col("name").alias("raw_name")).agg(F.min_by(F.struct("vtype", "vid"), "ord").alias("a")).select("raw_name", "a.vtype", "a.vid")


def raw_events(records: DataFrame) -> DataFrame:
    rows = records.select("chunk_id", "chunk_ord", F.posexplode("action_events").alias("pos", "e")).select("chunk_id", _ord("pos").alias("ord"), "e.*").withColumn("name", tx.strip(F.col("name")))
    return rows.withColumn("vid", tx.normalize_name(F.col("name"))).where("vid <> ''")


def event_merge(events: DataFrame) -> DataFrame:
    """raw_events() -> vid, name, action_type, description, impact_summary, mentioned_in."""
    rest = events.groupBy("vid").agg(_first_text("description"), _first_text("impact_summary"), F.sort_array(F.collect_set("chunk_id")).alias("mentioned_in"))
    types = mode(events, ["vid"], "action_type")
    return mode(events, ["vid"], "name").join(rest, "vid").join(types, "vid", "left").select("vid", "name", F.coalesce("action_type", F.lit("")).alias("action_type"), "description", "impact_summary", "mentioned_in")


def _allowed(etype: Column, vtype: Column) -> Column:
    out = F.lit(False)
    for name, (_, types) in EDGES.items():
        out = out | ((etype == name) & vtype.isin(*types))
    return out


def relations(events: DataFrame) -> DataFrame:
    """A row per relation target: etype, vid, chunk_id, raw_name."""
    pairs = F.array(*[F.struct(F.lit(name).alias("etype"), F.coalesce(F.col(field), F.array().cast("array<string>")).alias("targets")) for name, (field, _) in EDGES.items()])
    rows = events.select("vid", "chunk_id", F.explode(pairs).alias("r"))
    return rows.select("vid", "chunk_id", "r.etype", F.explode("r.targets").alias("raw_name"))


def relation_edges(events: DataFrame, aliases: DataFrame) -> DataFrame:
    """Relations whose target is a known alias of an allowed type."""
    rows = relations(events).join(aliases.withColumnsRenamed({"vtype": "to_type", "vid": "to_id"}), "raw_name")
    rows = rows.where(_allowed(F.col("etype"), F.col("to_type")))
    return rows.select("etype", F.lit("ActionEvent").alias("from_type"), F.col("vid").alias("from_id"), "to_type", "to_id").distinct()


def grounding(vertices: DataFrame, events: DataFrame) -> DataFrame:
    every = vertices.select("vtype", "vid", "mentioned_in").union(events.select(F.lit("ActionEvent").alias("vtype"), "vid", "mentioned_in"))
    rows = every.select(F.lit("MENTIONED_IN").alias("etype"), F.col("vtype").alias("from_type"), F.col("vid").alias("from_id"), F.lit("Chunk").alias("to_type"), F.explode("mentioned_in").alias("to_id"))
    return rows.where("to_id <> ''")


def resolve(records: DataFrame) -> Graph:
    ents, evs = shared_copy(entities(records), "entities"), shared_copy(raw_events(records), "events")
    vertices, events, aliases = shared_copy(entity_merge(ents), "vertices"), shared_copy(event_merge(evs), "merged-events"), alias_map(ents)
    return Graph(vertices, events, relation_edges(evs, aliases).unionByName(grounding(vertices, events)), aliases)


def event_contexts(events: DataFrame, titles: DataFrame, sports: DataFrame) -> DataFrame:
    """events with `context`: from their names, gaps filled from the title of the
    first chunk (by id) whose document has one. titles(doc_id, title), cx.sports()."""
    chunks = events.select("vid", F.explode("mentioned_in").alias("chunk_id")).withColumn("doc_id", tx.doc_of_chunk(F.col("chunk_id")))
    first = chunks.join(titles.where(F.coalesce("title", F.lit("")) != ""), "doc_id").groupBy("vid").agg(F.min_by("title", "chunk_id").alias("title"))
    both = cx.with_context(cx.with_context(events.join(first, "vid", "left"), "name", sports, "_own"), "title", sports, "_doc")
    return both.withColumn("context", cx.merge_contexts(F.col("_own"), F.col("_doc"))).drop("title", "_own", "_doc")


def validate(records: DataFrame) -> DataFrame:
    """chunk_id, n_entities, n_events, n_relations, dropped: what the ontology keeps
    of each record. A relation target stays if the type its name has first in the
    record is allowed for the edge."""
    ents = F.filter("entities", lambda e: e["type"].isin(*ENTITY_TYPES) & (F.coalesce(e["name"], F.lit("")) != ""))
    named = F.filter("action_events", lambda e: F.coalesce(e["name"], F.lit("")) != "")
    rows = records.select("chunk_id", F.size("entities").alias("n0"), F.size("action_events").alias("v0"), ents.alias("ents"), named.alias("evs"))

    def kept(field: str, types: tuple) -> Column:
        def type_of(n):
            return F.get(F.filter("ents", lambda e: e["name"] == n), F.lit(0))["type"]

        one = lambda e: F.size(F.filter(F.coalesce(e[field], F.array().cast("array<string>")), lambda n: F.coalesce(type_of(n).isin(*types), F.lit(False))))
        return F.aggregate("evs", F.lit(0), lambda s, e: s + one(e))

    given = lambda field: F.aggregate("evs", F.lit(0), lambda s, e: s + F.size(F.coalesce(e[field], F.array().cast("array<string>"))))
    stay = sum((kept(f, t) for f, t in EDGES.values()), F.lit(0))
    there = sum((given(f) for f, _ in EDGES.values()), F.lit(0))
    return rows.select("chunk_id", F.size("ents").cast("long").alias("n_entities"), F.size("evs").cast("long").alias("n_events"), stay.cast("long").alias("n_relations"), ((F.col("n0") - F.size("ents")) + (F.col("v0") - F.size("evs")) + there - stay).cast("long").alias("dropped"))


def context_members(events: DataFrame) -> DataFrame:
    """events(vid, context) -> key, display, vid: the events of each context key, a row
    each. Games keys are shown as '<year> olympics'; where one year has both seasons, each
    season has a key too."""
    rows = events.where("context is not null").select("vid", F.col("context.root_context").alias("root"), F.explode("context.context_keys").alias("key"))
    year = F.regexp_replace("key", "^[^:]*:", "")
    display = F.when(F.startswith("key", F.lit("olympics:")), F.concat(year, F.lit(" olympics"))).otherwise(cx.key_display(F.col("key")))
    plain = rows.select("key", display.alias("display"), "vid").distinct()
    games = rows.where(F.startswith("key", F.lit("olympics:"))).withColumn("season", cx.season_of(F.col("root"))).where("season <> ''")
    both = games.groupBy("key").agg(F.min("season").alias("lo"), F.max("season").alias("hi"), F.max("root").alias("top")).where("lo <> hi").select("key")
    roots = games.join(both, "key").groupBy("key", "season").agg(F.lower(F.max("root")).alias("display"))
    sub = games.join(roots, ["key", "season"]).select(F.concat_ws("_", "key", "season").alias("key"), "display", "vid").distinct()
    return plain.unionByName(sub)


def context_index(events: DataFrame) -> DataFrame:
    """context_members() as one row for each key, for export: key, display, vertex_ids."""
    return context_members(events).groupBy("key", "display").agg(F.sort_array(F.collect_set("vid")).alias("vertex_ids"))


def entity_index(vertices: DataFrame, embed=None) -> DataFrame:
    """vertices(vtype, vid, name) -> idx, vtype, vid, name, norm [, embedding]: chunks and
    nameless vertices aside, numbered by type and id. embed(norm) adds vectors."""
    rows = vertices.where("vtype <> 'Chunk'").withColumn("norm", tx.normalize_name(F.col("name"))).where("norm <> ''")
    # numbers that grow with (vtype, vid): a range sort, then a place inside its part
    parts = shared_copy(rows.repartitionByRange("vtype", "vid").sortWithinPartitions("vtype", "vid").withColumn("_part", F.spark_partition_id()), "catalog")
    lead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(lead), F.lit(0)).alias("_lead"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("vtype", "vid"))
    out = parts.join(sizes, "_part").select((F.col("_lead") + rank - 1).alias("idx"), "vtype", "vid", "name", "norm")
    return out if embed is None else out.withColumn("embedding", embed(F.col("norm")))
