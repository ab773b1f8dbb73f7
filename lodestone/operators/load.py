"""Loading a resolved graph: vertex and edge tables, schema, context backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import upsert
from .resolve import EDGES, ENTITY_TYPES

#: Attributes that the context backfill adds to events.
CONTEXT = ("root_context", "context_path", "context_keys", "context_level")
#: Tables of a stored graph and their columns.
TABLES = {
    "vertices": "vtype string, vid string, name string, description string",
    "events": "vid string, name string, action_type string, description string, impact_summary string",
    "chunks": "chunk_id string, doc_id string, title string, chunk_index string, url string",
    "edges": "etype string, from_type string, from_id string, to_type string, to_id string",
}
CONTEXT_COLUMNS = "root_context string, context_path array<string>, context_keys array<string>, context_level string"
#: The field of an extraction record that each edge type comes from.
FIELD_OF_EDGE = {name: field for name, (field, _) in EDGES.items()}


def referenced_chunks(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """The chunks that some vertex is mentioned in, one row each."""
    used = edges.where("etype = 'MENTIONED_IN'").select(F.col("to_id").alias("chunk_id"))
    row = F.struct(*chunks.columns)
    return chunks.join(used, "chunk_id", "left_semi").groupBy(F.col("chunk_id").alias("_c")).agg(F.min(row).alias("r")).select("r.*")


def gated(events: DataFrame, declared: bool) -> DataFrame:
    """events without their context attributes until the schema declares those."""
    return events if declared else events.drop(*CONTEXT)


def backfill(events: DataFrame, contexts: DataFrame) -> DataFrame:
    """events(vid, ...) with the attributes of contexts(vid, context): only events whose
    context has a key change, and only in those attributes."""
    c = contexts.where(F.size(F.coalesce("context.context_keys", F.array().cast("array<string>"))) > 0)
    c = c.select(F.col("vid").alias("_v"), *[F.col(f"context.{a}").alias(f"_{a}") for a in CONTEXT])
    rows = events.join(c, F.col("vid") == F.col("_v"), "left")
    old = {a: F.col(a) if a in events.columns else F.lit(None) for a in CONTEXT}
    return rows.select(*[x for x in events.columns if x not in CONTEXT], *[F.coalesce(F.col(f"_{a}"), old[a]).alias(a) for a in CONTEXT])


def ddl(prefix: str, contexts: bool = False) -> list[str]:
    """The statements that create a graph's tables, if they are missing."""
    return [f"CREATE TABLE IF NOT EXISTS {prefix}_{name} ({columns}{', ' + CONTEXT_COLUMNS if contexts and name == 'events' else ''}) USING PARQUET" for name, columns in TABLES.items()]


def create(spark: SparkSession, prefix: str, contexts: bool = False) -> None:
    for statement in ddl(prefix, contexts):
        spark.sql(statement)


def add_columns(spark: SparkSession, table: str, wanted: str, dry_run: bool = False) -> dict[str, list[str]]:
    """Columns of `wanted` that the table lacks, added unless dry_run: {added, present}."""
    have = {f.name for f in spark.table(table).schema.fields}
    want = T.StructType.fromDDL(wanted)
    lack = [f for f in want.fields if f.name not in have]
    if lack and not dry_run:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in lack)})")
    return {"added": [f.name for f in lack], "present": [f.name for f in want.fields if f.name in have]}


def unknown_types(vertices: DataFrame) -> DataFrame:
    """Vertex types that the ontology does not have, and how many vertices have them."""
    return vertices.where(~F.col("vtype").isin(*ENTITY_TYPES, "ActionEvent", "Chunk")).groupBy("vtype").agg(F.count("*").alias("n"))


def merged(stored: dict[str, DataFrame], fresh: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after a load: rows of the same keys are replaced, edges united."""
    keys = {"vertices": ["vtype", "vid"], "events": ["vid"], "chunks": ["chunk_id"]}
    out = {name: upsert(stored[name], fresh[name], k) for name, k in keys.items()}
    return out | {"edges": stored["edges"].unionByName(fresh["edges"]).distinct()}
