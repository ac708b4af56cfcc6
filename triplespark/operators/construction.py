"""From chunks to chunk-info rows and to a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import recognise, triples_in
from ..models import EntityModel, LanguageModel, ask
from ..sources.corpora import triples_of
from .graph import KnowledgeGraph

_PROMPT = "Write each fact of the passage as {'subject': .., 'relationship': .., 'object': ..} about these entities: "


def extract(chunks: DataFrame, entities: EntityModel, model: LanguageModel, max_len: int = 384) -> DataFrame:
    """Chunk-info rows (file_idx, chunk_idx, source, chunk, entities, triples) of chunks (file_idx, chunk_idx, source,
    chunk). Executors work on chunks in parallel; order is a column, so the outcome doesn't depend on who is first."""
    keyed = chunks.withColumn("__k", F.col("file_idx").cast("long") * F.lit(1 << 32) + F.col("chunk_idx"))
    found = recognise(keyed, entities, max_len, key="__k", text="chunk")
    maps = found.groupBy("__k").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity", "label")))).alias("entities"))
    joined = keyed.join(maps, "__k", "left").withColumn("entities", F.coalesce("entities", F.expr("cast(map() as map<string,string>)")))
    names = F.array_join(F.array_sort(F.map_keys("entities")), ", ")
    asked = ask(joined.withColumn("prompt", F.concat(F.lit(_PROMPT), names, F.lit("\n\n"), F.col("chunk"))), model)
    return asked.select("file_idx", "chunk_idx", "source", "chunk", "entities", triples_in(F.coalesce("response", F.lit(""))).alias("triples"))


def build_graph(chunk_rows: DataFrame) -> KnowledgeGraph:
    return KnowledgeGraph.of(triples_of(chunk_rows))
