"""Types of the data model and the closed vocabulary of entity types with their colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRIPLE = "struct<subject:string,relationship:string,object:string>"
CHUNK_INFO = f"source string, chunk string, entities map<string,string>, triples array<{TRIPLE}>"
MULTIHOP_ROW = (
    "id string, paragraphs array<struct<idx:int,title:string,paragraph_text:string>>, question string, "
    "question_decomposition array<struct<question:string>>, answer string, answer_aliases array<string>, answerable boolean"
)
WEB_ROW = (
    "interaction_id string, query_time string, domain string, question_type string, static_or_dynamic string, query string, answer string, "
    "search_results array<struct<page_name:string,page_url:string,page_snippet:string,page_result:string,page_last_modified:string>>, split int, alt_ans array<string>"
)
MESSAGES = "array<struct<role:string,content:string>>"
SPAN = "struct<start:int,end:int,text:string,label:string,score:double>"

_TYPES = "animal currency date disease event food language law location medical nationality organization person plant product religion scientific_term sport weapon work_of_art"
_COLORS = "royalblue olive deepskyblue tomato gold saddlebrown chocolate slategray mediumseagreen orchid darkgreen darkorange crimson forestgreen mediumvioletred firebrick teal navy black indigo"
COLOR_OF = dict(zip(_TYPES.split(), _COLORS.split(), strict=True))
PLAIN = "lightgray"


def color_of(entity_type: Column) -> Column:
    """The colour of an entity type; null for a null or unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in COLOR_OF.items() for x in pair]), F.coalesce(entity_type, F.lit("")))


def color_case(column: str) -> str:
    """The same as a CASE in SQL."""
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COLOR_OF.items()) + " END"
