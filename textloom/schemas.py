"""Explicit schemas of all entities. A recursive hierarchy is an edge table (item_id, parent_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = "id string not null, text string not null, metadata string, embedding array<float>, cluster_id string"
PAIR = "pair_id long, id_a string, text_a string, id_b string, text_b string"
VERDICT = "pair_id long, doc_id_a string, doc_id_b string, is_similar boolean, confidence double, reasoning string"
CLUSTER_VERDICT = "cluster_id string, is_valid boolean, members_to_remove array<string>, reasoning string"
KNOWN_PAIR = "text_a string, text_b string, expected_similar boolean"
CONTEXT = "struct<sentence:string,source_file:string,char_start:int,char_end:int>"
TERM = f"term string, term_type string, tfidf_score double, document_frequency long, sample_contexts array<{CONTEXT}>, is_valid_entity boolean, embedding array<float>"
TERM_CLUSTER = f"cluster_id string, terms array<string>, sample_contexts array<{CONTEXT}>, suggested_name string"
TOPIC = f"id string, canonical_name string, description string, terms array<string>, parent_topic_id string, children array<string>, embedding array<double>, sample_contexts array<{CONTEXT}>"
HIERARCHY = "item_id string, parent_id string, position int, name string, description string, terms array<string>"
_TOPIC = f"struct<id:string,canonical_name:string,description:string,terms:array<string>,parent_topic_id:string,children:array<string>,embedding:array<double>,sample_contexts:array<{CONTEXT}>>"
TAXONOMY = f"topics array<{_TOPIC}>, term_to_topic map<string,string>, root_topics array<string>, created_at string, source_stats map<string,string>"
ENTITY = "name string, entity_type string, confidence double"
SENTIMENT = "sentiment string, score double, explanation string"


def within(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """The same rows; any value outside [low, high] is an error."""
    c = F.col(column)
    return df.withColumn(column, F.when(c.between(low, high) | c.isNull(), c).otherwise(F.raise_error(F.format_string(f"{column} %s is outside [{low}, {high}]", c.cast("string"))).cast("double")))


def json_schema(kind: T.DataType | str) -> dict:
    """Strict JSON schema of a type: every property required, none added, nullable ones may be null."""
    kind = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
    if isinstance(kind, T.StructType):
        found = {f.name: json_schema(f.dataType) for f in kind}
        for f in kind:
            if f.nullable and isinstance(found[f.name].get("type"), str):
                found[f.name]["type"] = [found[f.name]["type"], "null"]
        return {"type": "object", "properties": found, "required": list(found), "additionalProperties": False}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    if isinstance(kind, T.MapType):
        return {"type": "object", "additionalProperties": json_schema(kind.valueType)}
    names = {T.BooleanType: "boolean", T.IntegerType: "integer", T.LongType: "integer", T.FloatType: "number", T.DoubleType: "number"}
    return {"type": names.get(type(kind), "string")}
