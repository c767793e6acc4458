"""Record types, their enumerations and validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The enumerations of the data model.
NODE_TYPES = ("knowledge_gap", "capability_gap", "data_gap", "infrastructure_gap", "theoretical_gap", "engineering_bottleneck")
GRANULARITIES = ("L0", "L1", "L2", "L3")
STATUSES = ("open", "partially_resolved", "resolved", "obsolete")
EXTRACTION_METHODS = ("llm_extracted", "citation_inferred", "pattern_matched", "expert_curated")
SOURCE_TYPES = ("paper", "patent", "grant", "curated_list")
EDGE_TYPES = ("ENABLES", "PRODUCES_FOR")

REF = T.StructType([T.StructField(n, T.StringType()) for n in ("source_type", "source_id", "evidence_quote")])
_S, _D, _B, _I, _TS = T.StringType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.TimestampNTZType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


NODE = _schema(
    node_id=_S, type=_S, granularity=_S, title=_S, description=_S, fields=T.ArrayType(_S), status=_S, confidence=_D, sources=T.ArrayType(REF),
    extraction_method=_S, suggested_parent=_S, cross_field_ref=_B, parent_id=_S, children_ids=T.ArrayType(_S), created_at=_TS, last_validated=_TS,
)
EDGE = _schema(
    edge_id=_S, type=_S, source_node_id=_S, target_node_id=_S, strength=_D, confidence=_D, mechanism=_S, evidence=T.ArrayType(REF), extraction_method=_S, historically_preceded=_B, created_at=_TS,
)
PAPER = _schema(id=_S, title=_S, abstract=_S, doi=_S, year=_I, cited_by_count=_I, fields=T.ArrayType(_S), is_review=_B, oa_url=_S, source=_S)
GRANT = _schema(id=_S, title=_S, abstract=_S, agency=_S, year=_I, amount=_D, source=_S)
SCORE = _schema(node_id=_S, leverage=_D, components=_schema(cascade=_D, cross_field=_D, bottleneck=_D))


def node_defaults(df: DataFrame) -> DataFrame:
    """Absent optional values of a node take their defaults; titles over 200 letters are clamped."""
    from fulcrum.functions.text import clamp_title

    return df.withColumns(
        {
            "title": clamp_title("title"),
            "fields": F.coalesce("fields", F.array().cast("array<string>")),
            "status": F.coalesce("status", F.lit("open")),
            "confidence": F.coalesce("confidence", F.lit(0.7)),
            "extraction_method": F.coalesce("extraction_method", F.lit("llm_extracted")),
            "cross_field_ref": F.coalesce("cross_field_ref", F.lit(False)),
        }
    )


def node_is_valid() -> Column:
    """Required values present, enumerated values known.  Ranges are not checked."""
    return F.coalesce(
        F.col("type").isin(*NODE_TYPES) & F.col("granularity").isin(*GRANULARITIES) & F.col("title").isNotNull() & F.col("description").isNotNull()
        & F.coalesce("status", F.lit("open")).isin(*STATUSES) & F.coalesce("extraction_method", F.lit("llm_extracted")).isin(*EXTRACTION_METHODS)
        & F.forall(F.coalesce("sources", F.array().cast(T.ArrayType(REF))), lambda s: s["source_type"].isin(*SOURCE_TYPES)),
        F.lit(False),
    )


def edge_is_valid() -> Column:
    return F.coalesce(F.col("type").isin(*EDGE_TYPES) & F.col("source_node_id").isNotNull() & F.col("target_node_id").isNotNull(), F.lit(False))


def split_valid(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Valid records, and the quarantine of the others; nothing is lost."""
    return df.filter(valid), df.filter(~valid)
