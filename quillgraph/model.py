"""Closed vocabularies and table schemas of the relationship graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The vocabularies that results are expressed in.
ENTITY_TYPES = (
    "person", "organization", "pac", "agency", "candidate", "contract", "lobbying_reg", "place", "topic", "event", "concept", "bill", "unknown",
)
SURFACE_MODES = ("open", "alias", "suppress")  # by growing strictness
PUBLICATION_STATES = ("published", "staged")
RELATIONS = (
    "contributes_to", "holds_contract", "lobbies", "subsidiary_of", "exec_of", "affiliated_with", "mentioned_with", "tagged_as",
    "voted_for", "voted_against", "holds_asset", "income_from", "held_position", "owes", "party_to_agreement", "traded",
)
SOURCE_KINDS = (
    "article_permalink", "fec_filing", "usaspending_award", "senate_lda", "congress_vote", "congress_roster", "corporate_registry", "oge_278e", "oge_278t",
)
DISCLOSURE_RELATIONS = ("holds_asset", "income_from", "held_position", "owes", "traded", "party_to_agreement")
REPAIR_RELATIONS = tuple(r for r in DISCLOSURE_RELATIONS if r != "traded")

# Alias systems that carry a real identity, and the namespace each stands for.
IDENTITY_NAMESPACES = {
    "sec.cik": "sec_cik", "fec.committee": "fec_committee", "fec.disbursement.recipient": "fec_committee", "fec.candidate": "fec_candidate",
    "bioguide": "bioguide", "congress.bill": "congress_bill",
}
NAMESPACE_TYPE = {"sec_cik": "organization", "fec_committee": "pac", "fec_candidate": "person", "bioguide": "person", "congress_bill": "bill"}
TYPE_AUTHORITY = {
    "agency": 70, "pac": 60, "bill": 55, "person": 50, "candidate": 45, "organization": 40, "contract": 35, "lobbying_reg": 34, "event": 30,
    "place": 25, "concept": 20, "topic": 15, "unknown": 0,
}

_s, _f = T.StringType(), T.StructField
ENTITIES = T.StructType([
    _f("id", _s), _f("canonical_name", _s), _f("canonical_name_normalized", _s), _f("type", _s), _f("embedding", T.ArrayType(T.FloatType())),
    _f("surface_mode", _s), _f("public_alias", _s), _f("publication_state", _s), _f("batch_id", _s), _f("created_at", T.TimestampType()),
])
ALIASES = T.StructType([
    _f("canonical_id", _s), _f("source_system", _s), _f("source_id", _s), _f("surface_name", _s), _f("surface_name_normalized", _s),
    _f("kind_hint", _s), _f("confidence", T.DoubleType()),
])
EDGES = T.StructType([
    _f("id", _s), _f("source_id", _s), _f("target_id", _s), _f("relation", _s), _f("weight", T.DoubleType()), _f("edge_metadata", _s),
    _f("publication_state", _s), _f("batch_id", _s),
])
CITATIONS = T.StructType([
    _f("id", _s), _f("edge_id", _s), _f("kind", _s), _f("citation_url", _s), _f("citation_ref", _s), _f("disclosure_row_id", _s), _f("page", T.IntegerType()),
])
SCRUTINY = T.StructType([_f(c, _s) for c in ("canonical_id", "classification", "decision", "signals_used", "reason", "decided_by")])


@dataclass
class Graph:
    """The graph as DataFrames; every operator takes what it needs from here and changes nothing."""

    entities: DataFrame
    aliases: DataFrame
    edges: DataFrame
    citations: DataFrame
    scrutiny: DataFrame | None = None
