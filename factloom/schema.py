"""Ontology, rule tables and nested schemas, declared once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# They must equal the established vocabularies for results to agree.
ENTITY_TYPES = ["agreement", "asset", "company", "other", "person"]
RELATION_TYPES = ["controls", "governs", "participates_in", "related_to", "represents", "transfers_to"]
DIRECTION_RULES = {
    "controls": (["person", "company"], ["person", "company", "asset", "claim"]),
    "participates_in": (["person", "company"], ["agreement", "claim"]),
    "represents": (["person", "company"], ["person", "company"]),
    "transfers_to": (["asset", "claim", "agreement"], ["person", "company"]),
    "governs": (["agreement", "claim", "asset"], ["person", "company", "asset"]),
    "related_to": (["any"], ["any"]),
}
CLASS_TYPES = {"person": "person", "company": "company", "agreement": "agreement", "asset": "asset", "otherentity": "other", "other": "other"}
TYPE_SYNONYMS = {
    "person": "person", "per": "person", "people": "person", "individual": "person",
    "company": "company", "organization": "company", "organisation": "company", "org": "company",
    "business": "company", "corporation": "company", "subsidiary": "company", "firm": "company",
    "agreement": "agreement", "contract": "agreement",
    "asset": "asset",
    "other": "other", "misc": "other", "miscellaneous": "other",
}
#: Suffix words that plain name normalisation drops anywhere.
SUFFIX_WORDS = ["inc", "corp", "corporation", "llc", "ltd", "limited", "company", "co", "plc", "group", "holdings"]
#: Words that lenient matching drops anywhere.
LENIENT_WORDS = """inc incorporated corp corporation llc llp lp ltd limited plc co company gmbh ag kg ug se sa nv bv ou ulc spc pte pty srl spa ab as
oy ohg mbh ev the und and of""".split()
#: Legal forms that alias keys drop at the end.
LEGAL_FORMS = """gmbh ag kg ug ohg gbr se mbh ev inc incorporated llc ltd limited plc corp corporation co company sa nv bv lp llp""".split()
ARTICLES = ["the", "der", "die", "das"]
GENERIC_TERMS = """company parties party agreement contract seller buyer lender borrower gesellschaft vertrag vereinbarung partei parteien auftraggeber
auftragnehmer versicherer versicherungsnehmer kunde bank""".split()
#: What a definition in brackets begins with, what may follow, what links it to its short form; and what precedes a former name.
DEFINITION_LEADS = ["hereinafter", "nachfolgend", "im folgenden", "im nachfolgenden", "together"]
DEFINITION_ALSO = ["auch", "also"]
DEFINITION_LINKS = ["referred to as", "genannt", "bezeichnet als"]
FORMER_LEADS = [
    "formerly", "formerly known as", "f/k/a", "fk/a", "f/ka", "fka", "vormals", "ehemals", "früher", "previously", "previously known as",
    "also known as", "a/k/a", "ak/a", "a/ka", "aka", "auch bekannt als",
]
QUOTE_MARKS = "\"'“”„‚‘’«»"
#: Words inside names that are not capitalised.
NAME_WORDS = ["&", "of", "und", "and", "de", "für"]
# End of fixed values.

CITATION = "struct<file_id:string,chunk_id:int,start_char:int,end_char:int,quote:string,match:string>"
ENTITY = f"struct<entity_id:string,canonical_name:string,entity_type:string,aliases:array<string>,citations:array<{CITATION}>>"
RELATIONSHIP = f"struct<source_entity_id:string,target_entity_id:string,relationship_type:string,citation:{CITATION}>"
OUTPUT = f"entities array<{ENTITY}>, relationships array<{RELATIONSHIP}>"
MENTION = "struct<text:string,start:int,`end`:int>"
COVERAGE = "struct<exhaustive_entity_types:array<string>,exhaustive_relations:boolean,relation_types:array<string>,has_coref:boolean,has_types:boolean>"
GOLD = (
    f"doc_id string, text string, entities array<struct<id:string,name:string,type:string,aliases:array<string>,mentions:array<{MENTION}>>>,"
    f" relations array<struct<source:string,type:string,target:string,evidence:string>>, coverage {COVERAGE}, meta map<string,string>"
)
PROVENANCE_CELL = "struct<document_id:string,match:string,chunks:array<int>,pages:array<int>,refs:array<string>>"
PROVENANCE = (
    "version int, chunks map<string,struct<chunk_id:int,text:string,char_length:int,token_count:int>>,"
    " nodes map<string,struct<node_type:string,ids:struct<name:string>,anchors:array<struct<document_id:string,chunk_id:int,kind:string,span:array<int>>>>>"
)
MODEL_USE = "struct<calls:bigint,prompt_tokens:bigint,completion_tokens:bigint,cost_usd:double>"
OPS = (
    "run_id string, backend string, status string, error string, started_at string, latency_s double, stages_s map<string,double>,"
    " llm struct<calls:bigint,errors:bigint,prompt_tokens:bigint,completion_tokens:bigint,cost_usd:double,llm_seconds:double,"
    f"by_model:map<string,{MODEL_USE}>>, trace_id string, git struct<sha:string,branch:string,dirty:boolean>, meta map<string,string>"
)


def rules_table(spark: SparkSession) -> DataFrame:
    """(relation, source_type, target_type) of every allowed triple; "any" stands for all types."""
    rows = [(r, s, t) for r, (sources, targets) in DIRECTION_RULES.items() for s in sources for t in targets]
    return spark.createDataFrame(rows, "relation string, source_type string, target_type string")
