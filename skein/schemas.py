"""Fixed schemas of the code graph. Every table is one of these."""

from __future__ import annotations

FORMAT_VERSION = 2

KINDS = ("File", "Class", "Interface", "Function", "Method", "Property", "Enum", "TypeAlias", "Test")
LANGS = ("ts", "go", "cs", "py")
EDGE_KINDS = ("CONTAINS", "DEFINES", "IMPORTS", "CALLS", "USES", "EXTENDS", "IMPLEMENTS", "OVERRIDES", "TESTS")
PROVENANCES = ("deterministic", "inferred", "learned")
#: In display order.
DISPOSITIONS = (
    "resolved", "external-known", "external-unknown", "dynamic", "ambiguous", "unimplemented", "bug-extractor", "bug-resolver", "unclassified",
)
BUGS = ("bug-extractor", "bug-resolver")

ANCHOR = "struct<file:string,start_byte:bigint,end_byte:bigint,start_line:int,end_line:int,content_hash:string>"
FILES = "path string, rel_path string, content binary"
ENTITIES = (
    "entity_id string, kind string, lang string, repo string, qualified string, name string, "
    f"signature string, doc_summary string, anchor {ANCHOR}"
)
REFS = (
    "ref_id bigint, file string, lang string, kind string, src string, scope string, module string, name string, member string, "
    "receiver_type string, start_byte bigint, start_line int"
)
IMPORTS = "file string, ord int, local_name string, source string, imported_name string, is_namespace boolean, is_default boolean"
REEXPORTS = "file string, ord int, source string, is_star boolean, exported_name string, local_alias string"
EXT_METHODS = "file string, entity_id string, name string, extended_type string"
FIELD_TYPES = "file string, owner string, field string, type string"
EDGES = "edge_id string, src string, dst string, kind string, confidence float, provenance string, evidence string, src_file string"
RESOLVED = "ref_id bigint, file string, disposition string, dst string, candidates array<string>, reason string"
DISPOSITION_COUNTS = "repo string, file string, disposition string, n bigint"
PAIRS = "a string, b string, exact boolean, structural double, behavioral double, overall double"
LEDGER = "repo string, session_id string, entity_id string, handle_no int, level int"
DECISIONS = "pair_key string, decision string"
PROJECTS = "name string, path string"

#: What an extractor emits per file.
FACTS = (
    f"file string, lang string, parse_error string, error_ratio double, content_hash string, "
    f"entities array<struct<entity_id:string,kind:string,qualified:string,name:string,owner:string,anchor:{ANCHOR}>>, "
    "refs array<struct<kind:string,src:string,scope:string,module:string,name:string,member:string,receiver_type:string,start_byte:bigint,start_line:int>>, "
    "imports array<struct<local_name:string,source:string,imported_name:string,is_namespace:boolean,is_default:boolean>>, "
    "reexports array<struct<source:string,is_star:boolean,exported_name:string,local_alias:string>>, "
    "ext_methods array<struct<entity_id:string,name:string,extended_type:string>>, "
    "field_types array<struct<owner:string,field:string,type:string>>"
)
