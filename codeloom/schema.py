"""Schemas of the engine's tables, its enumerations and lookup values."""

from __future__ import annotations

from pyspark.sql import types as T

SIMPLE = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "decimal(20)": T.DecimalType(20, 0), "array<float>": T.ArrayType(T.FloatType())}


def table(ddl: str) -> T.StructType:
    """A schema from "name type, ..."; needs no session."""
    return T.StructType([T.StructField(n, SIMPLE[k]) for n, k in (x.split() for x in ddl.split(", "))])


ENTITY = table(
    "entity_id string, entity_name string, qualified_name string, entity_type string, signature string, docstring string, source_code string, "
    "source_hash string, file_path string, start_line int, end_line int, start_column int, end_column int, start_byte bigint, end_byte bigint, "
    "visibility string, is_async boolean, is_test boolean, is_deprecated boolean, language string, parent_id string, children_count int, "
    "dependencies_count int, created_at timestamp, last_modified timestamp, indexed_at timestamp, is_container boolean, location_id string"
)
RELATION = table("id string, relation_type string, source_entity_id string, target_entity_id string, context string, file_path string, start_line int, strength double")
POINT = table("point_id decimal(20), vector array<float>, entity_id string, entity_type string, file_path string")
EVENT = table("event_id string, event_type string, file_path string, old_path string, ts timestamp, priority int, retry_count int, max_retries int")
WORKSPACE = table("file_path string, mtime double, size bigint")
RESULT = table("query string, entity_id string, score double, search_type string, rank int, total_results int")

#: Secondary index kinds by collection kind: the columns that searches filter on.
COLLECTIONS = {
    "code": {
        "entity_name": "text", "qualified_name": "text", "entity_type": "keyword", "file_path": "keyword", "language": "keyword", "visibility": "keyword",
        "source_hash": "keyword", "start_line": "integer", "end_line": "integer", "is_async": "bool", "is_test": "bool",
    },
    "relations": {"relation_type": "keyword", "source_entity_id": "keyword", "target_entity_id": "keyword", "strength": "float"},
    "embeddings": {"entity_id": "keyword", "model": "keyword", "text_hash": "keyword"},
}

# Enumerations of the data model.
EVENT_PRIORITY = {"deleted": 1, "modified": 2, "created": 3, "moved": 4}
DISTANCES = ("cosine", "euclidean", "dot")
CONTAINER_TYPES = ("project", "directory", "file", "class", "interface", "module", "namespace", "struct", "enum")
DEFINITION_TYPES = ("class", "function", "method", "interface", "struct", "enum", "trait", "type", "module")

#: Language of a file by its extension.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust",
    ".java": "java", ".cpp": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".rb": "ruby", ".php": "php", ".swift": "swift",
    ".kt": "kotlin", ".scala": "scala",
}
