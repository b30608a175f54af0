"""Schemas of the index: symbols, edges, imports, files, vectors and the tables of recorded sessions."""

from __future__ import annotations

EDGE_TYPES = ("call", "jsx", "new", "event_emit", "event_listen", "pubsub_publish", "pubsub_subscribe", "type")
SYMBOL_TYPES = ("class", "method", "class_property", "function", "variable_function", "inner_function", "interface", "type", "enum")
LAYERS = {"client": "/client/", "server": "/server/", "packages": "/packages/", "ee": "/ee/"}
EDGE_LABELS = {
    "call": "", "jsx": "<jsx>", "new": "[new]", "event_emit": "[emit]", "event_listen": "[listen]", "pubsub_publish": "[publish]", "pubsub_subscribe": "[subscribe]", "type": "[type]",
}

CALL = "struct<name:string,edgeType:string,event:string>"
SYMBOLS = "name string, file string, type string, qualified_name string, exported boolean, line int, file_ord int, sym_ord int"
EDGES = "src string, dst string, file string, edge_type string, event string, ord bigint"
IMPORTS = "importer string, module string, resolved string"
FILES = "path string, md5 string, content string"
VECTORS = "name string, file string, vec array<double>"
FILE_HASH = "path string, md5 string, generator_version string"
TOOL_CALLS = "tool string, symbol string, tokens bigint, ts timestamp"
RAW_MAPPING = "sourcePath string, symbols array<struct<type:string,name:string,exported:boolean,qualifiedName:string,line:int,calls:array<string>>>, imports array<struct<module:string,resolved:string>>"
TEST_CASES = (
    "id string, question string, questionType string, subsystem string, difficulty string, source string, groundTruthFiles array<string>,"
    " groundTruthPath array<struct<file:string,symbol:string>>, keySymbols array<string>"
)
