"""semdex: semantic search and text analytics expressed as Spark plans."""

__version__ = "0.1.0"
SCHEMA_VERSION = 5
