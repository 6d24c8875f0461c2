"""Training-data pipeline operators; nothing else in semdex imports this subpackage."""
