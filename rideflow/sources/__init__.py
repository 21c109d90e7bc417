"""Star-schema tables, files, topics and tables as sources and sinks."""
