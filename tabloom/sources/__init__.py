"""Control files, tables, names, paths and sinks."""
