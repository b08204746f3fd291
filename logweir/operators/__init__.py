"""Record assembly, parsers, gate, metrics and templates."""
