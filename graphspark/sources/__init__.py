"""Sources and sinks: relational mapping, line-based graph text, locks, registers, archives."""
