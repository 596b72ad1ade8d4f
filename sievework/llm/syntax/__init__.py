"""Source files that do not parse: grammars, chart parser and repair."""
