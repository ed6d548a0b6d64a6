"""Tables, parsers, lenses and sinks."""
