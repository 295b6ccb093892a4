"""Sources and sinks: property lists, delimited text and nested documents."""
