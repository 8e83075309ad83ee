"""Tables in and out, lookups, and the sources of an evaluation."""
