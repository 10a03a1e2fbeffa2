"""Where notes, lookups and settings come from."""
