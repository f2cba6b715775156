"""Part of lakeframe."""
