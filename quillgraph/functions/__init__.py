"""Column expressions over names, places, years, ranks and codes."""
