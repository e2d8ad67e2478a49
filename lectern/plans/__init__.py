"""Plans: sources, operators and sinks put together."""
