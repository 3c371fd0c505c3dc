"""File trees, watchlists, rosters, maps, and report sinks."""
