"""DataFrame-to-DataFrame operators on words, turns, segments, candidates and votes."""
