"""DataFrame operators: navigation, search, metadata, segments, algorithms."""
