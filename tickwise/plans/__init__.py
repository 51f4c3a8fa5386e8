"""Plan-level building blocks: compilation, fixpoints, shared tables."""
