"""Where records come from, and where they go."""
