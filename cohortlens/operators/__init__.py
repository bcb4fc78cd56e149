"""DataFrame verbs."""
