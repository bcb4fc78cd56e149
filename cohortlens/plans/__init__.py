"""Demographic calculations built from the verbs."""
