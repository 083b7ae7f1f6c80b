"""Readers, writers and the mapping from the warehouse tables to the operators' input tables."""
