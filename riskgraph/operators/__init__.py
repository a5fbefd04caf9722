"""Relational and graph operators over the property-graph tables."""
