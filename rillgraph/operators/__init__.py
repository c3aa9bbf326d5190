"""Relational and graph operators of the event-detection pipeline."""
