"""Relational and graph operators over road sections."""
