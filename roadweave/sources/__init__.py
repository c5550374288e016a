"""Readers: KML, map projects, road-network tiles, depots."""
