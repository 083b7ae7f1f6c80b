"""Streaming forms of the monthly rate and of the contamination replay."""
