"""Extras on streams: windowed label-grid counts."""
