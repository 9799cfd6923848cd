"""Plans: axes, selections and configurations worked out before data is touched."""
