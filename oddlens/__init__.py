"""oddlens: anomaly analytics as Spark plans."""
