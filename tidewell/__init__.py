"""tidewell: panel analytics expressed as Spark logical plans."""
