"""sinks of the ledgerloom engine."""
