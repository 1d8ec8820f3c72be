"""streaming of the ledgerloom engine."""
