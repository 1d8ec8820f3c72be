"""sources of the ledgerloom engine."""
