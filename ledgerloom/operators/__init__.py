"""operators of the ledgerloom engine."""
