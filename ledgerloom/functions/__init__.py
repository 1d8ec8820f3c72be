"""functions of the ledgerloom engine."""
