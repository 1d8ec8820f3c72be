"""plans of the ledgerloom engine."""
