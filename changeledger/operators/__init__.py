"""DataFrame operators over catalog and ledger frames."""
