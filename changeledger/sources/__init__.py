"""Reading scripts and ledgers, writing ledgers."""
