"""Reading and writing lakes and ledgers."""
