"""evidentia: evidence and ledger analytics as PySpark DataFrame operators."""
