"""Ledger analytics on Spark: a DataFrame library for UTXO-style ledgers."""
