"""Corpus analytics on Spark: inventory, selection, bundles, index, routing and ledgers as DataFrame jobs."""
