"""Network-flow analytics on Spark: packets and counter snapshots in, enriched flow records out."""
