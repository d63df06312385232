"""Front end before Catalyst: statements, the table catalog, and its snapshots."""
