"""Reading and writing of corpora, graphs and snapshots."""
