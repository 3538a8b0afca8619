"""Reading and writing files, snapshots and tables."""
