"""Reading tables, checking ids, partitioning and shared scratch tables."""
