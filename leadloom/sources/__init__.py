"""Tables a job reads and writes: landed pages, offers, the state table, the external table."""
