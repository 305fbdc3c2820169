"""DataFrame-to-DataFrame operators over entity-by-month panels."""
