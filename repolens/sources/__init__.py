"""Sources: driver tables, derived views, file corpora and event-line scans."""
