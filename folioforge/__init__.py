"""A text-corpus engine on PySpark: scans, parsing, reconciliation, cleaning, segmentation and queries as DataFrame transforms."""
