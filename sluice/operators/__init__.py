"""Table-to-table operators; no driver-side loops over rows."""
