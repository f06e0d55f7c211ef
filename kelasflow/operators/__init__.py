"""Set-wise operators over the learning schema (one module per subject area)."""
