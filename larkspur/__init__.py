"""Rule-based routing, keyword-scored retrieval and record workflows as plain DataFrame functions."""
