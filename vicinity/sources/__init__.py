"""Files, generators and reports."""
