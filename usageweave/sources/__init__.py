"""Reading raw logs, dimensions and finished tables; writing results."""
