"""Find and clean hidden characters and tool marks in large text tables on Spark."""
