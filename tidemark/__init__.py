"""Share-session and transfer analytics on Spark: batch DataFrame operators, and streaming forms where state is kept."""
