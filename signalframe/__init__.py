"""PySpark operators for ordered signals, time intervals and transcripts."""
