"""Operators on signals: DataFrames (stream_id, channel, n, s) where s is a 32-bit sample."""
