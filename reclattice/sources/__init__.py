"""Readers and writers: rating files, grid histories, reports, exports."""
