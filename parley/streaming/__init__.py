"""Structured Streaming forms of four operators; each has a batch twin.

Late data: a 10-minute watermark, later rows are dropped; batch twins ignore it.
"""

LATENESS = "10 minutes"
