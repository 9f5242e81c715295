"""Column names and types of the tables the operators read.

Every table is keyed by `stream_id` (one recording, one feed). Times are seconds from the start
of the stream. `pos` numbers words of a stream, `idx` its turns.
"""

from __future__ import annotations

KEY = ["stream_id"]

WORDS = ("stream_id long, pos long, text string, start double, end double, "
         "confidence double, speaker string")
TURNS = ("stream_id long, idx long, speaker string, start double, end double, "
         "text string, word_count int")
SEGMENTS = "stream_id long, pos long, speaker string, start double, end double, confidence double"
PROFILE = "criterion string, weight double, min_score double"

SECONDS_PER_WORD = 0.3
