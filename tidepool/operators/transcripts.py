"""Video transcripts: pick a caption track per video and join its segments.

Both steps are aggregations.  Track choice is a ``min_by`` over
(priority, first position) — partial, so a video with a huge number of
segments is reduced map-side.  Concatenation is done in two levels: segments
are joined within fixed-size chunks of positions first (many tasks), then
the chunk strings are joined in chunk order, so no single task assembles a
hot video's segments from scratch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions.text import py_strip

# Track preference (manual English, then generated English,
# then any other track in listing order).
TRACK_PRIORITY = {"manual_en": 0, "generated_en": 1}
CHUNK = 1024


def best_track(segments: DataFrame, video: str = "video", track: str = "track", seq: str = "seq") -> DataFrame:
    """(video, track) of the preferred caption track of every video."""
    prio = F.lit(len(TRACK_PRIORITY))
    for name, p in TRACK_PRIORITY.items():
        prio = F.when(F.col(track) == name, F.lit(p)).otherwise(prio)
    per_track = segments.groupBy(video, track).agg(F.min(seq).alias("_first"))
    per_track = per_track.withColumn("_prio", prio)
    return per_track.groupBy(video).agg(F.min_by(track, F.struct("_prio", "_first")).alias(track))


def transcript_concat(segments: DataFrame, video: str = "video", seq: str = "seq", text: str = "segment",
                      chunk: int = CHUNK) -> DataFrame:
    """(video, transcript): stripped segments joined by one space in ``seq`` order."""
    s = segments.select(video, seq, py_strip(F.coalesce(F.col(text), F.lit(""))).alias("_t"),
                        F.floor(F.col(seq) / chunk).alias("_c"))
    part = s.groupBy(video, "_c").agg(
        F.expr(f"listagg(_t, ' ') WITHIN GROUP (ORDER BY {seq})").alias("_p"))
    return part.groupBy(video).agg(
        F.expr("listagg(_p, ' ') WITHIN GROUP (ORDER BY _c)").alias("transcript"))


def non_empty_transcript(transcript):
    """At least one non-whitespace character."""
    return F.coalesce(F.regexp_count(transcript, F.lit(r"(?U)\S")), F.lit(0)) > 0


def video_transcripts(segments: DataFrame) -> DataFrame:
    """Best track per video → its transcript; blank transcripts dropped."""
    chosen = best_track(segments)
    segs = segments.join(chosen, ["video", "track"], "left_semi")
    t = transcript_concat(segs)
    return t.where(non_empty_transcript(F.col("transcript")))
