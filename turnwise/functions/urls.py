"""Ids and classes of media links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Link forms of the two hosts the jobs know.
VIDEO_ID = r"(?:v=|/v/|youtu\.be/|/embed/|/shorts/|/live/)([a-zA-Z0-9_-]{11})"
VIDEO_LINK = (r"^(https?://)?(www\.)?"
              r"(youtube\.com/(watch\?v=|v/|shorts/|live/)|youtu\.be/)[A-Za-z0-9_-]+")
FILE_ID = [r"/file/d/([a-zA-Z0-9_-]+)", r"/folders/([a-zA-Z0-9_-]+)",
           r"id=([a-zA-Z0-9_-]+)"]


def _first_group(url: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))


def video_id(url: Column) -> Column:
    return _first_group(url, VIDEO_ID)


def is_video_link(url: Column) -> Column:
    return url.rlike(VIDEO_LINK)


def file_id(url: Column) -> Column:
    return F.coalesce(*[_first_group(url, p) for p in FILE_ID])


def link_class(url: Column) -> Column:
    low = F.lower(url)
    return (F.when(low.contains("youtube.com") | low.contains("youtu.be"), "video")
            .when(low.contains("drive.google.com"), "drive")
            .otherwise("other"))
