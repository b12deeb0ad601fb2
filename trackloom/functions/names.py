"""Camera and track names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scene_of(camera: Column | str) -> Column:
    """The scene prefix of a camera id such as S01_c001; empty if it has none."""
    return F.regexp_extract(camera, r"^(S\d+)_", 1)


def plain_camera(camera: Column | str) -> Column:
    """A camera id in lower case without scene and query_ prefix."""
    return F.regexp_replace(F.lower(camera), r"^(query_)?(s\d+_)?", "")


def camera_of_path(path: Column | str) -> Column:
    """The camera id in a path: its parent folder for a file named vdo, else the file's stem."""
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return F.when((stem == "vdo") & (F.size(parts) > 1), F.try_element_at(parts, F.lit(-2))).otherwise(stem)


def track_number(name: Column | str) -> Column:
    """The number of a track name such as 17 or det-17; null if there is none."""
    return F.regexp_extract(name, r"^(?:det-)?(\d+)$", 1).try_cast("long")
