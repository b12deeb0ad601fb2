"""Schemas of the trajectory tables."""

from __future__ import annotations

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
TRACKLET_FRAME = f"struct<frame_id:bigint,timestamp:double,bbox:{BOX},confidence:double>"
FRAME_INFO = "frame_id bigint, camera_id string, timestamp double, frame_path string, width int, height int"
TRACKLETS = f"camera_id string, track_id bigint, class_id int, class_name string, frames array<{TRACKLET_FRAME}>"
MOT = "frame bigint, id bigint, x double, y double, w double, h double, conf double, class int, visibility double"
#: Names of the object classes.
CLASS_NAMES = {0: "person", 2: "car", 5: "bus", 7: "truck"}
