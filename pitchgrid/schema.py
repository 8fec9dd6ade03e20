"""Schemas of the logical tables. Frames count from 0; halves are 1 and 2."""

from __future__ import annotations

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
POLYGONS = "array<array<struct<x:int,y:int>>>"

DETECTIONS_JSON = "predictions array<struct<bboxes:array<array<double>>,onfield:array<boolean>>>"
CALIBRATION_JSON = "predictions array<array<struct<confidence:double,homography:array<double>>>>"
DETECTIONS = f"match string, half int, frame_idx int, det_idx int, bbox {BOX}, onfield boolean"
CALIBRATION = "match string, half int, frame_idx int, confidence double, homography array<double>"
SEGMENTATION = f"match string, half int, frame_idx int, seg_idx int, class_id smallint, score float, bbox {BOX}, mask {POLYGONS}"
FLOW_COUNTS = "match_path string, num_frames_first_half int, num_frames_second_half int"
ASPECT_RATIOS = "match_path string, SAR string"
VELOCITY = "match string, half int, frame_idx int, person_idx int, vx double, vy double"
TEAM_SCORES = "match string, half int, frame_idx int, person_idx int, logits array<float>"
REPAIRED = "match string, half int, frame_idx int, all_frame_idx int, mean_iou double"
REGION = "struct<tags:array<string>,boundingBox:struct<left:double,top:double,height:double,width:double>>"
ANNOTATION = f"asset struct<name:string,size:struct<height:int,width:int>>, regions array<{REGION}>"
ANNOTATION_EXPORT = f"assets map<string,struct<asset:struct<name:string>,regions:array<{REGION}>>>"

# Class numbers
CLASSES = {"REFEREE": 0, "TEAM_A": 1, "TEAM_B": 2, "GOALKEEPER_1": 3, "GOALKEEPER_2": 4}
