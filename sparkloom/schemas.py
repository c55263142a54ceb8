"""Explicit schemas of the records that these operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

TURNS = T.StructType.fromDDL("conversations array<struct<`from`:string,value:string>>")["conversations"].dataType

QA_ROW = T.StructType.fromDDL("id string, conversations array<struct<`from`:string,value:string>>, images array<string>, videos array<string>, metadata string")
RELEASE_ROW = T.StructType.fromDDL("id string, conversations array<struct<`from`:string,value:string>>, metadata struct<curriculum_level:string,task_type:string,source:string,scene:string,used_in_reported_sft:boolean>, media_paths array<string>, media_type string")
OPD_ROW = T.StructType.fromDDL("prompt string, privileged_prompt string, answer string, source_id string, source string, task_type string, reward_family string, trace_id string, videos array<string>")
TRACE_ROW = T.StructType.fromDDL("id string, video string, segmented_video_description string, validation struct<ok:boolean>")
VISIBLE_OBJECT = "struct<object_id:string,object_type:string,name:string,distance:double,pickupable:boolean,moveable:boolean,openable:boolean,toggleable:boolean,receptacle:boolean,rotation_y:double,bbox_area_ratio:double,center_x_ratio:double,center_y_ratio:double,edge_margin_ratio:double>"
STATE_ROW = T.StructType.fromDDL(f"scene string, scene_id int, state_id string, position map<string,double>, yaw int, horizon int, metrics map<string,double>, visible_objects array<{VISIBLE_OBJECT}>, suitability map<string,boolean>")
PROPOSAL_ROW = T.StructType.fromDDL("proposal_id string, scene string, state_id string, class_id int, subcat string, score double, payload map<string,string>, source string")
AUDIT_ROW = T.StructType.fromDDL("sample_id string, scene string, class_id int, class_name string, task_type string, question string, answer string, frame_paths array<string>, decision string, overall_score int, issues array<string>, reason string")
