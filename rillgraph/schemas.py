"""Schemas of the tables, as DDL."""

POSTS = "pid bigint, tokens array<string>, types array<string>, dt timestamp_ntz, user_id bigint, window_no int, deleted string"
NESTED = "pids array<bigint>, tokens array<array<string>>, types array<array<string>>, deleted array<string>, dts array<timestamp_ntz>, user_ids array<bigint>, window_no int"
SCORES = "pid bigint, subject_idx int, score float"
KG_STORE = "seq bigint, pid bigint, triples array<array<string>>, backend string"
TRIPLE = "struct<h:string,r:string,o:string>"
SUBJECT_EVENTS = "subject_idx int, window bigint, event_no int, nodes array<bigint>, titles array<string>, post_ids array<bigint>, score double, vector array<float>, keywords array<string>"
FINAL_EVENTS = "event_number int, titles array<string>, subjects array<int>, windows array<bigint>, post_ids array<bigint>, vector array<float>, n int"
GOLD = "sequence_id bigint, topics_id string, topics_str string"
