"""Schemas of the entities that are read from files."""

OPTION = "struct<key:string,description:string>"
EXAMPLE = "struct<state:string,gold:string>"
MESSAGE = "struct<role:string,content:string>"

REQUEST = "request_id string, body string"
RECORD = (f"id string, tid string, family string, kind string, domain string, question string, options array<{OPTION}>, "
          f"examples array<{EXAMPLE}>, state string, gold string, why string, teacher map<string,double>, edit string, "
          "designed_gold string, lang string, lang_scope string")
CHAT = (f"id string, kind string, lang string, messages array<{MESSAGE}>, prompt string, response string, "
        "truncated boolean, answerable boolean, src string")
PAIR = ("struct<edit:string,a:string,gold_a:string,why_a:string,b:string,gold_b:string,why_b:string,"
        "teacher_a:map<string,double>,teacher_b:map<string,double>>")
LABELLED = (f"tid string, family string, kind string, domain string, style string, question string, "
            f"options array<{OPTION}>, examples array<{EXAMPLE}>, pairs array<{PAIR}>")
DRAFT_PAIR = ("struct<edit:string,input_a:string,gold_a:string,why_a:string,input_b:string,gold_b:string,why_b:string>")
DRAFT = (f"tid string, family string, kind string, domain string, style string, n int, question string, "
         f"options array<{OPTION}>, examples array<struct<input:string,gold:string>>, pairs array<{DRAFT_PAIR}>")
RESULT = ("benchmark struct<id:string,task:string,dataset:string>, status string, "
          "metrics struct<baseline_adjusted_score:double>")
UTTERANCE = "id string, text string, label_text string"
EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
TURN = "conv_id bigint, turn int, role string, text string"
