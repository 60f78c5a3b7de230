"""Declared schemas of what is read, and fixed values."""

from __future__ import annotations



#: Fixed values that columns may hold.
LAW_TYPES = ("law", "regulation", "code", "directive", "decree")
LAW_STATUSES = ("raw", "processed", "indexed")
SECTION_TYPES = ("summary", "facts", "arguments", "ruling", "legal_basis")



EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
_ARTICLE_JSON = "article:string,article_number:string,title:string,text:string,content:string,keywords:array<string>,order_index:bigint"
_CHAPTER_JSON = f"chapter_number:string,chapter_name:string,order_index:bigint,articles:array<struct<{_ARTICLE_JSON}>>"
_BRANCH_JSON = f"branch_number:string,branch_name:string,order_index:bigint,chapters:array<struct<{_CHAPTER_JSON}>>"
#: One law as uploaded, in the flat and in the hierarchical layout.
LAW_JSON = f"struct<name:string,type:string,jurisdiction:string,issuing_authority:string,issue_date:string,description:string,status:string,articles:array<struct<{_ARTICLE_JSON}>>,branches:array<struct<{_BRANCH_JSON}>>>"
CASE_JSON = "struct<case_number:string,title:string,description:string,jurisdiction:string,court_name:string,decision_date:string,case_type:string,court_level:string,sections:array<struct<section_type:string,content:string>>>"
