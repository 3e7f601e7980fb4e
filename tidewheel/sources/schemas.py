"""Tables and landed documents. Every schema is declared; none is inferred."""

from __future__ import annotations

POSTS = "id long, member_id string, member_name string, member_tag string, post_id long, title string, body_html string, posted_at timestamp_ntz, views int, is_pinned boolean, updated_at timestamp_ntz"
SCHEDULES = "id long, member_id string, member_name string, post_id long, starts_at timestamp_ntz, ends_at timestamp_ntz, description string, raw_text string, parsed_at timestamp_ntz"
UPDATES = "id long, title string, content string, category string, created_at timestamp_ntz"
FEEDBACK = "id long, subject string, body string, created_at timestamp_ntz"
ROSTER = "member_id string, name string, tag string, is_popular boolean, ordinal int"
GROUPS = "name string, color string, members array<struct<id:string,name:string,leader:boolean>>"
STATUS = "member_id string, http_ok boolean, live boolean"

#: A landed list of a member's posts, its posts' bodies, and the results of reading posts for schedules.
POST_LIST = "member_id string, boards array<struct<title_no:long,title_name:string,reg_date:string,count:struct<read_cnt:int>,is_pin:boolean,is_notice:boolean>>"
POST_BODY = "member_id string, title_no long, content struct<content:string>"
PARSE_RESULT = "post_id long, status string, json string"
#: A member of a roster that is one object, by member.
ROSTER_VALUE = "name string, tag string"
#: A picture of a pack: its name, and its file in base64.
PACK = "name string, data string"
#: How often a post was tried, and when it may be tried again.
ATTEMPTS = "post_id long, tries int, next_at timestamp_ntz"

# Fixed values: `raw_text` of the row that marks a post as read without a schedule in it, and of rows added by hand; the category of updates.
SENTINEL = "파싱결과없음"
BY_HAND = "수동 추가"
CATEGORY = "업데이트"
# Media types by the ending of a name.
MEDIA = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml"}
