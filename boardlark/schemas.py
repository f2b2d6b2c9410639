"""Schemas of the engine's tables, as DDL."""

from __future__ import annotations

ATTACHMENT = "struct<name:string,url:string>"
ASSET = "struct<type:string,name:string,url:string,source:string>"
SOURCE_META = "struct<source_name:array<string>,source_type:array<string>,category_raw:array<string>,original_url:string,published_at:string,crawled_at:string,is_permanent_notice:boolean>"

NOTICES = f"""id string, title string, content string, url string, source string, sources array<string>, audience_group string, source_group string,
source_groups array<string>, category string, department string, published_at string, tags array<string>, attachments array<{ATTACHMENT}>,
searchable_text string, searchable_compact string, content_markdown string"""

POSTS = f"""source_name array<string>, source_type array<string>, category_raw array<string>, title string, content string, published_at string,
original_url string, attachments array<{ATTACHMENT}>, crawled_at string, content_assets array<{ASSET}>, is_permanent_notice boolean,
content_original string, source_meta array<{SOURCE_META}>, _ord bigint"""

CHAT_MESSAGES = """id bigint, session_id string, role string, content string, created_at timestamp, references_json string, used_fallback boolean,
model string, audience_group string, source_group string, source string, category string, department string"""

FACET_CUBE = "audience string, source_group string, audience_groups array<string>, source_groups array<string>, sources array<string>, categories array<string>, departments array<string>"

#: The version that store.publish() writes beside a store; a store of another version is rebuilt.
STORE_VERSION = 4
