"""Declared schemas. Reads never infer them."""

from __future__ import annotations

DOCUMENT = "doc_id string, filename string, source_type string, pages array<struct<page_number: int, raw_text: string>>"
CHUNK = "chunk_id string, doc_id string, chunk_index int, text string, page_number int, char_start int, char_end int, token_count int"
QUESTION = "qa_id string, doc_id string, question string, question_type string, answer_reference string, supporting_chunk_ids array<string>"
CHATS = "id bigint, title string, color string, created_at timestamp, updated_at timestamp"
MESSAGES = "id bigint, chat_id bigint, role string, content string, created_at timestamp"
FILES = "id bigint, chat_id bigint, filename string, stored_path string, status string, created_at timestamp"
STORE = "collection string, chunk_id string, doc_id string, text string, page_number int, seq bigint"
PASSPORT = "embedding_model string, dimension int, distance_metric string, created_at string, description string"
