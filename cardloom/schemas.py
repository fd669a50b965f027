"""Schemas and enumerations of cards, sections and ledgers."""

from __future__ import annotations

# Card types, in their declared order.
CARD_TYPES = ("qa", "term_definition", "summary_point", "cloze", "reversible", "sequence", "compare_contrast", "image_occlusion")
# Bloom levels, from remembering to creating.
BLOOM_LEVELS = ("remember", "understand", "apply", "analyze", "evaluate", "create")
# Quality flags; the last two are declared but no rule sets them.
QUALITY_FLAGS = ("vague_question", "too_long_answer", "list_not_cloze", "duplicate_concept", "too_simple", "hallucination_risk")
# Review statuses.
STATUSES = ("pending", "accepted", "rejected")
# Weight of each quality dimension, in the order in which they are summed.
WEIGHTS = {
    "front_quality": 0.25,
    "back_quality": 0.25,
    "card_type_fit": 0.15,
    "bloom_level_fit": 0.10,
    "tags_quality": 0.10,
    "atomicity": 0.15,
}

# The fields of cards and sections, in their order.
CARD = (
    "struct<front:string,back:string,card_type:string,bloom_level:string,tags:array<string>,"
    "related_concepts:array<string>,mnemonic_hint:string,media:array<string>>"
)
CARD_FIELDS = ("front", "back", "card_type", "bloom_level", "tags", "related_concepts", "mnemonic_hint", "media")
SECTION = "struct<id:string,heading:string,level:int,breadcrumb:string,text:string,page_range:string,char_count:int>"
