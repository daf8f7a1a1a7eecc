"""Queries and SQL of this subpackage, by the names under which the entry module lists them."""

from __future__ import annotations

from . import chat, context_mixing, decontaminate, line_quality, mpeg_audio, near_dup, packing, sharding, token_store, url_rules

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_context_mixing": context_mixing.op2_context_mixing,
    "op3_pack": packing.op3_pack,
    "op4_url_rules": url_rules.op4_url_rules,
    "op5_media": mpeg_audio.op5_media,
    "op6_token_store": token_store.op6_token_store,
    "op7_line_quality": line_quality.op7_line_quality,
    "op8_near_dup": near_dup.op8_near_dup,
    "op9_shard": sharding.op9_shard,
    "op10_chat": chat.op10_chat,
}
ORACLE_SQL = {"op1_decontaminate": decontaminate.OP1_SQL, "op4_url_rules": url_rules.OP4_SQL, "op8_near_dup": near_dup.OP8_SQL}
