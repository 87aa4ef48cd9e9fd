"""The same results as SQL for a second engine, where SQL can express them."""

from __future__ import annotations

from tallylens.llm import chat, lines, mixing, negatives, repair, tiles

SQL: dict[str, str] = {
    "op3_vector_tiles": tiles.SQL,
    "op4_chat_format": chat.SQL,
    "op8_source_mix": mixing.SQL,
    "op10_line_index": lines.SQL,
    "op11_subset_sums": negatives.SQL,
    "op12_turn_repair": repair.SQL,
}
