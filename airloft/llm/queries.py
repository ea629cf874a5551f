"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, langid, licences, lines, media, mixing, neardup, orchard, pii, ranked, sharding, substrings, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.op1,
    "op2_near_duplicates": neardup.op2,
    "op3_mix_sources": mixing.op3,
    "op4_line_dedup": lines.op4,
    "op5_media_columns": media.op5,
    "op6_substring_dedup": substrings.op6,
    "op7_sharding": sharding.op7,
    "op8_toxicity": toxicity.op8,
    "op9_language_id": langid.op9,
    "op10_license_scan": licences.op10,
    "op11_ranked_search": ranked.op11,
    "op12_centroid_clusters": orchard.op12,
    "op13_personal_data": pii.op13,
}

ORACLE_SQL = {
    "op3_mix_sources": mixing.SQL,
    "op4_line_dedup": lines.SQL,
    "op6_substring_dedup": substrings.SQL,
    "op10_license_scan": licences.sql(),
    "op11_ranked_search": ranked.SQL,
    "op12_centroid_clusters": orchard.sql(),
}
