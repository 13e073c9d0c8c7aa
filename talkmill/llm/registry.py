"""The pN_ queries by name."""

from __future__ import annotations

from talkmill.llm import oracle, p1_talks, p2_defects, p3_splits, p4_leaks, p5_copies, p6_packing, p7_mixing, p8_quality


def queries():
    return {
        "p1_found": p1_talks.p1_found, "p1_talks": p1_talks.p1_talks, "p1_sessions": p1_talks.p1_sessions,
        "p2_found": p2_defects.p2_found, "p2_tagged": p2_defects.p2_tagged,
        "p3_found": p3_splits.p3_found, "p3_overlaps": p3_splits.p3_overlaps,
        "p4_found": p4_leaks.p4_found, "p4_leaks": p4_leaks.p4_leaks,
        "p5_found": p5_copies.p5_found, "p5_collapsed": p5_copies.p5_collapsed,
        "p6_pack": p6_packing.p6_pack, "p6_fill": p6_packing.p6_fill,
        "p7_mix": p7_mixing.p7_mix, "p7_shares": p7_mixing.p7_shares,
        "p8_found": p8_quality.p8_found, "p8_stats": p8_quality.p8_stats,
    }


def oracle_sql():
    return oracle.SQL
