"""Queries of this subpackage and their SQL, for `__spark_entry__.py`."""

from __future__ import annotations

import corpus_pipeline

from . import langid, licenses, media, mergepieces, packing, quality, repair, resampling, rules, secrets, simhash, urlfilter, winnowing

QUERIES = {
    "op1_winnowing": winnowing.op1_winnowing,
    "op2_url_filter": urlfilter.op2_url_filter,
    "op3_simhash": simhash.op3_simhash,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_packing": packing.op5_packing,
    "op6_merge_pieces": mergepieces.op6_merge_pieces,
    "op7_language": langid.op7_language,
    "op8_quality": quality.op8_quality,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_media": media.op10_media,
    "op11_resampling": resampling.op11_resampling,
    "op12_quality_rules": rules.op12_quality_rules,
    "op13_conversation_repair": repair.op13_conversation_repair,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {"op2_url_filter": urlfilter.OP2_SQL, "op11_resampling": resampling.OP11_SQL, "op13_conversation_repair": repair.OP13_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
