"""The queries of this subpackage: one for each operator, over its whole table."""

from . import bytecnn, decontam, langid, licenses, lmscore, packing, quality_rules, simhash, urlfilter, warc

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_language_id": langid.op2_language_id,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_licences": licenses.op4_licences,
    "op5_warc": warc.op5_warc,
    "op6_url_filter": urlfilter.op6_url_filter,
    "op7_simhash": simhash.op7_simhash,
    "op8_packing": packing.op8_packing,
    "op9_quality": bytecnn.op9_quality,
    "op10_lm_score": lmscore.op10_lm_score,
}
ORACLES = {"op1_quality_rules": quality_rules.ORACLE, "op3_decontamination": decontam.ORACLE, "op5_warc": warc.ORACLE, "op6_url_filter": urlfilter.ORACLE, "op10_lm_score": lmscore.ORACLE}
