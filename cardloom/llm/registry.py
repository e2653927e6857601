"""The corpus queries: one for each operator, and the pipeline."""

from __future__ import annotations

import corpus_pipeline

from . import decontam, fimscatter, fitpack, knnjoin, licenses, linededup, linkcreds, polyprint, pseudolm, radixaudit, ratjoin, repair, toxickn


def queries():
    return {
        "op1_topk": knnjoin.op1_topk,
        "op2_toxicity": toxickn.op2_toxicity,
        "op3_line_dedup": linededup.op3_line_dedup,
        "op4_decontamination": decontam.op4_decontamination,
        "op5_packing": fitpack.op5_packing,
        "op6_license_scan": licenses.op6_license_scan,
        "op7_linked_secrets": linkcreds.op7_linked_secrets,
        "op8_pseudo_likelihood": pseudolm.op8_pseudo_likelihood,
        "op9_jaccard_join": ratjoin.op9_jaccard_join,
        "op10_repair_ids": repair.op10_repair_ids,
        "op11_exact_dedup": polyprint.op11_exact_dedup,
        "op12_fill_in_middle": fimscatter.op12_fill_in_middle,
        "op13_filter_audit": radixaudit.op13_filter_audit,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {
        "op1_topk": knnjoin.ORACLE, "op3_line_dedup": linededup.ORACLE, "op4_decontamination": decontam.ORACLE,
        "op11_exact_dedup": polyprint.ORACLE, "op12_fill_in_middle": fimscatter.ORACLE, "op13_filter_audit": radixaudit.ORACLE,
    }
