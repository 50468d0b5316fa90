"""Queries of this subpackage for __spark_entry__.py."""

from __future__ import annotations

from . import avi_mjpeg, bbpe, decontam, html_mincut, langid, pii, quality, secrets_rand, simhash_vp, toxicity


def queries():
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_language": langid.op2_language,
        "op3_simhash": simhash_vp.op3_simhash,
        "op4_pii": pii.op4_pii,
        "op5_quality": quality.op5_quality,
        "op6_main_text": html_mincut.op6_main_text,
        "op7_media": avi_mjpeg.op7_media,
        "op8_decontamination": decontam.op8_decontamination,
        "op9_bbpe": bbpe.op9_bbpe,
        "op10_secrets": secrets_rand.op10_secrets,
    }


def oracle_sql():
    return {"op8_decontamination": decontam.OP8_SQL, "op10_secrets": secrets_rand.op10_sql()}
