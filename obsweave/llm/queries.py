"""The registered queries of this package, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from obsweave.llm import (
    class_lm, decontaminate, filter_audit, jaccard_join, kneser_ney, licenses, mixing, packing, periodic, quality_rules,
    suffix_dedup, toxicity, url_filters,
)
from obsweave.llm.common import read


def op1_toxicity(spark, sf_dir):
    return toxicity.op1_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_url_filters(spark, sf_dir):
    return url_filters.judge(read(spark, sf_dir, "pages"))


def op3_best_fit_packing(spark, sf_dir):
    return packing.op3_best_fit_packing(read(spark, sf_dir, "documents"))


def op4_class_lm(spark, sf_dir):
    return class_lm.op4_class_lm(read(spark, sf_dir, "documents"))


def op5_decontamination(spark, sf_dir):
    return decontaminate.op5_decontamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_license_scan(spark, sf_dir):
    return licenses.op6_license_scan(read(spark, sf_dir, "documents"))


def op7_quality_rules(spark, sf_dir):
    return quality_rules.op7_quality_rules(read(spark, sf_dir, "documents"))


def op8_quality_classifier(spark, sf_dir):
    return kneser_ney.op8_quality_classifier(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.op9_suffix_array_dedup(read(spark, sf_dir, "documents"))


def op10_jaccard_join(spark, sf_dir):
    return jaccard_join.op10_jaccard_join(read(spark, sf_dir, "documents"))


def op11_filter_audit(spark, sf_dir):
    return filter_audit.op11_filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_source_mix(spark, sf_dir):
    return mixing.op12_source_mix(read(spark, sf_dir, "documents"))


def op13_periodic_runs(spark, sf_dir):
    return periodic.op13_periodic_runs(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_url_filters, op3_best_fit_packing, op4_class_lm, op5_decontamination, op6_license_scan,
        op7_quality_rules, op8_quality_classifier, op9_suffix_array_dedup, op10_jaccard_join,
        op11_filter_audit, op12_source_mix, op13_periodic_runs,
    )
}
ORACLE = {
    "op2_url_filters": url_filters.SQL, "op5_decontamination": decontaminate.SQL, "op7_quality_rules": quality_rules.SQL,
    "op11_filter_audit": filter_audit.SQL, "op12_source_mix": mixing.SQL,
}
