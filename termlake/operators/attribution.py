"""Causes of missed terms: each miss goes to the first cause on a ladder, with or without labels of an audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Retrieval statuses and audit labels.
STATUSES = ("retrieved_on_time", "retrieved_late", "never_retrieved")
MORPHOLOGY_LABELS = ("valid_morphology", "valid_compound_or_orthography")
VALID_LABELS = (*MORPHOLOGY_LABELS, "valid_paraphrase", "valid_alignment_boundary")
LABELS = (*VALID_LABELS, "wrong_translation", "omitted_term", "uncertain")
STAGES = ("retriever_miss", "retrieved_late_not_exact", "retrieved_on_time_not_exact")
CAUSES = ("metric_false_negative", "unaudited_exact_miss", "retriever_miss", "retrieved_late", "retrieved_on_time_but_unused", "retrieved_on_time_wrong_translation", "uncertain")


def failure_stage(correct: Column, status: Column) -> Column:
    """exact_correct, or where a miss arose by its retrieval alone."""
    return F.when(correct, "exact_correct").when(status == "never_retrieved", STAGES[0]).when(status == "retrieved_late", STAGES[1]).otherwise(STAGES[2])


def audited_cause(correct: Column, status: Column, label: Column) -> Column:
    """The first cause of a miss, null for what is correct: a valid rendering that the exact match does not know, no audit, no
    retrieval or a late one, a hint that was not used, a wrong translation, and else uncertain."""
    known = F.coalesce(label, F.lit(""))
    return (
        F.when(correct, None)
        .when(known.isin(*VALID_LABELS), CAUSES[0])
        .when(known == "", CAUSES[1])
        .when(status == "never_retrieved", CAUSES[2])
        .when(status == "retrieved_late", CAUSES[3])
        .when(known == "omitted_term", CAUSES[4])
        .when(known == "wrong_translation", CAUSES[5])
        .otherwise(CAUSES[6])
    )


def with_audit(occurrences: DataFrame, audit: DataFrame, key: list[str]) -> DataFrame:
    """Occurrences with audit_label, empty where there is none; an unknown label or two rows of one key in the audit raise when rows are read."""
    labels = audit.groupBy(*key).agg(F.count("*").alias("__n"), F.min("audit_label").alias("__label"))
    label = (
        F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("two audit rows of one key: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in key]))).cast("string"))
        .when(~F.col("__label").isin(*LABELS), F.raise_error(F.concat(F.lit("unsupported audit label "), "__label")).cast("string"))
        .otherwise(F.col("__label"))
    )
    return occurrences.join(labels.select(*key, label.alias("audit_label")), key, "left").withColumn("audit_label", F.coalesce("audit_label", F.lit("")))


def attribution(occurrences: DataFrame, by: list[str]) -> DataFrame:
    """One row of each key: occurrences, correct ones, accuracy, and as the audit raises it; misses by stage and by cause.

    ``occurrences``: by, exact_correct, retrieval_status, audit_label.  A status that is none of ``STATUSES`` raises, as do
    parts that do not sum to the whole.
    """
    correct, status, label = F.coalesce("exact_correct", F.lit(False)), F.col("retrieval_status"), F.col("audit_label")
    fine = F.when(status.isin(*STATUSES), status).otherwise(F.raise_error(F.concat(F.lit("unknown retrieval status "), F.coalesce(status, F.lit("null")))).cast("string"))
    rows = occurrences.select(*by, correct.alias("c"), fine.alias("s"), label.alias("l"))
    rows = rows.select(*by, "c", "s", "l", failure_stage(F.col("c"), F.col("s")).alias("stage"), audited_cause(F.col("c"), F.col("s"), F.col("l")).alias("cause"))
    count = lambda test, name: F.count_if(F.coalesce(test, F.lit(False))).alias(name)
    found = rows.groupBy(*by).agg(
        F.count("*").alias("gold"), count(F.col("c"), "correct"), count(F.col("l").isin(*MORPHOLOGY_LABELS), "morphology_additions"), count(F.col("l").isin(*VALID_LABELS), "semantic_additions"),
        *[count(F.col("s") == x, x) for x in STATUSES], *[count((F.col("s") == x) & F.col("c"), f"{x}_correct") for x in STATUSES],
        *[count(F.col("stage") == x, f"stage_{x}") for x in STAGES], *[count(F.col("cause") == x, f"cause_{x}") for x in CAUSES],
    )
    misses = F.col("gold") - F.col("correct")
    whole = (sum((F.col(f"stage_{x}") for x in STAGES), F.lit(0)) == misses) & (sum((F.col(f"cause_{x}") for x in CAUSES), F.lit(0)) == misses)
    rate = lambda x: F.round(F.try_divide(x, F.col("gold")), 6)
    out = found.withColumn("gold", F.when(whole, F.col("gold")).otherwise(F.raise_error(F.lit("parts do not sum to the misses")).cast("long")))
    return out.withColumns({"accuracy": rate(F.col("correct")), "morphology_accuracy": rate(F.col("correct") + F.col("morphology_additions")), "semantic_accuracy": rate(F.col("correct") + F.col("semantic_additions"))})
