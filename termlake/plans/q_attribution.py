"""Queries of causes of missed terms (A-15), over all matched terms of ``documents`` with statuses and labels drawn by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import attribution as A
from .fixtures import draw_sql
from .q_match import _JUDGED, judged
from .registry import query

_LABELS = "[" + ", ".join(f"'{x}'" for x in A.LABELS) + "]"
_PICK = draw_sql("'15'", "doc_id", "sent_idx", "term")
_VALID, _MORPHOLOGY = (", ".join(f"'{x}'" for x in labels) for labels in (A.VALID_LABELS, A.MORPHOLOGY_LABELS))
_SUMS = ", ".join([
    *(f"count_if(s = '{x}')::BIGINT AS {x}, count_if(s = '{x}' AND c)::BIGINT AS {x}_correct" for x in A.STATUSES),
    *(f"count_if(NOT c AND s = '{s}')::BIGINT AS stage_{x}" for x, s in zip(A.STAGES, reversed(A.STATUSES), strict=True)),
    f"count_if(NOT c AND l IN ({_VALID}))::BIGINT AS cause_metric_false_negative", "count_if(NOT c AND l = '')::BIGINT AS cause_unaudited_exact_miss",
    *(f"count_if(NOT c AND bad AND {test})::BIGINT AS cause_{x}" for x, test in (
        ("retriever_miss", "s = 'never_retrieved'"), ("retrieved_late", "s = 'retrieved_late'"), ("retrieved_on_time_but_unused", "s = 'retrieved_on_time' AND l = 'omitted_term'"),
        ("retrieved_on_time_wrong_translation", "s = 'retrieved_on_time' AND l = 'wrong_translation'"), ("uncertain", "s = 'retrieved_on_time' AND l = 'uncertain'"))),
])


@query(
    "a15_attribution_ladder",
    f"""{_JUDGED}, o AS (SELECT talk, in_hyp AS c, ['retrieved_on_time', 'retrieved_late', 'never_retrieved'][(sent_idx + length(term)) % 3 + 1] AS s, CASE WHEN in_hyp OR {_PICK} < 0.2 THEN '' ELSE {_LABELS}[floor({_PICK} * 7)::INT + 1] END AS l FROM judged WHERE in_ref),
    p AS (SELECT *, l NOT IN ('', {_VALID}) AS bad FROM o)
    SELECT talk, count(*) AS gold, count_if(c)::BIGINT AS correct, count_if(l IN ({_MORPHOLOGY}))::BIGINT AS morphology_additions, count_if(l IN ({_VALID}))::BIGINT AS semantic_additions, {_SUMS}, round(count_if(c) / count(*), 6) AS accuracy,
    round(count_if(c OR l IN ({_MORPHOLOGY})) / count(*), 6) AS morphology_accuracy, round(count_if(c OR l IN ({_VALID})) / count(*), 6) AS semantic_accuracy FROM p GROUP BY talk""",
)
def _(s, d):
    key = ["doc_id", "sent_idx", "term"]
    status = F.element_at(F.array(*[F.lit(x) for x in A.STATUSES]), ((F.col("sent_idx") + F.length("term")) % 3 + 1).cast("int"))
    gold = judged(s, d).where("in_ref").select("talk", *key, F.col("in_hyp").alias("exact_correct"), status.alias("retrieval_status"))
    draw = X.stable_draw(F.lit("15"), *[F.col(c) for c in key])
    label = F.element_at(F.array(*[F.lit(x) for x in A.LABELS]), (F.floor(draw * 7) + 1).cast("int"))
    audit = gold.where(~F.col("exact_correct") & (draw >= 0.2)).select(*key, label.alias("audit_label"))
    return A.attribution(A.with_audit(gold, audit, key), ["talk"])
