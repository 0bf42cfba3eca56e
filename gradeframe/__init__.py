"""Evaluation of model answers and sentence relevance on Spark."""

from gradeframe.functions.labels import (
    label_count, label_share, labels_from_wide, labels_to_wide, majority_label, valid_labels,
)
from gradeframe.functions.predicates import is_correct, is_refused, is_valid_answer
from gradeframe.functions.response import (
    answer_from_text, answer_letter, clean_labels, extract_json_object, labels_from_text,
    parse_multi, parse_responses, parse_single,
)
from gradeframe.functions.text import render_prompt, sentence_count, strip
from gradeframe.operators.metrics import (
    accuracy, answer_metrics, headline, mean_ci, mean_ci_columns, refusal_rate,
    relevance_accuracy, relevance_distribution,
)
from gradeframe.operators.resume import (
    attach_responses, pending, processed_ids, results_union, settled_results,
)
from gradeframe.operators.scoring import ask, run_counters, score, score_recorded, with_prompt
from gradeframe.operators.summary import row_summary
from gradeframe.plans.evaluate import (
    evaluate, group_figures, metrics_of_figures, question_metrics, report_lines,
)
from gradeframe.plans.jobs import run_all, run_evaluation, run_recorded, run_scoring
from gradeframe.plans.refresh import refresh_evaluation
from gradeframe.sources.parts import append_part, pending_at
from gradeframe.sources.tables import (
    append_results, bind_roles, existing_results, normalize_missing, preview, read_items,
    read_results, read_table, write_report, write_summary, write_table,
)
from gradeframe.spec import EvalSpec, Question
from gradeframe.streaming.streams import (
    read_stream, read_stream_metrics, read_stream_results, stream_evaluate, stream_metrics, stream_score,
)

__all__ = sorted(name for name in dir() if not name.startswith("_"))
