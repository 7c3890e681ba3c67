"""Prompts of the model stages. The wording is this package's own; a stage takes any other template as well.

A template has {names} that fill() takes from columns. Answers are asked for as JSON in the form that
operators.detection and operators.reviews read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TEMPLATES = {
    "memory": "Summarise the paper below. Begin with a section '# Global Summary', then write a section '# <title>' for each of these titles: {titles}.\n\n{paper}",
    "planner": "Plan which sections of this paper to examine for which of these risks: {risks}. Outline: {outline}\nAnswer as {{\"tasks\": [{{\"task_id\", \"section\", \"pages\", \"risk_dimension\", \"hints\"}}]}}.",
    "specialist": "Examine the section {section} for the risk {risk}. What else is known of the paper:\n{memory}\nEvidence:\n{evidence}\nAnswer as {{\"findings\": [{{\"type\", \"section_location\", \"error_location\", \"explanation\", \"confidence\", \"proposed_fix\"}}]}}.",
    "global": "Read the whole paper and report claims that contradict each other or their evidence.\n{paper}\nAnswer as {{\"findings\": [...]}}.",
    "section": "Read the section {section} and report its errors.\n{text}\nAnswer as {{\"findings\": [...]}}.",
    "merger": "Merge findings that name the same error and drop those without support.\n{findings}\nAnswer as {{\"findings\": [...]}}.",
    "judge": "For each true error say whether a finding names it.\nTrue errors: {truths}\nFindings: {findings}\nAnswer as {{\"matches\": [{{\"gt_index\", \"matched\", \"matched_pred_indices\", \"rationale\"}}]}}.",
    "corruption": "Make {least} to {most} subtle errors in the paper below, each by replacing a short passage.\n{paper}\nAnswer as {{\"edits\": [...]}}.",
    "labels": "Name the section that each block belongs to.\n{blocks}\nAnswer as {{\"labels\": [{{\"content_index\": \"1-3\", \"section\"}}]}}.",
    "alignment": "How far does the second review cover the points of the first?\nFirst: {human}\nSecond: {machine}\nAnswer with shares from 0 to 1.",
    "regression": "Why does the second review score the paper otherwise than the first?\nFirst: {baseline}\nSecond: {final}\nAnswer as {{\"score_delta\", \"differences\"}}.",
    "reward": "Rate precision and conciseness of the answer from 0 to 1.\nAnswer: {answer}\nTrue errors: {truths}\nAnswer as {{\"precision\", \"conciseness\"}}.",
}


def names(template: str) -> list[str]:
    """The names that a template needs, each once, in order."""
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", template)))


def fill(template: str, **values: Column) -> Column:
    """A template with its names replaced by columns, nulls by nothing; '{{' and '}}' stand for braces."""
    if lacking := [n for n in names(template) if n not in values]:
        raise KeyError(", ".join(lacking))
    parts = re.split(r"(?<!\{)\{(\w+)\}(?!\})", template)
    plain = lambda t: F.lit(t.replace("{{", "{").replace("}}", "}"))
    return F.concat(*[F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else plain(p) for i, p in enumerate(parts)])
