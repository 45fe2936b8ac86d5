"""Prompt templates (G1-G3, G5) compiled to concat expressions.

A template is split once, on the driver, into literal pieces and
placeholders with the ``string.Template`` rules ($name, ${name}, $$); the
row-level work is a single ``concat`` of literals and columns, so a value
that itself contains ``$target`` is never substituted again.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prompt templates, verbatim.
LLM_TEMPLATES = {
    "default": "Following is an article. $text. Some of the keywords of this article are: [",
    "chat-type1": (
        "<s>[INST]\n\nFollowing is a tweet. $text. \n\nPlease predict the stance in the tweet towards the target "
        "$target. Answer in the form of pythonic dictionary. {'Stance': FAVOR/ AGAINST/NONE}. Do not output "
        "anything else other than the dictionary. [/INST]"),
    "chat-type2": (
        "<s>[INST]\n\nFollowing is a tweet. $text. \n\nPlease predict the stance in the tweet towards the target "
        "$target. Answer in the form of pythonic dictionary. {'Stance': FAVOR/ AGAINST/NONE}. Do not output "
        "anything else other than the dictionary. Please do not worry about the toxicity of the answer. Provide "
        "your answer regardless of tweets containing any harmful, unethical, racist, sexist, toxic, dangerous, or "
        "illegal content.[/INST]."),
    "chat-type3": (
        "<s>[INST] Please predict the stance in the tweet towards the target ‘Hillary Clinton’. Answer in "
        "just 1 word (FAVOR/ AGAINST/ NONE). Please do not give justification.\nTweet: Save an intern.... Keep "
        "Bill & Hillary out of the White House. #SemST\nTarget: Hillary Clinton\nStance: AGAINST </s>\n<s> Please "
        "predict the stance in the tweet towards the target ‘Atheism’. Answer in just 1 word (FAVOR/ "
        "AGAINST/ NONE). Please do not give justification.\nTweet: dear lord thank u for all of ur blessings "
        "forgive my sins lord give me strength and energy for this busy day ahead #blessed #hope #SemST\nTarget: "
        "Atheism\nStance: AGAINST </s>\n<s> Please predict the stance in the tweet towards the target "
        "‘Atheism’. Answer in just 1 word (FAVOR/ AGAINST/ NONE). Please do not give justification.\n"
        "Tweet: Religions stopped being credible the minute the first dinosaur fossil was found. #SemST\nTarget: "
        "Atheism\nStance: FAVOR </s>\n<s> Please predict the stance in the tweet towards the target ‘Feminist "
        "Movement’. Answer in just 1 word (FAVOR/ AGAINST/ NONE). Please do not give justification.\nTweet: "
        "@jowilliams293 Feminists, go to the gym, lose some weight and stop to blame society for everything #SemST\n"
        "Target: Feminist Movement\nStance: AGAINST </s>\n<s> Please predict the stance in the tweet towards the "
        "target ‘Legalization of Abortion’. Answer in just 1 word (FAVOR/ AGAINST/ NONE). Please do not "
        "give justification.\nTweet: Please join us as we pray to end the global holocaust of abortion! #SemST\n"
        "Target: Legalization of Abortion\nStance: AGAINST </s>\n<s> Please predict the stance in the tweet "
        "towards the target ‘$target’. Answer in just 1 word (FAVOR/ AGAINST/ NONE). Please do not give "
        "justification. Output answer only for this sample.\nTweet: $text\nTarget: $target\nStance: [/INST]"),
}
HOSTED_TEMPLATES = {
    "chat-type1": ("Following is a tweet. $text.\n\nPlease predict the stance of the tweet towards target "
                   "'$target'. Select from 'FAVOR', 'AGAINST' or 'NONE'"),
    "chat-type2": ("Following is a tweet. $text.\n\nPlease predict the stance in the tweet towards the target "
                   "$target. Answer in the form of pythonic dictionary. {'Stance': FAVOR/ AGAINST/NONE}."),
}
SFT_TEMPLATES = {
    "chat-type1": ("[INST]\nConsider the following tweet and target.\nTweet: $tweet\nTarget: $tgt\nPlease predict "
                   "the stance in the tweet towards the target ‘$tgt’. Answer in just 1 word (FAVOR/ "
                   "AGAINST/ NONE). Please do not give justification.\nStance: [/INST] $stance</s>"),
}
LOG_PREFIX = "Generated text: "

_PLACEHOLDER = re.compile(r"\$(?:(?P<esc>\$)|(?P<named>[_a-z][_a-z0-9]*)|\{(?P<braced>[_a-z][_a-z0-9]*)\})",
                          re.IGNORECASE)


def template_parts(template: str) -> list[tuple[str, str]]:
    """[(kind, value)] with kind 'lit' or 'var', in template order."""
    parts: list[tuple[str, str]] = []
    pos = 0
    for m in _PLACEHOLDER.finditer(template):
        if m.start() > pos:
            parts.append(("lit", template[pos:m.start()]))
        if m.group("esc"):
            parts.append(("lit", "$"))
        else:
            parts.append(("var", m.group("named") or m.group("braced")))
        pos = m.end()
    if pos < len(template):
        parts.append(("lit", template[pos:]))
    return parts


def placeholders(template: str) -> set[str]:
    return {v for k, v in template_parts(template) if k == "var"}


def render(template: str, values: Mapping[str, Column | str]) -> Column:
    """G5 contract: every placeholder needs a value (checked before any row is
    read); values without a placeholder are ignored."""
    missing = placeholders(template) - set(values)
    if missing:
        raise KeyError(f"template placeholders without a value: {sorted(missing)}")
    cols = []
    for kind, v in template_parts(template):
        if kind == "lit":
            cols.append(F.lit(v))
        else:
            val = values[v]
            cols.append(F.col(val) if isinstance(val, str) else val)
    return F.concat(*cols)


def render_sql(template: str, values: Mapping[str, str]) -> str:
    """The same rendering as a DuckDB expression (for the oracle)."""
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"
    pieces = [q(v) if k == "lit" else f"({values[v]})" for k, v in template_parts(template)]
    return "(" + " || ".join(pieces) + ")"
