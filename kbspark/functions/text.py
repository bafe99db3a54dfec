"""Text helpers as Column expressions (JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed prompt template of the reference's chat answer.
PROMPT_HEAD = "Use the following information to answer the question:\n\nContext:\n"
PROMPT_QUESTION = "\n\nQuestion: "
PROMPT_TAIL = "\n\nAnswer:"
CONTEXT_SEPARATOR = "\n\n"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def build_prompt(contexts, query) -> Column:
    """Contexts joined by a blank line, then the question.  ``concat`` rather
    than ``format_string`` so ``%`` in text is literal; no contexts -> empty block."""
    ctx = F.array_join(F.coalesce(_col(contexts), F.array().cast("array<string>")), CONTEXT_SEPARATOR)
    return F.concat(F.lit(PROMPT_HEAD), ctx, F.lit(PROMPT_QUESTION), F.coalesce(_col(query), F.lit("")),
                    F.lit(PROMPT_TAIL))


def has_text(c) -> Column:
    """Not blank after trimming Unicode whitespace (tab, newline, NBSP...)."""
    return F.coalesce(_col(c).rlike("(?U)\\S"), F.lit(False))


def go_string(c) -> Column:
    """Go strings are never NULL: a missing value is ''."""
    return F.coalesce(_col(c), F.lit(""))


def xml_escape(c) -> Column:
    """Escape text for an XML element body; drop characters XML 1.0 forbids."""
    x = F.regexp_replace(_col(c), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")
    x = F.replace(x, F.lit("&"), F.lit("&amp;"))
    x = F.replace(x, F.lit("<"), F.lit("&lt;"))
    return F.replace(x, F.lit(">"), F.lit("&gt;"))
