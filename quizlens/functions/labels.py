"""Grades, bands, labels and previews: plain ``when`` chains and string
functions, evaluated inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quizlens.functions.text import is_blank, strip

# --- fixed values ------------------------------------------------------------
CATEGORY_LABELS = {
    "hr": "HR Interview",
    "python": "Python Interview",
    "sql": "SQL Interview",
    "ml": "Machine Learning",
    "ds": "Data Science",
}
DEFAULT_CATEGORY = "hr"
DEFAULT_LABEL = "Interview"
STRENGTH_CUT = 70.0
GRADE_CUTS = (80.0, 60.0)            # Excellent / Good / Needs Practice
BAND_CUTS = (80.0, 60.0, 40.0)       # green / purple / amber / red
QUESTION_PREVIEW = 60
ANSWER_PREVIEW = 80
ELLIPSIS = "…"
QUESTIONS_PER_SESSION = 10
# -----------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def category_key(c) -> Column:
    """Category parameter lower-cased, default ``hr``."""
    return F.coalesce(F.lower(_c(c)), F.lit(DEFAULT_CATEGORY))


def category_label(c) -> Column:
    """Category code -> its label (P5); unknown codes read "Interview"."""
    m = F.create_map(*[F.lit(x) for kv in CATEGORY_LABELS.items() for x in kv])
    return F.coalesce(F.element_at(m, _c(c)), F.lit(DEFAULT_LABEL))


def grade(score) -> Column:
    """Excellent from 80, Good from 60, else Needs Practice."""
    s = _c(score)
    return (F.when(s >= GRADE_CUTS[0], "Excellent")
            .when(s >= GRADE_CUTS[1], "Good")
            .otherwise("Needs Practice"))


def grade_class(score) -> Column:
    """The style class that goes with the grade."""
    s = _c(score)
    return (F.when(s >= GRADE_CUTS[0], "grade-good")
            .when(s >= GRADE_CUTS[1], "grade-mid")
            .otherwise("grade-low"))


def badge(score) -> Column:
    """Above average / Average / Keep practising on the grade cuts."""
    s = _c(score)
    return (F.when(s >= GRADE_CUTS[0], "Above average")
            .when(s >= GRADE_CUTS[1], "Average")
            .otherwise("Keep practising"))


def band4(score) -> Column:
    """History pills and breakdown bars."""
    s = _c(score)
    return (F.when(s >= BAND_CUTS[0], "green")
            .when(s >= BAND_CUTS[1], "purple")
            .when(s >= BAND_CUTS[2], "amber")
            .otherwise("red"))


def band3(score) -> Column:
    """Category bars."""
    s = _c(score)
    return (F.when(s >= BAND_CUTS[0], "green")
            .when(s >= BAND_CUTS[1], "purple")
            .otherwise("red"))


def is_strength(score) -> Column:
    """A strength scores at least 70; below is a weak area."""
    return _c(score) >= STRENGTH_CUT


def category_title(c) -> Column:
    """P10: "<code> Interview"."""
    return F.concat(_c(c), F.lit(" Interview"))


def short_date(ts) -> Column:
    """P11: "Mon dd" (trend labels)."""
    return F.date_format(_c(ts), "MMM dd")


def long_date(ts) -> Column:
    """P11: "Mon dd, yyyy" (recent sessions)."""
    return F.date_format(_c(ts), "MMM dd, yyyy")


def preview(text, n: int) -> Column:
    """The first n characters, with an ellipsis only when the text is longer."""
    t = _c(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(ELLIPSIS))).otherwise(t)


def answer_status(answer) -> Column:
    """A blank (or null) answer is "Skipped", else "Answered"."""
    return F.when(is_blank(answer), "Skipped").otherwise("Answered")


def progress_pct(index0, n) -> Column:
    """round(index / n * 100) with Python's half-even rounding."""
    return F.rint(_c(index0) / _c(n) * 100.0).cast("int")


def completion(answered, total=None) -> Column:
    """P14: "answered/total", total defaulting to the questions per session."""
    t = F.lit(QUESTIONS_PER_SESSION) if total is None else _c(total)
    return F.concat(_c(answered).cast("string"), F.lit("/"), t.cast("string"))


def display_name(first_name) -> Column:
    """The first name, or "Guest" when blank."""
    n = F.nullif(strip(first_name), F.lit(""))
    return F.coalesce(n, F.lit("Guest"))


def initial(first_name) -> Column:
    """The upper-cased first letter of the name, or "G"."""
    n = F.nullif(strip(first_name), F.lit(""))
    return F.coalesce(F.upper(F.substring(n, 1, 1)), F.lit("G"))
