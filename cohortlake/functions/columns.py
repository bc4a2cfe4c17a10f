"""Column expressions.  All of them are JVM-side built-ins, safe on null input."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions import values as V


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(tests: Iterable[Column]) -> Column:
    result = F.lit(False)
    for t in tests:
        result = result | t
    return result


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return any_of(text.contains(w) for w in words)


def rounded(c: Column, digits: int | None) -> Column:
    """Business rounding; ``None`` keeps the full double."""
    return c if digits is None else F.round(c, digits)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns that later filters must not evaluate again.

    Catalyst substitutes a projected expression into every predicate it moves below
    the projection; it does not do so for the output of a generator.
    """
    packed = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.inline(packed))


# --- casts --------------------------------------------------------------------


def to_long(c: Column | str) -> Column:
    """Text to integer, null when the text is not a whole number.

    Digits are cast as they are; only other spellings (``1e3``, ``12.0``) are doubles first,
    which are exact up to 2^53."""
    text = F.trim(col(c))
    number = text.try_cast("double")
    spelled = F.when(number == F.floor(number), number.try_cast("long"))
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long")).otherwise(spelled)


def to_double(c: Column | str) -> Column:
    return F.trim(col(c)).try_cast("double")


def to_bool(c: Column | str) -> Column:
    low = F.lower(col(c))
    return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)


def to_date(c: Column | str) -> Column:
    """First ten characters as a date, null when they are not one."""
    return F.substring(col(c).cast("string"), 1, 10).try_cast("date")


# --- lists held in strings -------------------------------------------------------


def parse_list(c: Column | str) -> Column:
    """``a|b``, ``a,b`` or ``['a', 'b']`` to an array without blanks; null gives []."""
    bare = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[\[\]'\"]", "")
    return F.filter(F.transform(F.split(bare, r"[|,]"), lambda x: F.trim(x)), lambda x: x != "")


def list_count(c: Column | str) -> Column:
    """Entries of a pipe-delimited list."""
    return F.size(
        F.filter(F.split(F.coalesce(col(c), F.lit("")), r"\|"), lambda x: F.trim(x) != "")
    )


def blank(c: Column | str) -> Column:
    return F.coalesce(F.trim(col(c)) == "", F.lit(True))


# --- patient columns ---------------------------------------------------------------


def _binned(value: Column, edges: Sequence[int], labels: Sequence[str], closed: str) -> Column:
    result = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        inside = (
            (value >= low) & (value < high) if closed == "left" else (value > low) & (value <= high)
        )
        result = F.when(inside, label).otherwise(result)
    return result


def age_bucket(age: Column | str) -> Column:
    return _binned(col(age), V.AGE_BUCKET_EDGES, V.AGE_BUCKET_LABELS, "left")


def age_group(age: Column | str) -> Column:
    """Right-closed bins: age 30 belongs to the first group."""
    return _binned(col(age), V.AGE_GROUP_EDGES, V.AGE_GROUP_LABELS, "right")


def polypharmacy(medication_count: Column | str) -> Column:
    return col(medication_count) >= 5


def has_word(c: Column | str, word: str) -> Column:
    """Case-insensitive substring test, false on null."""
    return F.coalesce(F.lower(col(c)).contains(word.lower()), F.lit(False))


def condition_flags(conditions: Column | str, stems: bool = False) -> dict[str, Column]:
    words = ("diab", "hyper", "obes") if stems else ("diabetes", "hypertension", "obesity")
    names = ("has_diabetes", "has_hypertension", "has_obesity")
    return {n: has_word(conditions, w) for n, w in zip(names, words)}


def normalize_gender(c: Column | str) -> Column:
    raw = F.trim(F.coalesce(col(c), F.lit("")))
    code = F.upper(raw)
    return (
        F.when(code == "M", "male")
        .when(code == "F", "female")
        .when(raw == "", "unknown")
        .otherwise(F.lower(raw))
    )


def age_at(birth: Column | str, death: Column | str, as_of: Column) -> Column:
    """Whole years lived at death, or at ``as_of``; never negative."""
    born, end = to_date(birth), F.coalesce(to_date(death), as_of)
    before_birthday = (F.month(end) * 100 + F.day(end)) < (F.month(born) * 100 + F.day(born))
    years = F.year(end) - F.year(born) - before_birthday.cast("int")
    return F.when(years < 0, 0).otherwise(years)


# --- outcome columns ------------------------------------------------------------------


def responded(status: Column | str = "response_status") -> Column:
    return F.coalesce(col(status).isin(*V.POSITIVE), F.lit(False))


def has_adverse_event(c: Column | str = "adverse_events") -> Column:
    """Non-blank text; null, ``nan`` and ``[]`` are no event."""
    text = F.trim(col(c).cast("string"))
    return F.coalesce((F.length(text) > 0) & ~text.isin("nan", "[]"), F.lit(False))


def cohort_label(conditions: Column | str, is_responder: Column) -> Column:
    diabetic = has_word(conditions, "diabetes")
    return (
        F.when(diabetic & ~is_responder, V.RESISTANT_LABEL)
        .when(diabetic, V.RESPONSIVE_LABEL)
        .when(has_word(conditions, "hypertension"), V.HYPERTENSION_LABEL)
        .when(has_word(conditions, "obesity"), V.OBESITY_LABEL)
        .otherwise(V.OTHER_LABEL)
    )


def compare(value: Column, operator: Column, threshold: Column) -> Column:
    """Comparison whose operator is data; an unknown operator is false."""
    return F.coalesce(
        F.when(operator == ">", value > threshold)
        .when(operator == ">=", value >= threshold)
        .when(operator == "<", value < threshold)
        .when(operator == "<=", value <= threshold)
        .when(operator == "==", value == threshold)
        .when(operator == "!=", value != threshold),
        F.lit(False),
    )


def threshold(outcome_type: Column, field: str) -> Column:
    """A threshold of the outcome type, or the default one."""
    result = F.lit(getattr(V.DEFAULT_THRESHOLD, field))
    for t in V.THRESHOLDS:
        result = F.when(outcome_type == t.outcome_type, F.lit(getattr(t, field))).otherwise(result)
    return result


def improvement_pct(baseline: Column, followup: Column, direction: Column) -> Column:
    """Relative change signed so that positive is better; 0 for a zero baseline."""
    relative = F.try_divide(followup - baseline, F.abs(baseline)) * 100
    return F.when(baseline == 0, 0.0).otherwise(F.when(direction == -1, -relative).otherwise(relative))


def absolute_change(baseline: Column, followup: Column) -> Column:
    return F.when(baseline == 0, 0.0).otherwise(followup - baseline)


def classify_response(outcome_type: Column, improvement: Column) -> Column:
    return (
        F.when(improvement.isNull(), V.UNKNOWN)
        .when(improvement >= threshold(outcome_type, "strong"), V.STRONG)
        .when(improvement >= threshold(outcome_type, "moderate"), V.MODERATE)
        .when(improvement >= threshold(outcome_type, "minimal"), V.MINIMAL)
        .when(improvement > 0, V.NO_RESPONSE)
        .otherwise(V.WORSENED)
    )


def stream_change_pct(value: Column) -> Column:
    change = F.round(value - V.STREAM_BASELINE, 2)
    return F.round(change / V.STREAM_BASELINE * 100, 1)


def classify_event(biomarker: Column, value: Column) -> Column:
    """Stream classification against the fixed baseline; lower is better."""
    pct = stream_change_pct(value)
    label = (
        F.when(pct <= -20, V.STRONG)
        .when(pct <= -10, V.MODERATE)
        .when(pct <= -2, V.MINIMAL)
        .when(pct < 2, V.NO_RESPONSE)
        .otherwise(V.WORSENED)
    )
    known = (biomarker == V.STREAM_BIOMARKER) & value.isNotNull()
    return F.when(known, label).otherwise(V.UNKNOWN)


def event_delta(baseline: Column, followup: Column) -> Column:
    return F.coalesce(followup, F.lit(0.0)) - F.coalesce(baseline, F.lit(0.0))


def prior_failure(medications: Column) -> Column:
    """Any word of an earlier failure in an array of medications."""
    return contains_any(F.lower(F.array_join(medications, " ")), V.FAILURE_WORDS)


def title_case(c: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the others."""
    mark = "\u0001 "
    spaced = F.regexp_replace(F.lower(c), "([^a-z])", "$1" + mark)
    return F.replace(F.initcap(spaced), F.lit(mark), F.lit(""))
