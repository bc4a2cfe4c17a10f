"""Clinical entities of protocol texts and research questions.

A document is one row, and everything about it is worked out inside that row with
array functions, so extraction needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions import columns as C
from cohortlake.functions import values as V

FLAGS = "(?i)"
BLANKS = " \t\r\f\x0b"


def lines_of(text: Column) -> Column:
    """Trimmed lines without blank ones."""
    trimmed = F.transform(F.split(text, "\n"), lambda s: F.btrim(s, F.lit(BLANKS)))
    return F.filter(trimmed, lambda s: s != "")


def document_lines(docs: DataFrame) -> DataFrame:
    """One row per line, with the document's character and line counts."""
    return (
        C.computed_once(docs, _lines=lines_of(F.col("text")))
        .select(
            "doc_id",
            F.length("text").alias("char_count"),
            F.size("_lines").alias("line_count"),
            F.posexplode("_lines").alias("line_no", "line"),
        )
    )


def with_lines(docs: DataFrame) -> DataFrame:
    """Documents with ``_lines``: an array of (line_no, line, low, negated, section).

    A line is negated if it, or the line before it, holds a trigger.  Its section is
    that of the last header above it; headers themselves have none.
    """
    # Lower case is worked out once per line, not once per word looked for.
    folded = F.transform(
        lines_of(F.col("text")), lambda s: F.struct(s.alias("line"), F.lower(s).alias("low"))
    )
    marked = F.transform(
        folded,
        lambda s: F.struct(
            s["line"].alias("line"),
            s["low"].alias("low"),
            C.contains_any(s["low"], V.NEGATION_TRIGGERS).alias("trigger"),
            _header(s["low"]).alias("header"),
        ),
    )
    staged = C.computed_once(docs, _marked=marked)
    headers = F.filter(
        F.transform(
            "_marked", lambda m, i: F.struct(i.alias("at"), m["header"].alias("section"))
        ),
        lambda h: h["section"].isNotNull(),
    )
    staged = C.computed_once(staged, _headers=headers)

    def one(m: Column, i: Column) -> Column:
        before = F.coalesce(F.try_element_at("_marked", i)["trigger"], F.lit(False))
        last = F.try_element_at(F.filter("_headers", lambda h: h["at"] < i), F.lit(-1))
        return F.struct(
            i.alias("line_no"),
            m["line"].alias("line"),
            m["low"].alias("low"),
            (m["trigger"] | F.when(i == 0, F.lit(False)).otherwise(before)).alias("negated"),
            F.when(m["header"].isNull(), last["section"]).alias("section"),
        )

    return C.computed_once(staged, _lines=F.transform("_marked", one)).drop("_marked", "_headers")


def _header(lower: Column) -> Column:
    inclusion = lower.contains("inclusion") & C.contains_any(lower, ("criteria", "requirements"))
    exclusion = lower.contains("exclusion") & C.contains_any(
        lower, ("criteria", "contraindications")
    )
    return F.when(inclusion, "inclusion").when(exclusion, "exclusion")


def negation_context(docs: DataFrame) -> DataFrame:
    return with_lines(docs).select("doc_id", F.inline("_lines")).drop("section", "low")


def section_state(docs: DataFrame) -> DataFrame:
    return with_lines(docs).select("doc_id", F.inline("_lines")).drop("negated", "low")


# --- conditions -----------------------------------------------------------------------


def _condition_arrays(lines: Column) -> Column:
    """Distinct (condition, negated) entries of a document's lines."""

    def hits(entry: Column) -> Column:
        # A pattern is only tried on a line that has one of its words.
        found = F.array(
            *[
                F.when(
                    C.contains_any(entry["low"], words),
                    F.regexp_extract(entry["line"], FLAGS + pattern, 0),
                )
                for words, pattern in zip(V.CONDITION_WORDS, V.CONDITION_PATTERNS)
            ]
        )
        return F.transform(
            F.filter(found, lambda f: f != ""),
            lambda f: F.struct(C.title_case(f).alias("condition"), entry["negated"].alias("negated")),
        )

    return F.array_distinct(F.flatten(F.transform(lines, hits)))


def extract_conditions(docs: DataFrame) -> DataFrame:
    """Distinct conditions per document, affirmed or negated.

    The first hit of each pattern group counts in every line.
    """
    return with_lines(docs).select("doc_id", F.inline(_condition_arrays(F.col("_lines"))))


# --- medications and labs ----------------------------------------------------------------


def dosing_frequency(clause: Column, route: Column) -> Column:
    """The first schedule named in the clause after a dose, else the route, else none."""
    found = [
        F.when(clause.rlike(FLAGS + pattern), F.lit(label))
        for pattern, label in V.DOSING_FREQUENCIES
    ]
    return F.coalesce(*found, F.nullif(route, F.lit("")), F.lit("Unspecified"))


def _medication_array(text: Column) -> Column:
    """Every dose in a text with its name and schedule.

    A look-ahead hands over the match together with the characters after it, so the
    text is searched once.
    """
    window = f"(?is)(?=({V.DOSE_PATTERN}.{{0,{V.DOSE_CONTEXT}}})){V.DOSE_PATTERN}"
    at_start = f"(?is)^{V.DOSE_PATTERN}"

    def one(snippet: Column) -> Column:
        whole = F.regexp_extract(snippet, at_start, 0)
        route = F.regexp_extract(snippet, at_start, 3)
        after = F.substring(snippet, F.length(whole) + 1, F.lit(V.DOSE_CONTEXT))
        clause = F.lower(F.regexp_extract(after, r"^[^.;]*", 0))
        return F.struct(
            F.trim(F.regexp_extract(snippet, at_start, 1)).alias("medication"),
            F.trim(F.regexp_extract(snippet, at_start, 2)).alias("dose"),
            dosing_frequency(clause, route).alias("route_frequency"),
            F.lit(V.DOSE_CONFIDENCE).alias("confidence"),
            whole.alias("snippet"),
        )

    # Without a number in front of a unit there is no dose to look for.
    snippets = F.when(
        text.rlike(V.DOSE_HINT), F.regexp_extract_all(text, F.lit(window), F.lit(1))
    ).otherwise(F.array().cast("array<string>"))
    return F.filter(
        F.transform(snippets, one), lambda m: ~F.lower(m["medication"]).isin(*V.DOSE_STOP_WORDS)
    )


def _lab_array(text: Column, low: Column) -> Column:
    """Every lab limit in a text, given also in lower case."""
    pattern = FLAGS + V.LAB_PATTERN

    def one(snippet: Column) -> Column:
        def part(group: int) -> Column:
            return F.regexp_extract(snippet, pattern, group)

        return F.struct(
            part(1).alias("biomarker"),
            part(2).alias("operator"),
            F.trim(F.concat_ws(" ", part(2), part(3))).alias("value"),
            part(4).alias("unit"),
            F.lit(V.LAB_CONFIDENCE).alias("confidence"),
            snippet.alias("snippet"),
        )

    snippets = F.when(
        C.contains_any(low, V.LAB_WORDS), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    ).otherwise(F.array().cast("array<string>"))
    return F.transform(snippets, one)


def _listed(items: Column, limit: int | None) -> Column:
    return F.posexplode(items if limit is None else F.slice(items, 1, limit)).alias("ordinal", "_i")


def extract_medications(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """The doses of every document, or the first ``limit``."""
    return docs.select("doc_id", _listed(_medication_array(F.col("text")), limit)).select(
        "doc_id", "ordinal", "_i.*"
    )


def extract_labs(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """The lab limits of every document, or the first ``limit``."""
    folded = C.computed_once(docs, _low=F.lower("text"))
    labs = _lab_array(F.col("text"), F.col("_low"))
    return folded.select("doc_id", _listed(labs, limit)).select("doc_id", "ordinal", "_i.*")


# --- criteria -------------------------------------------------------------------------------

RULE_TYPE = (
    "array<struct<type:string,raw_text:string,criterion_type:string,name:string,operator:string,"
    "value:string,max_value:int,unit:string,required:boolean,negated:boolean,confidence:double>>"
)


def _rule(line: Column, section: str, negated: Column) -> Column:
    """A criterion line as a structured rule: age, lab or other."""
    low = F.lower(line)
    required = section == "inclusion"

    def part(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(low, pattern, group), F.lit(""))

    age, lab = part(V.RULE_AGE_PATTERN, 1), part(V.RULE_LAB_PATTERN, 1)
    high = part(V.RULE_AGE_PATTERN, 2).try_cast("int")
    high = F.when(high != 0, high)
    lab_unit = F.when(lab == "hba1c", "%").when(lab == "bmi", "kg/m2").otherwise("units")

    def pick(on_age, on_lab, otherwise) -> Column:
        return F.when(age.isNotNull(), on_age).when(lab.isNotNull(), on_lab).otherwise(otherwise)

    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(section).alias("type"),
        line.alias("raw_text"),
        pick("age", "lab", "condition" if required else "exclusion").alias("criterion_type"),
        pick("Age Requirement", F.upper(lab), F.substring(line, 1, 50)).alias("name"),
        pick(
            F.when(high.isNull(), ">=").otherwise("between"), part(V.RULE_LAB_PATTERN, 2), none
        ).alias("operator"),
        pick(
            age.try_cast("int").cast("string"), part(V.RULE_LAB_PATTERN, 3), none
        ).alias("value"),
        F.when(age.isNotNull(), high).alias("max_value"),
        pick("years", lab_unit, none).alias("unit"),
        F.lit(required).alias("required"),
        negated.alias("negated"),
        F.lit(V.INCLUSION_CONFIDENCE if required else V.EXCLUSION_CONFIDENCE).alias("confidence"),
    )


def _section_rules(lines: Column, section: str) -> Column:
    chosen = F.filter(lines, lambda x: (x["section"] == section) & (F.length(x["line"]) > 10))
    return F.transform(chosen, lambda x: _rule(x["line"], section, x["negated"])).cast(RULE_TYPE)


def _default_rules(conditions: Column, labs: Column) -> Column:
    """Rules for a document without sections: one per affirmed condition and lab."""
    none = F.lit(None).cast("string")

    def rule(kind: str, text: Column, name: Column, value: Column, unit: Column, sure: float):
        return F.struct(
            F.lit("inclusion").alias("type"), text.alias("raw_text"),
            F.lit(kind).alias("criterion_type"), name.alias("name"), none.alias("operator"),
            value.alias("value"), F.lit(None).cast("int").alias("max_value"), unit.alias("unit"),
            F.lit(True).alias("required"), F.lit(False).alias("negated"),
            F.lit(sure).alias("confidence"),
        )

    affirmed = F.filter(conditions, lambda c: ~c["negated"])
    from_conditions = F.transform(
        affirmed,
        lambda c: rule(
            "condition",
            F.concat(F.lit("Documented diagnosis of "), c["condition"]),
            c["condition"], none, none, V.DEFAULT_CONDITION_CONFIDENCE,
        ),
    )
    from_labs = F.transform(
        labs,
        lambda b: rule(
            "lab",
            F.concat(
                F.lit("Biomarker requirement: "), b["biomarker"], F.lit(" "), b["value"],
                F.lit(" "), b["unit"],
            ),
            b["biomarker"], b["value"], b["unit"], V.DEFAULT_LAB_CONFIDENCE,
        ),
    )
    return F.concat(from_conditions.cast(RULE_TYPE), from_labs.cast(RULE_TYPE))


def extracted(docs: DataFrame) -> DataFrame:
    """Documents with all entities as array columns, in one pass over the text."""
    staged = C.computed_once(
        C.computed_once(with_lines(docs), _low=F.lower("text")),
        conditions=_condition_arrays(F.col("_lines")),
        medications=_medication_array(F.col("text")),
        labs=_lab_array(F.col("text"), F.col("_low")),
        inclusion=_section_rules(F.col("_lines"), "inclusion"),
        exclusion=_section_rules(F.col("_lines"), "exclusion"),
    )
    no_rules = (F.size("inclusion") == 0) & (F.size("exclusion") == 0)
    return staged.withColumns(
        {
            "from_defaults": no_rules,
            "inclusion": F.when(
                no_rules, _default_rules(F.col("conditions"), F.col("labs"))
            ).otherwise(F.col("inclusion")),
        }
    )


def extract_criteria(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """Rules from the inclusion and exclusion sections, or the first ``limit`` of each kind."""
    sections = with_lines(docs)
    result = None
    for section in ("inclusion", "exclusion"):
        rules = _section_rules(F.col("_lines"), section)
        rows = sections.select("doc_id", _listed(rules, limit)).select("doc_id", "ordinal", "_i.*")
        result = rows if result is None else result.unionByName(rows)
    return result


def default_criteria(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """Rules of the documents that have no section rules."""
    rows = extracted(docs).where("from_defaults")
    return rows.select("doc_id", _listed(F.col("inclusion"), limit)).select(
        "doc_id", "ordinal", "_i.*"
    )


def document_summary(docs: DataFrame) -> DataFrame:
    """Uncapped counts per document."""

    def conditions(negated: bool) -> Column:
        return F.size(F.filter("conditions", lambda c: c["negated"] == F.lit(negated)))

    return extracted(docs).select(
        "doc_id",
        F.length("text").alias("char_count"),
        F.size("_lines").alias("line_count"),
        conditions(False).alias("conditions"),
        conditions(True).alias("negated_conditions"),
        F.size("medications").alias("medications"),
        F.size("labs").alias("labs"),
        (F.size("inclusion") + F.size("exclusion")).alias("rules"),
    )


# --- research questions ------------------------------------------------------------------------


def _lexicon_hits(text: Column, lexicon: tuple) -> Column:
    hits = [F.when(C.contains_any(text, words), F.lit(name)) for name, words in lexicon]
    return F.filter(F.array(*hits), lambda h: h.isNotNull())


def tag_questions(df: DataFrame, text: str = "text") -> DataFrame:
    """Questions with the filters they name and the kind of answer they want."""
    q = F.lower(text)
    bound = F.regexp_extract(q, V.QUESTION_AGE_PATTERN, 1).try_cast("int")
    age = F.when(bound.isNotNull() & C.contains_any(q, V.QUESTION_AGE_WORDS), bound)
    # An age of zero is no bound, and "elderly" then stands for 65.
    min_age = F.coalesce(F.when(age > 0, age), F.when(q.contains("elderly"), F.lit(65)), age)
    lab = F.regexp_extract(q, V.QUESTION_LAB_PATTERN, 1).try_cast("double")
    phase = F.coalesce(*[F.when(q.contains(p), F.lit(p.title())) for p in V.QUESTION_PHASES])
    tagged = df.withColumns(
        {
            "conditions": _lexicon_hits(q, V.QUESTION_CONDITIONS),
            "drugs": _lexicon_hits(q, V.QUESTION_DRUGS),
            "min_age": min_age,
            "min_hba1c": F.when(C.contains_any(q, V.QUESTION_LAB_WORDS), lab),
            "phase": phase,
            "is_adverse": C.contains_any(q, V.QUESTION_ADVERSE_WORDS),
            "is_compare": C.contains_any(q, V.QUESTION_COMPARE_WORDS),
        }
    )
    category = F.lit("general")
    for name, words in reversed(V.QUESTION_CATEGORIES):
        category = F.when(C.contains_any(q, words), name).otherwise(category)
    filtered = (
        (F.size("conditions") > 0)
        | (F.size("drugs") > 0)
        | (F.coalesce("min_age", F.lit(0)) != 0)
        | (F.coalesce("min_hba1c", F.lit(0.0)) != 0)
        | F.col("is_adverse")
    )
    return tagged.withColumn("category", F.when(filtered, "dynamic_slice").otherwise(category))
