"""Checks of text extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Registry
from cohortlake.functions import values as V
from cohortlake.operators import matching as M
from cohortlake.operators import text as T

reg = Registry()


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LINES = r"""ln0 AS (SELECT doc_id, length(text) AS char_count, list_filter(list_transform(string_split(text, chr(10)),
  lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM protocol_docs),
 ln AS (SELECT doc_id, char_count, len(l) AS line_count, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM ln0)"""
TRIGGER = f"regexp_matches(lower(line), {q('|'.join(V.NEGATION_TRIGGERS))})"
HEADER = """CASE WHEN contains(lower(line), 'inclusion') AND (contains(lower(line), 'criteria') OR contains(lower(line), 'requirements')) THEN 'inclusion'
 WHEN contains(lower(line), 'exclusion') AND (contains(lower(line), 'criteria') OR contains(lower(line), 'contraindications')) THEN 'exclusion' END"""
CONTEXT = f"""{LINES}, lx AS (SELECT *, {TRIGGER} OR coalesce(lag({TRIGGER}) OVER (PARTITION BY doc_id ORDER BY line_no), FALSE) AS negated,
  {HEADER} AS header, CASE WHEN {HEADER} IS NULL THEN last_value({HEADER} IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS section FROM ln)"""


def title_sql(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({x}), '[a-z]+|[^a-z]+'),"
        " lambda w: upper(w[1]) || w[2:]), '')"
    )


CONDITIONS = "cd AS (SELECT DISTINCT doc_id, condition, negated FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, negated, {title_sql(f'regexp_extract(line, {q(T.FLAGS + p)}, 0)')} AS condition FROM lx"
    for p in V.CONDITION_PATTERNS
) + ") x WHERE condition <> '')"

DOSE = q(f"(?is){V.DOSE_PATTERN}")
DOSE_AT = q(f"(?is)^{V.DOSE_PATTERN}")
CLAUSE = "lower(regexp_extract(aft, '^[^.;]*', 0))"
FREQUENCY = (
    "CASE "
    + " ".join(
        f"WHEN regexp_matches({CLAUSE}, {q(T.FLAGS + p)}) THEN {q(label)}"
        for p, label in V.DOSING_FREQUENCIES
    )
    + " WHEN route <> '' THEN route ELSE 'Unspecified' END"
)
# The text is cut at every dose; what follows one is rebuilt from the remaining pieces.
DOSES = f"""ps AS (SELECT doc_id, string_split(regexp_replace(text, {DOSE}, chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS p FROM protocol_docs),
 pi AS (SELECT doc_id, i, split_part(p[i], chr(2), 1) AS m, replace(array_to_string(p[i:], ''), chr(2), '') AS rest
  FROM (SELECT doc_id, p, unnest(range(2, len(p) + 1)) AS i FROM ps) x),
 md AS (SELECT doc_id, i, m AS snippet, trim(regexp_extract(m, {DOSE_AT}, 1)) AS medication, trim(regexp_extract(m, {DOSE_AT}, 2)) AS dose,
  regexp_extract(m, {DOSE_AT}, 3) AS route, substr(rest, length(m) + 1, {V.DOSE_CONTEXT}) AS aft FROM pi),
 ms AS (SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS ordinal, medication, dose, {FREQUENCY} AS route_frequency, snippet
  FROM md WHERE lower(medication) NOT IN ({', '.join(q(w) for w in V.DOSE_STOP_WORDS)}))"""

LAB = q(T.FLAGS + V.LAB_PATTERN)
LABS = f"""lb0 AS (SELECT doc_id, regexp_extract_all(text, {LAB}, 0) AS l FROM protocol_docs),
 lb AS (SELECT doc_id, cast(i - 1 AS INT) AS ordinal, regexp_extract(s, {LAB}, 1) AS biomarker, regexp_extract(s, {LAB}, 2) AS operator,
  trim(regexp_extract(s, {LAB}, 2) || ' ' || regexp_extract(s, {LAB}, 3)) AS value, regexp_extract(s, {LAB}, 4) AS unit, s AS snippet
  FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM lb0) x)"""

RA, RL = q(V.RULE_AGE_PATTERN), q(V.RULE_LAB_PATTERN)
RULES = f"""ru0 AS (SELECT doc_id, line_no, line, section, negated, regexp_extract(lower(line), {RA}, 1) AS a1, regexp_extract(lower(line), {RA}, 2) AS a2,
  regexp_extract(lower(line), {RL}, 1) AS b1, regexp_extract(lower(line), {RL}, 2) AS b2, regexp_extract(lower(line), {RL}, 3) AS b3
  FROM lx WHERE section IS NOT NULL AND length(line) > 10),
 ru AS (SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id, section ORDER BY line_no) - 1 AS INT) AS ordinal, section AS type, line AS raw_text,
  CASE WHEN a1 <> '' THEN 'age' WHEN b1 <> '' THEN 'lab' WHEN section = 'inclusion' THEN 'condition' ELSE 'exclusion' END AS criterion_type,
  CASE WHEN a1 <> '' THEN 'Age Requirement' WHEN b1 <> '' THEN upper(b1) ELSE substr(line, 1, 50) END AS name,
  CASE WHEN a1 <> '' THEN CASE WHEN coalesce(try_cast(a2 AS INT), 0) = 0 THEN '>=' ELSE 'between' END WHEN b1 <> '' THEN b2 END AS operator,
  CASE WHEN a1 <> '' THEN cast(try_cast(a1 AS INT) AS VARCHAR) WHEN b1 <> '' THEN b3 END AS value,
  CASE WHEN a1 <> '' AND try_cast(a2 AS INT) <> 0 THEN try_cast(a2 AS INT) END AS max_value,
  CASE WHEN a1 <> '' THEN 'years' WHEN b1 = 'hba1c' THEN '%' WHEN b1 = 'bmi' THEN 'kg/m2' WHEN b1 <> '' THEN 'units' END AS unit,
  section = 'inclusion' AS required, negated FROM ru0)"""
RULE_COLUMNS = (
    "doc_id", "ordinal", "type", "raw_text", "criterion_type", "name", "operator", "value",
    "max_value", "unit", "required", "negated",
)


@reg.add(
    "t01_document_lines",
    "protocol_docs",
    f"WITH {LINES} SELECT doc_id, cast(char_count AS INT) AS char_count, cast(line_count AS INT) AS line_count, cast(line_no AS INT) AS line_no, line FROM ln",
)
def _(v):
    return T.document_lines(v.protocol_docs)


@reg.add(
    "w06_negation_context",
    "protocol_docs",
    f"WITH {CONTEXT} SELECT doc_id, cast(line_no AS INT) AS line_no, line, negated FROM lx",
)
def _(v):
    return T.negation_context(v.protocol_docs)


@reg.add(
    "w07_section_state",
    "protocol_docs",
    f"WITH {CONTEXT} SELECT doc_id, cast(line_no AS INT) AS line_no, line, section FROM lx",
)
def _(v):
    return T.section_state(v.protocol_docs)


@reg.add(
    "t02_extract_conditions", "protocol_docs", f"WITH {CONTEXT}, {CONDITIONS} SELECT * FROM cd"
)
def _(v):
    return T.extract_conditions(v.protocol_docs)


@reg.add(
    "t03_extract_medications",
    "protocol_docs",
    f"WITH {DOSES} SELECT doc_id, ordinal, medication, dose, snippet FROM ms",
)
def _(v):
    return T.extract_medications(v.protocol_docs).select(
        "doc_id", "ordinal", "medication", "dose", "snippet"
    )


@reg.add(
    "t04_dosing_frequency",
    "protocol_docs",
    f"WITH {DOSES} SELECT doc_id, ordinal, route_frequency FROM ms",
)
def _(v):
    return T.extract_medications(v.protocol_docs, None).select(
        "doc_id", "ordinal", "route_frequency"
    )


@reg.add(
    "t05_extract_labs",
    "protocol_docs",
    f"WITH {LABS} SELECT * FROM lb",
)
def _(v):
    return T.extract_labs(v.protocol_docs).drop("confidence")


@reg.add(
    "t06_extract_criteria",
    "protocol_docs",
    f"WITH {CONTEXT}, {RULES} SELECT {', '.join(RULE_COLUMNS)} FROM ru",
)
def _(v):
    return T.extract_criteria(v.protocol_docs).select(*RULE_COLUMNS)


# Without their section headers the documents get the default rules.
HEADERS = "(In|Ex)clusion Criteria:"
PLAIN = f"""headed AS (SELECT * FROM protocol_docs),
 plain AS (SELECT doc_id, regexp_replace(text, '{HEADERS}', 'Notes:', 'g') AS text FROM headed)"""


@reg.add(
    "t07_default_criteria",
    "protocol_docs",
    f"""WITH {PLAIN}, {(CONTEXT + ', ' + RULES + ', ' + CONDITIONS + ', ' + LABS).replace('FROM protocol_docs', 'FROM plain')}
 SELECT doc_id, raw_text, criterion_type, count(*) AS rules FROM (
  SELECT doc_id, 'Documented diagnosis of ' || condition AS raw_text, 'condition' AS criterion_type FROM cd WHERE NOT negated
  UNION ALL SELECT doc_id, 'Biomarker requirement: ' || biomarker || ' ' || value || ' ' || unit, 'lab' FROM lb) x
 WHERE doc_id NOT IN (SELECT doc_id FROM ru) GROUP BY 1, 2, 3""",
)
def _(v):
    plain = v.protocol_docs.withColumn("text", F.regexp_replace("text", HEADERS, "Notes:"))
    found = T.default_criteria(plain, None)
    return found.groupBy("doc_id", "raw_text", "criterion_type").agg(
        F.count(F.lit(1)).alias("rules")
    )


def count_sql(table: str, where: str = "TRUE") -> str:
    return f"(SELECT cast(count(*) AS INT) FROM {table} c WHERE c.doc_id = d.doc_id AND {where})"


@reg.add(
    "t08_document_summary",
    "protocol_docs",
    f"""WITH {CONTEXT}, {RULES}, {CONDITIONS}, {LABS}, {DOSES} SELECT doc_id, cast(char_count AS INT) AS char_count, cast(len(l) AS INT) AS line_count,
 {count_sql('cd', 'NOT negated')} AS conditions, {count_sql('cd', 'negated')} AS negated_conditions, {count_sql('ms')} AS medications,
 {count_sql('lb')} AS labs, {count_sql('ru')} AS rules FROM ln0 d""",
)
def _(v):
    return T.document_summary(v.protocol_docs)


def any_sql(words, text: str = "lt") -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def hits_sql(lexicon) -> str:
    cases = ", ".join(f"CASE WHEN {any_sql(words)} THEN {q(name)} END" for name, words in lexicon)
    return f"array_to_string(list_filter([{cases}], lambda h: h IS NOT NULL), ';')"


TAGS = f"""qs AS (SELECT conv_id, turn, lower(text) AS lt FROM conversations
  UNION ALL SELECT doc_id, -1, lower(text) FROM protocol_docs),
 tg AS (SELECT conv_id, turn, lt, {hits_sql(V.QUESTION_CONDITIONS)} AS conditions, {hits_sql(V.QUESTION_DRUGS)} AS drugs,
  CASE WHEN {any_sql(V.QUESTION_AGE_WORDS)} THEN try_cast(regexp_extract(lt, {q(V.QUESTION_AGE_PATTERN)}, 1) AS INT) END AS a,
  CASE WHEN {any_sql(V.QUESTION_LAB_WORDS)} THEN try_cast(regexp_extract(lt, {q(V.QUESTION_LAB_PATTERN)}, 1) AS DOUBLE) END AS min_hba1c,
  CASE {' '.join(f"WHEN contains(lt, {q(p)}) THEN {q(p.title())}" for p in V.QUESTION_PHASES)} END AS phase,
  {any_sql(V.QUESTION_ADVERSE_WORDS)} AS is_adverse, {any_sql(V.QUESTION_COMPARE_WORDS)} AS is_compare FROM qs),
 tf AS (SELECT *, coalesce(CASE WHEN a > 0 THEN a END, CASE WHEN contains(lt, 'elderly') THEN 65 END, a) AS min_age FROM tg)"""
CATEGORY = (
    "CASE WHEN conditions <> '' OR drugs <> '' OR coalesce(min_age, 0) <> 0 OR coalesce(min_hba1c, 0) <> 0 OR is_adverse THEN 'dynamic_slice' "
    + " ".join(f"WHEN {any_sql(words)} THEN {q(name)}" for name, words in V.QUESTION_CATEGORIES)
    + " ELSE 'general' END"
)


@reg.add(
    "t09_tag_questions",
    "protocol_docs",
    f"""WITH {TAGS} SELECT conv_id, turn, conditions, drugs, min_age, min_hba1c, phase, is_adverse, is_compare, {CATEGORY} AS category FROM tf""",
)
def _(v):
    asked = v.table("conversations").select("conv_id", "turn", "text")
    docs = v.protocol_docs.select(
        F.col("doc_id").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), "text"
    )
    tagged = T.tag_questions(asked.unionByName(docs))
    return tagged.withColumns(
        {c: F.array_join(c, ";") for c in ("conditions", "drugs")}
    ).drop("text", "role")


TA, TL = q(V.TEXT_AGE_PATTERN), q(V.TEXT_LAB_PATTERN)


def word_sql(words) -> str:
    return "CASE " + " ".join(f"WHEN contains(lt, {q(w)}) THEN {q(w)} END" for w in words[:0]) + " ".join(
        f"WHEN contains(lt, {q(w)}) THEN {q(w)}" for w in words
    ) + " END"


@reg.add(
    "m03_parse_text_criteria",
    "protocol_docs",
    f"""WITH {CONTEXT}, tx AS (SELECT DISTINCT line, lower(line) AS lt FROM lx WHERE section IS NOT NULL),
 pr AS (SELECT line, regexp_extract(lt, {TA}, 1) AS a0, regexp_extract(lt, {TA}, 2) AS a1, regexp_extract(lt, {TA}, 3) AS a2,
  regexp_extract(lt, {TL}, 1) AS b1, regexp_extract(lt, {TL}, 2) AS b2, regexp_extract(lt, {TL}, 3) AS b3,
  {word_sql(V.TEXT_CONDITIONS)} AS c, {word_sql(V.TEXT_MEDICATIONS)} AS m, {any_sql(V.TEXT_NEGATIONS)} AS neg FROM tx)
 SELECT line, CASE WHEN a1 <> '' THEN 'age' WHEN b1 <> '' THEN 'lab' WHEN c IS NOT NULL THEN 'condition' WHEN m IS NOT NULL THEN 'medication' ELSE 'review' END AS kind,
 CASE WHEN a1 <> '' THEN NULL WHEN b1 <> '' THEN b1 WHEN c IS NOT NULL THEN c ELSE m END AS name,
 CASE WHEN a1 <> '' THEN CASE WHEN a0 IN ('<', '<=') THEN a0 ELSE '>=' END
  WHEN b1 <> '' THEN CASE WHEN b2 = '' OR contains(b2, 'least') OR contains(b2, '>=') THEN '>=' WHEN contains(b2, '<=') THEN '<='
   WHEN contains(b2, '>') OR contains(b2, 'greater') THEN '>' WHEN contains(b2, '<') OR contains(b2, 'less') THEN '<' ELSE '==' END END AS operator,
 CASE WHEN a1 <> '' THEN try_cast(a1 AS DOUBLE) WHEN b1 <> '' THEN try_cast(b3 AS DOUBLE) END AS value,
 CASE WHEN a1 <> '' AND a0 NOT IN ('<', '<=') AND try_cast(a2 AS INT) > 0 THEN try_cast(a2 AS DOUBLE) END AS max_value,
 CASE WHEN a1 <> '' OR b1 <> '' THEN TRUE WHEN c IS NOT NULL OR m IS NOT NULL THEN NOT neg ELSE TRUE END AS required FROM pr""",
)
def _(v):
    lines = T.section_state(v.protocol_docs).where(F.col("section").isNotNull())
    return M.parse_text_criteria(lines, "line").drop("label")
