"""Labels, thresholds, templates, word lists and text patterns.

Everything here is a constant whose exact value decides a result.  Logic lives
elsewhere.
"""

from __future__ import annotations

from typing import NamedTuple

# --- Fixed values: response labels -----------------------------------------

STRONG, MODERATE = "Strong Response", "Moderate Response"
MINIMAL, NO_RESPONSE, WORSENED = "Minimal Response", "No Response", "Worsened"
UNKNOWN = "Unknown"
POSITIVE = (STRONG, MODERATE)
NON_RESPONDER = (MINIMAL, NO_RESPONSE, WORSENED)
WITHDRAWN_STATUSES = ("WITHDRAWN", "DROPPED_OUT", "TERMINATED")
COMPLETED_SPELLINGS = ("Completed", "COMPLETED", "completed", "Complete")

# --- Fixed values: response thresholds (percent; direction -1 = lower is better)


class Threshold(NamedTuple):
    outcome_type: str
    strong: float
    moderate: float
    minimal: float
    direction: int


THRESHOLDS = (
    Threshold("HbA1c", 20.0, 10.0, 5.0, -1),
    Threshold("tumor_size", 30.0, 15.0, 5.0, -1),
    Threshold("pain_score", 50.0, 30.0, 10.0, -1),
    Threshold("CD4_count", 30.0, 15.0, 5.0, 1),
)
DEFAULT_THRESHOLD = Threshold("default", 20.0, 10.0, 5.0, -1)

# --- Fixed values: stream classification -----------------------------------

STREAM_BASELINE = 9.1
STREAM_BIOMARKER = "HbA1c"

# --- Fixed values: age bins (lower edges) and labels ------------------------

AGE_BUCKET_EDGES = (0, 18, 30, 45, 60, 75, 200)
AGE_BUCKET_LABELS = ("<18", "18-30", "31-45", "46-60", "61-75", "75+")
AGE_GROUP_EDGES = (0, 30, 45, 60, 75, 120)
AGE_GROUP_LABELS = ("<30", "30-44", "45-59", "60-74", "75+")

# --- Fixed values: words that mark an earlier treatment failure -------------

FAILURE_WORDS = ("failed", "refractory", "resistant", "non-responder", "ineffective")

# --- Fixed values: factors associated with a weak response ------------------


class FactorText(NamedTuple):
    category: str
    name: str
    strength: float
    evidence_level: str
    description: str


FACTORS = {
    "high_baseline": FactorText(
        "Disease Severity",
        "High Baseline Disease Severity",
        0.72,
        "Moderate",
        "Elevated baseline disease marker associated with attenuated treatment response in analyzed cohort.",
    ),
    "prior_failure": FactorText(
        "Treatment History",
        "Previous Treatment Failure in Same Drug Class",
        0.68,
        "Moderate",
        "Prior failure of treatment in the same pharmacological class is associated with reduced response probability.",
    ),
    "comorbidity": FactorText(
        "Comorbidities",
        "Significant Comorbidity Burden",
        0.55,
        "Low",
        "Multiple concurrent conditions are associated with complex treatment responses and reduced efficacy in observational data.",
    ),
    "short_duration": FactorText(
        "Treatment Duration",
        "Short Treatment Duration",
        0.61,
        "Moderate",
        "Treatment duration below recommended protocol length is associated with incomplete therapeutic effect.",
    ),
    "variability": FactorText(
        "Biological Variability",
        "Individual Pharmacokinetic Variability",
        0.45,
        "Low",
        "Inter-individual variability in drug metabolism may contribute to differential response.",
    ),
    "age": FactorText(
        "Age-Related Factors",
        "Age-Related Treatment Response Attenuation",
        0.52,
        "Low",
        "Older age cohorts show attenuated treatment response in analyzed dataset, potentially related to polypharmacy and altered pharmacodynamics.",
    ),
    "delta": FactorText(
        "Biomarker Kinetics",
        "Insufficient Biomarker Delta",
        0.88,
        "High",
        "%s moved from %.1f to %.1f (%s%.1f%% effective relative change). Response threshold requires \u2265%.0f%% improvement \u2014 observed change is below the minimal clinically meaningful threshold.",
    ),
    "incomplete": FactorText(
        "Drug Adherence",
        "Incomplete Treatment Course",
        0.79,
        "High",
        "Patient did not complete the full treatment course. Premature discontinuation is strongly associated with sub-therapeutic exposure and attenuated clinical response in observational studies.",
    ),
    "adverse": FactorText(
        "Drug Adherence",
        "Adverse Event-Related Dose Reduction Risk",
        0.58,
        "Moderate",
        "Patient completed treatment but reported %d adverse event(s): %s. Multiple adverse events are associated with protocol deviations and de facto dose reductions that can attenuate therapeutic response.",
    ),
}

# --- Fixed values: response narratives (outcome type, direction, baseline, followup, unit, pct)

NARRATIVES = {
    STRONG: "The patient achieved a strong response. {type} {direction} from {baseline} to {followup} {unit} \u2014 a {pct}% relative change, exceeding the threshold for clinically meaningful improvement.",
    MODERATE: "The patient achieved a moderate response. {type} {direction} from {baseline} to {followup} {unit} ({pct}% relative change). While clinically meaningful, there may be opportunity for further optimisation.",
    MINIMAL: "The patient demonstrated a minimal response. {type} {direction} from {baseline} to {followup} {unit} ({pct}% relative change). The treatment effect was below the threshold for a clinically meaningful response.",
    NO_RESPONSE: "The patient showed no meaningful response. {type} remained essentially unchanged ({baseline} \u2192 {followup} {unit}, {pct}% change). Alternative therapeutic strategies should be explored.",
    WORSENED: "The patient's condition worsened during the trial. {type} {direction} from {baseline} to {followup} {unit} ({pct}% relative change). Urgent review of treatment strategy is warranted.",
    UNKNOWN: "{type} changed from {baseline} to {followup} {unit} during the trial period.",
}

# What each kind of factor rests on.
EVIDENCE = {
    "rule": "Identified in %,d similar patient records from the analytical dataset.",
    "delta": "Computed from patient's actual baseline\u2192followup biomarker trajectory.",
    "incomplete": "Derived from patient treatment_completed flag in trial outcome record.",
    "adverse": "Derived from adverse event count in patient outcome record.",
    "attribution": "Derived from TreeSHAP exact additive attribution across clinical gradient boosted trees.",
}
COHORT_SIZE = 1250

# How attributions were made.
SHAPLEY_METHOD = "treeshap_exact_additive"
IMPORTANCE_METHOD = "global_feature_importance_fallback"

# --- Fixed values: template pathways (category, title, description, rationale, evidence)


class Pathway(NamedTuple):
    category: str
    title: str
    description: str
    rationale: str
    evidence_level: str


PATHWAYS = (
    Pathway(
        "Alternative Treatment Class",
        "Evaluate Different Pharmacological Class",
        "Consider trials investigating alternative treatment mechanisms with different molecular targets.",
        "Patient showed {response} to {drug_class}. Alternative mechanisms may offer improved efficacy.",
        "Moderate",
    ),
    Pathway(
        "Combination Therapy",
        "Combination Therapy Trial Cohort",
        "Investigate trials combining the current agent with a synergistic partner compound.",
        "Combination approaches have demonstrated improved outcomes in similar patient profiles in the analyzed dataset.",
        "Low",
    ),
    Pathway(
        "Biomarker-Stratified Trial",
        "Biomarker-Specific Clinical Trial",
        "Search for trials with eligibility criteria specifically targeting this patient's biomarker profile.",
        "Patient's biomarker profile ({baseline}) may qualify for precision medicine trial cohorts.",
        "Moderate",
    ),
    Pathway(
        "Adherence Optimization",
        "Adherence-Focused Intervention Study",
        "Explore studies incorporating adherence support as a co-intervention.",
        "Adherence indicators suggest this pathway may improve overall treatment outcomes.",
        "Low",
    ),
    Pathway(
        "Observational Study",
        "Observational Cohort Study Enrollment",
        "Consider enrollment in a registry or longitudinal observational study to capture long-term outcomes.",
        "Long-term outcome tracking in observational studies can provide additional insights for treatment-resistant profiles.",
        "Low",
    ),
    Pathway(
        "Dose Optimization",
        "Dose-Optimization Protocol",
        "Investigate trials or protocols with individualized dosing based on pharmacokinetic/pharmacodynamic modeling.",
        "Current dosing strategy ({dose}) may benefit from individualized optimization based on patient characteristics.",
        "Moderate",
    ),
)

# --- Fixed values: research cohort templates --------------------------------


class CohortTemplate(NamedTuple):
    cohort_name: str
    cohort_type: str
    key_features: tuple[str, ...]
    positive_response_rate: float
    most_effective_treatment: str


COHORT_TEMPLATES = (
    CohortTemplate("Treatment-Resistant Cohort", "Treatment Response", ("minimal_response", "high_baseline", "prior_treatment"), 0.32, "Combination Therapy + Dose Escalation"),
    CohortTemplate("High-Biomarker Severity Cohort", "Biomarker", ("high_baseline", "long_disease_duration"), 0.44, "Intensified Therapy Protocol"),
    CohortTemplate("Previous Treatment Failure Cohort", "Treatment Response", ("prior_failure", "drug_class_switch"), 0.41, "Alternative Drug Class"),
    CohortTemplate("Combination Therapy Candidate Cohort", "Phenotypic", ("multi_comorbidity", "moderate_response"), 0.58, "Dual-Agent Protocol"),
    CohortTemplate("Moderate Responder Optimization Cohort", "Treatment Response", ("moderate_response", "completion"), 0.67, "Extended Duration Protocol"),
    CohortTemplate("Renal-Risk Cohort", "Biomarker", ("renal_comorbidity", "dose_adjustment"), 0.39, "Renal-Adjusted Dosing Protocol"),
)

# --- Fixed values: cluster names, in order ----------------------------------

CLUSTER_NAMES = (
    "Treatment-Resistant Diabetic Cohort",
    "High-Responder Metabolic Cohort",
    "Early-Stage Hypertensive Cohort",
    "Complex Multi-Comorbidity Cohort",
    "Standard Maintenance Cohort",
)

# --- Fixed values: cohorts of outcomes and of cases ---------------------------

RESISTANT_LABEL = "Treatment-Resistant Diabetic"
RESPONSIVE_LABEL = "Responsive Diabetic"
HYPERTENSION_LABEL = "Hypertension-Only"
OBESITY_LABEL = "Obesity-Only"
OTHER_LABEL = "Mixed Comorbidities"

RESISTANT_COHORT = "Treatment-Resistant Research Cohort"
MODERATE_COHORT = "Moderate Responder Research Cohort"
STRONG_COHORT = "Strong Responder Research Cohort"
GENERAL_COHORT = "General Study Cohort"

# --- Fixed values: texts of attribution factors -------------------------------

ATTRIBUTION_CATEGORY = "ML Feature Attribution"
ATTRIBUTION_NAME = "Negative Driver: "
ATTRIBUTION_LEVEL = "High"
ATTRIBUTION_TEXT = "Model attribution identified %s as an adverse predictor (%+.2f log-odds)."

# --- Fixed values: texts of derived criteria, before and after the value ------

MIN_AGE_NAME = "Minimum age "
MIN_AGE_TEXT = ("Minimum age: ", " years")
ADULT_NAME = "Age ≥ 18 (adult)"
ADULT_TEXT = "Age ≥ 18 years (adult participation)"
MAX_AGE_NAME = "Maximum age "
MAX_AGE_TEXT = ("Maximum age: ", " years")
DIAGNOSIS_TEXT = ("Diagnosis of ", " required for enrollment")
GENDER_TEXT = "Participant gender: "
HBA1C_TEXT = ("HbA1c ≥ ", "% at screening")

# --- Fixed values: text patterns ---------------------------------------------

NEGATION_TRIGGERS = (
    "no history of", "without documented", "free from", "absence of", "negative for",
    "not diagnosed", "excluding", "denied", "ruled out", "never had", "does not have",
    "no evidence of", "no known",
)

CONDITION_PATTERNS = (
    r"(?:Type\s*2\s*Diabetes|T2D|Diabetes\s*Mellitus|Diabetic\s*Nephropathy|Diabetic\s*Retinopathy)",
    r"(?:Hypertension|High\s*Blood\s*Pressure|HTN|Essential\s*Hypertension)",
    r"(?:Breast\s*Cancer|Carcinoma|Malignancy|Oncology|Colorectal\s*Cancer|Lung\s*Cancer|Melanoma)",
    r"(?:Heart\s*Failure|Congestive\s*Heart\s*Failure|CHF|Atrial\s*Fibrillation|Coronary\s*Artery\s*Disease|CAD)",
    r"(?:Chronic\s*Kidney\s*Disease|CKD|Renal\s*Impairment|End-Stage\s*Renal\s*Disease|ESRD)",
    r"(?:COPD|Asthma|Pulmonary\s*Disease|Interstitial\s*Lung\s*Disease)",
    r"(?:Depression|Major\s*Depressive\s*Disorder|Anxiety|Bipolar\s*Disorder)",
    r"(?:Obesity|Elevated\s*BMI|Metabolic\s*Syndrome)",
    r"(?:Rheumatoid\s*Arthritis|Osteoarthritis|Psoriasis|Systemic\s*Lupus)",
    r"(?:Non-Alcoholic\s*Fatty\s*Liver\s*Disease|NAFLD|NASH|Cirrhosis)",
)

# Words of which every alternative of the pattern at the same place contains one.
CONDITION_WORDS = (
    ("diabet", "t2d"),
    ("hypertension", "blood", "htn"),
    ("cancer", "carcinoma", "malignancy", "oncology", "melanoma"),
    ("failure", "chf", "fibrillation", "artery", "cad"),
    ("kidney", "ckd", "renal", "esrd"),
    ("copd", "asthma", "pulmonary", "lung"),
    ("depress", "anxiety", "bipolar"),
    ("obesity", "bmi", "metabolic"),
    ("arthritis", "psoriasis", "lupus"),
    ("fatty", "nafld", "nash", "cirrhosis"),
)
# Words of which every lab name contains one, and the start of every dose unit.
LAB_WORDS = (
    "hba1c", "egfr", "pressure", "bp", "bmi", "creatinine", "alt", "ast", "ldl", "hdl",
    "cholesterol", "triglycerides", "glucose", "uacr", "platelets", "hemoglobin",
)
DOSE_HINT = r"(?i)\d\s*(?:mg|g|mcg|ml|u|i)"

DOSE_PATTERN = (
    r"(\b[A-Z][a-z0-9\-]+(?:\s+[A-Z][a-z0-9\-]+)?)\s*"
    r"(\d+(?:\.\d+)?\s*(?:mg|g|mcg|ml|mg\/kg|units?|IU))"
    r"(?:\s+(oral|iv|subcutaneous|daily|bid|tid|qid|weekly|monthly))?"
)
DOSE_STOP_WORDS = (
    "figure", "table", "page", "section", "study", "patient", "group", "phase", "protocol",
    "cohort", "visit",
)
DOSE_CONTEXT = 50

DOSING_FREQUENCIES = (
    (r"\bonce\s*daily\b|\bqd\b|\bq\.?d\.?\b", "Once daily"),
    (r"\btwice\s*daily\b|\bbid\b|\bb\.?i\.?d\.?\b", "Twice daily (BID)"),
    (r"\bthree\s*times\s*daily\b|\btid\b|\bt\.?i\.?d\.?\b", "Three times daily (TID)"),
    (r"\bfour\s*times\s*daily\b|\bqid\b|\bq\.?i\.?d\.?\b", "Four times daily (QID)"),
    (r"\bweekly\b|\bonce\s*weekly\b|\bqw\b", "Weekly"),
    (r"\bevery\s*(\d+)\s*hours?\b|\bq(\d+)h\b", "Every N hours"),
    (r"\bmonthly\b|\bonce\s*monthly\b", "Monthly"),
    (r"\bpro re nata\b|\bprn\b|\bas\s*needed\b", "As needed (PRN)"),
)

LAB_PATTERN = (
    r"(HbA1c|eGFR|Blood\s*Pressure|Systolic\s*BP|Diastolic\s*BP|BMI|Creatinine|ALT|AST|LDL|HDL|"
    r"Total\s*Cholesterol|Triglycerides|Glucose|UACR|Platelets|Hemoglobin)\s*[:=]?\s*"
    r"(>=|<=|>|<|=)?\s*(\d+(?:\.\d+)?)\s*(%|mg\/dL|mmHg|kg\/m2|mL\/min|U\/L|g\/dL|mg\/g)?"
)

RULE_AGE_PATTERN = r"(?:age|aged)\s*(?:>=|>|between|from)?\s*(\d{1,2})\s*(?:to|-)?\s*(\d{1,2})?"
RULE_LAB_PATTERN = r"(hba1c|bmi|egfr|systolic)\s*([><=]+)\s*(\d+(?:\.\d+)?)"

# Confidences attached to extracted items.
DOSE_CONFIDENCE, LAB_CONFIDENCE = 0.94, 0.96
INCLUSION_CONFIDENCE, EXCLUSION_CONFIDENCE = 0.89, 0.88
DEFAULT_CONDITION_CONFIDENCE, DEFAULT_LAB_CONFIDENCE = 0.90, 0.92

# --- Fixed values: eligibility text -------------------------------------------

# The lab names carry word boundaries and the age rule also knows < and <=.
TEXT_AGE_PATTERN = (
    r"(?:age|aged)\s*(>=|<=|>|<|between|from)?\s*(\d{1,2})\s*(?:to|-|and)?\s*(\d{1,2})?"
)
TEXT_LAB_PATTERN = (
    r"\b(hba1c|egfr|bmi|systolic|creatinine|alt|ast|ldl|glucose)\b\s*"
    r"([><=]+|greater than|less than|at least)?\s*(\d+(?:\.\d+)?)"
)
TEXT_NEGATIONS = (
    "no history of", "excluding", "without documented", "free from", "absence of", "negative for",
    "not diagnosed",
)
TEXT_CONDITIONS = (
    "diabetes", "hypertension", "heart failure", "kidney disease", "renal impairment", "cancer",
    "copd", "asthma", "stroke", "hepatitis",
)
TEXT_MEDICATIONS = (
    "metformin", "lisinopril", "insulin", "glp-1", "sglt2", "atorvastatin", "aspirin", "steroid",
)

# --- Fixed values: research question lexicon ----------------------------------

QUESTION_CONDITIONS = (
    ("type 2 diabetes", ("type 2 diabetes", "t2d", "diabetes mellitus", "diabetic")),
    ("hypertension", ("hypertension", "high blood pressure", "htn")),
    ("obesity", ("obesity", "obese", "elevated bmi", "overweight")),
    ("chronic kidney disease", ("chronic kidney disease", "ckd", "renal", "kidney")),
    ("heart failure", ("heart failure", "chf", "congestive heart")),
    ("oncology / cancer", ("cancer", "carcinoma", "tumor", "oncology", "breast cancer")),
    ("asthma / copd", ("asthma", "copd", "pulmonary")),
)
QUESTION_DRUGS = (
    ("GLP-1 Receptor Agonist", ("glp-1", "glp1", "semaglutide", "liraglutide")),
    ("SGLT2 Inhibitor", ("sglt2", "sglt-2", "empagliflozin", "dapagliflozin")),
    ("DPP-4 Inhibitor", ("dpp-4", "dpp4", "januvia", "sitagliptin")),
    ("Metformin", ("metformin", "biguanide")),
    ("ACE Inhibitor / ARB", ("lisinopril", "ace inhibitor", "arb", "losartan")),
    ("Investigational Agent", ("investigational", "drug-x")),
)
QUESTION_PHASES = ("phase 1", "phase 2", "phase 3", "phase 4")
QUESTION_AGE_PATTERN = r"(?:age|aged|older than|>|>=|above)\s*(\d{2})"
QUESTION_AGE_WORDS = ("age", "older", "elderly", ">")
QUESTION_LAB_PATTERN = (
    r"(?:hba1c|a1c)\s*(?:>|>=|above|higher than|greater than)?\s*(\d+(?:\.\d+)?)"
)
QUESTION_LAB_WORDS = (">", "above", "high", "severe", "greater")
QUESTION_ADVERSE_WORDS = ("adverse", "side effect", "safety", "toxicity")
QUESTION_COMPARE_WORDS = ("compare", "versus", " vs ", "difference between")
QUESTION_CATEGORIES = (
    ("non_response", ("non-response", "not respond", "didn't respond", "low response", "why", "fail", "failure", "didn't work")),
    ("medication_effectiveness", ("response rate", "effective", "medication", "drug", "best treatment", "which treatment", "drug class")),
    ("trial_completion", ("completion", "dropout", "withdraw", "finish", "complete", "retention")),
    ("enrollment", ("enroll", "enrol", "recruitment", "eligible", "how many patient", "cohort size")),
    ("condition_breakdown", ("condition", "disease", "diagnosis", "indication", "prevalent", "common condition")),
)

# --- Fixed values: indications by drug class fragment -------------------------

INDICATIONS = (
    (("GLP",), "Type 2 Diabetes & Obesity"),
    (("ACE", "ARB"), "Hypertension & Cardiovascular"),
    (("SGLT",), "Type 2 Diabetes & Heart Failure"),
)
DEFAULT_INDICATION = "Type 2 Diabetes"
