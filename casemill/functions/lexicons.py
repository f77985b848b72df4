"""Vocabularies, patterns and formats that results depend on, stated plainly."""

from __future__ import annotations

MASK = "[MASK]"
MASK_TYPES = ("AGE", "DATE", "ID", "LOCATION", "LOW_RISK_WORDING", "NAME", "ORGANIZATION", "SEX")
PATHOGENS = ("Lassa", "Hanta", "Puumala")

# Regular expressions without flags; they are matched without regard to case.
ID_PATTERN = r"\b(?:patient\s*)?(?:id|mrn|record|case)\s*(?:no\.?|number|#|:)?\s*[A-Z0-9-]{3,}\b"
AGE_PATTERN = r"\b\d{1,3}\s*(?:-\s*)?(?:year|yr)s?\s*(?:-\s*)?old\b|\b\d{1,3}\s*(?:y/o|yo)\b"
DATE_PATTERN = (
    r"\b(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4})\b"
    r"|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2}(?:\s*(?:st|nd|rd|th))?,?\s+\d{4}\b"
    r"|\b\d{1,2}\s*(?:st|nd|rd|th)?,?\s+\d{4}\b"
)
MEDICAL_PATTERN = r"\b(?:RT-?PCR|PCR|Ig[AGM]|Vero\s+E6|[A-Za-z]+virus)\b"
SAFE_TOKEN_PATTERN = r"^[A-Za-z][A-Za-z'-]*$"
MONTH_DAY_PATTERN = r"^([A-Za-z]{3,9})\s+(\d{1,2})(st|nd|rd|th)?$"
WEEK_RANGE_PATTERN = r"^(\d{1,2})\s*[-–]\s*(\d{1,2})\s+weeks?$"
GESTATIONAL_PATTERN = r"^((?:gestational\s+)?age\s+)(\d{1,2})(\s+weeks?)$"
DURATION_PATTERN = r"^(\d{1,3})(\s*)(days?|weeks?|months?|years?)$"

SEX_TERMS = ("male", "female", "man", "woman", "boy", "girl", "gentleman", "lady", "he", "she", "his", "her", "him", "hers")
SEX_PAIRS = {"male": "female", "female": "male", "man": "woman", "woman": "man", "boy": "girl", "girl": "boy", "he": "she", "she": "he", "his": "her", "her": "his", "him": "her", "hers": "his"}
ALLOWED_POS = ("ADJ", "ADV", "VERB")
SAFE_VERBS = ("present", "complain", "develop", "report", "show", "include", "remain", "appear", "continue", "experience", "notice", "observe", "improve")
PROTECTED_TERMS = (
    "death", "dead", "died", "recovered", "recovery", "discharged", "diagnosis", "diagnosed", "treated", "treatment",
    "ribavirin", "antibiotics", "fever", "lassa", "chapare", "virus", "positive", "negative", "pregnant", "pregnancy",
)
MEDICAL_TERMS = (
    "antigen", "antibiotic", "antibiotics", "arthralgia", "assay", "chapare", "diagnosis", "diagnosed", "fever", "hanta", "hantaan",
    "hantavirus", "hantaviral", "hunta", "igg", "igm", "lassa", "lasv", "machupo", "myalgia", "orthohantavirus", "pcr", "pregnancy",
    "pregnant", "puumala", "puuv", "ribavirin", "rt-pcr", "treatment", "treated", "vero", "virus", "vomiting",
)
MEDICAL_SUFFIXES = ("algia", "emia", "itis", "osis", "pathy", "pnea", "rrhea", "virus")
NEGATION_TERMS = ("absent", "denied", "denies", "negative", "neither", "never", "no", "none", "not", "without")
SEVERITY_TERMS = ("acute", "critical", "fatal", "mild", "moderate", "severe", "stable", "worsening")
TEMPORALITY_TERMS = ("after", "before", "during", "earlier", "initial", "initially", "later", "prior", "subsequent", "subsequently")
OUTCOME_TERMS = ("dead", "death", "died", "discharged", "fatal", "recovered", "recovery", "survived")
POLARITY_TERMS = ("positive", "negative", "normal", "abnormal")
SAFE_LOW_RISK_WORDS = ("also", "apparently", "commonly", "generally", "mainly", "primarily", "reportedly", "typically")
PROTECTED_PATHOGENS = ("hanta", "hantaan", "hantavirus", "hantaviral", "hunta", "lassa", "lasv", "orthohantavirus", "puumala", "puuv")
FLAGS = ("medical_concept", "negation_sensitive", "severity_sensitive", "temporality_sensitive", "outcome_sensitive", "polarity_sensitive")

FIRST_NAMES = ("Alex", "Jordan", "Taylor", "Morgan", "Casey", "Riley", "Avery", "Jamie")
LAST_NAMES = ("Turner", "Hayes", "Morgan", "Reed", "Carter", "Brooks", "Parker", "Bennett")
LOCATIONS = ("Northfield", "Riverton", "Lakeside", "Fairview", "Westbrook", "Hillcrest")
ORGANIZATIONS = ("Central Medical Center", "Regional General Hospital", "Community Health Clinic")
AGE_SPREAD = {"pediatric": 2, "adult": 5, "older_adult": 4}

CONSTRAINTS = {
    "NAME": "replace with a fictitious person name or neutral placeholder",
    "SEX": "prefer preserving the original sex unless all related pronouns and sex-specific facts are updated consistently",
    "DATE": "shift all dates in the same case by the same offset and preserve chronology",
    "LOCATION": "replace with a fictitious or coarse location that does not identify a person",
    "ORGANIZATION": "replace with a fictitious institution name or neutral placeholder",
    "ID": "replace with a fictitious identifier using the same broad format",
    "LOW_RISK_WORDING": "replace only with a clinically neutral word of the same role",
}
AGE_CONSTRAINT = "replace only within the same age category ({}) and keep the year-old wording"
AGE_CONSTRAINT_UNKNOWN = "replace with a plausible age expression in the same clinical age category"
CONSTRAINT_DEFAULT = "replace conservatively without changing clinical facts"
PROTECTION_POLICY = "medical terms, negation, severity, temporality, polarity, and outcomes are excluded from LOW_RISK_WORDING"
#: Strings that stand for a missing value in delimited files.
NA_STRINGS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
SENSITIVE_TERMS = tuple(sorted({*NEGATION_TERMS, *SEVERITY_TERMS, *TEMPORALITY_TERMS, *OUTCOME_TERMS, *POLARITY_TERMS, *MEDICAL_TERMS}))

#: Names of how neutral words are filled, and the name of the model they are given under; fixed values.
METHOD_MODEL, METHOD_FILTERED, METHOD_FALLBACK = "bio_clinicalbert_low_risk_wording", "bio_clinicalbert_filtered", "fallback_restore_original"
