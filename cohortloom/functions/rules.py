"""Ordered rule tables and the Column builders that apply them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortloom.functions.binding import let

# Canonical phases with their spellings, tried in the order below.
PHASE_SPELLINGS: list[tuple[str, list[str]]] = [
    ("Phase I/II", ["Phase 1/2", "Phase I-II", "Phase 1-2", "Phase I and II", "Phase 1 / 2"]),
    ("Phase II/III", ["Phase 2/3", "Phase 2-3", "Phase 2 / 3", "Phase II/III", "Phase II and III"]),
    ("Phase IV", ["Phase 4", "Phase IV study", "post-marketing study"]),
    ("Phase III", ["Phase 3", "Phase III study", "Phase 3 trial", "phase III trial"]),
    ("Phase II", ["Phase 2", "Phase II study", "Phase IIA", "Phase IIB", "Phase IIR", "Phase IIR/III",
                  "Phase II and Phase III", "Phase II-III"]),
    ("Phase I", ["Phase 1", "Phase I study", "first-in-human", "phase 1 trial", "phase I trial"]),
]

# Disease names with the spellings that map to them.
DISEASE_SPELLINGS: dict[str, list[str]] = {
    "Breast Cancer": ["breast carcinoma", "invasive breast cancer", "breast adenocarcinoma", "ductal carcinoma",
                      "lobular carcinoma", "DCIS", "breast neoplasm"],
    "Non-Small Cell Lung Cancer": ["NSCLC", "non-small cell lung", "non-small-cell lung", "lung adenocarcinoma",
                                   "lung squamous cell"],
    "Small Cell Lung Cancer": ["SCLC", "small cell lung", "small-cell lung"],
    "Glioblastoma": ["GBM", "glioblastoma multiforme"],
    "Melanoma": ["malignant melanoma", "cutaneous melanoma"],
    "Colorectal Cancer": ["colon and rectal cancer", "CRC", "colon cancer", "rectal cancer", "rectal adenocarcinoma",
                          "colon adenocarcinoma", "colorectal adenocarcinoma"],
    "Pancreatic Cancer": ["pancreatic adenocarcinoma", "pancreatic carcinoma", "pancreas cancer"],
    "Hepatocellular Carcinoma": ["HCC", "liver cancer", "hepatocellular cancer"],
    "Renal Cell Carcinoma": ["RCC", "kidney cancer", "renal cancer"],
    "Bladder Cancer": ["urothelial carcinoma", "bladder carcinoma", "urothelial cancer"],
    "Ovarian Cancer": ["ovarian carcinoma", "ovarian neoplasm"],
    "Endometrial Cancer": ["uterine cancer", "endometrial carcinoma", "uterine carcinoma"],
    "Cervical Cancer": ["cervical carcinoma", "cervix cancer"],
    "Head and Neck Cancer": ["head and neck squamous cell carcinoma", "HNSCC", "oropharyngeal cancer",
                             "oropharyngeal carcinoma", "oral cavity cancer", "laryngeal cancer",
                             "hypopharyngeal cancer"],
    "Nasopharyngeal Carcinoma": ["NPC", "nasopharyngeal cancer", "nasopharynx cancer"],
    "Prostate Cancer": ["prostate carcinoma", "prostate adenocarcinoma"],
    "Hodgkin Lymphoma": ["Hodgkin disease", "Hodgkin's disease", "Hodgkin's lymphoma", "classical Hodgkin lymphoma"],
    "Non-Hodgkin Lymphoma": ["NHL", "diffuse large B-cell lymphoma", "DLBCL", "follicular lymphoma",
                             "mantle cell lymphoma"],
    "Brain Metastases": ["brain mets", "cerebral metastases", "intracranial metastases"],
    "Rhabdomyosarcoma": ["RMS"],
    "Ewing Sarcoma": ["Ewing's sarcoma", "Ewing tumor"],
    "Neuroblastoma": [],
    "Wilms Tumor": ["nephroblastoma", "Wilm's tumor"],
    "Medulloblastoma": [],
    "Meningioma": [],
    "Ependymoma": [],
    "Esophageal Cancer": ["esophageal carcinoma", "esophageal adenocarcinoma", "esophageal squamous cell carcinoma",
                          "oesophageal cancer"],
    "Gastric Cancer": ["stomach cancer", "gastric carcinoma", "gastric adenocarcinoma"],
    "Basal Cell Carcinoma": ["BCC"],
    "Merkel Cell Carcinoma": [],
    "Osteosarcoma": ["osteogenic sarcoma"],
    "Pediatric ALL": ["acute lymphoblastic leukemia"],
    "Multiple Myeloma": ["myeloma"],
    "Sarcoma": ["soft tissue sarcoma"],
    "Cutaneous SCC": ["cutaneous squamous cell carcinoma", "cSCC"],
    "Desmoid Tumor": ["aggressive fibromatosis", "desmoid-type fibromatosis"],
}

# Radiation techniques, specific ones first.
TECHNIQUE_SPELLINGS: dict[str, list[str]] = {
    "EBRT": ["external beam radiation therapy", "external beam radiotherapy", "external beam radiation",
             "external beam RT", "external radiation"],
    "IMRT": ["intensity-modulated radiation therapy", "intensity modulated radiation therapy",
             "intensity-modulated radiotherapy", "intensity modulated RT"],
    "VMAT": ["volumetric modulated arc therapy", "volumetric-modulated arc therapy", "RapidArc"],
    "3D-CRT": ["3D conformal", "3-dimensional conformal", "3D-conformal", "conformal radiotherapy",
               "conformal radiation therapy", "conventional radiotherapy", "conventional radiation therapy",
               "conventional RT"],
    "SBRT": ["stereotactic body radiotherapy", "stereotactic body radiation therapy",
             "stereotactic ablative radiotherapy", "SABR", "stereotactic body RT"],
    "SRS": ["stereotactic radiosurgery", "stereotactic radiation surgery", "Gamma Knife", "CyberKnife",
            "Linac-based SRS"],
    "IGRT": ["image-guided radiation therapy", "image guided radiation therapy", "image-guided radiotherapy",
             "image guided RT"],
    "Proton Therapy": ["proton beam therapy", "proton radiation", "proton beam", "PBT"],
    "Brachytherapy": ["internal radiation", "intracavitary radiation", "interstitial radiation",
                      "HDR brachytherapy", "LDR brachytherapy"],
    "TBI": ["total body irradiation"],
    "WBRT": ["whole brain radiotherapy", "whole brain radiation therapy", "whole brain RT", "whole-brain radiation"],
    "Electron Therapy": ["electron beam therapy", "electron beam", "electron therapy"],
    "Carbon Ion Therapy": ["carbon ion radiotherapy", "heavy ion therapy", "particle therapy"],
}

# Receptor and gene statements with the status they declare; the first hit per marker wins.
MARKER_PATTERNS: list[tuple[str, str, str]] = [
    (r"\ber\s*[\+]\s*|estrogen\s*receptor\s*positive", "ER", "positive"),
    (r"\ber\s*[\-]\s*|estrogen\s*receptor\s*negative", "ER", "negative"),
    (r"\bpr\s*[\+]\s*|progesterone\s*receptor\s*positive", "PR", "positive"),
    (r"\bpr\s*[\-]\s*|progesterone\s*receptor\s*negative", "PR", "negative"),
    (r"her.?2\s*[\+]|her.?2\s*positive|her.?2\s*amplified", "HER2", "positive"),
    (r"her.?2\s*[\-]|her.?2\s*negative|her.?2\s*non.amplified", "HER2", "negative"),
    (r"triple\s*negative|tnbc", "TNBC", "positive"),
    (r"egfr\s*mutant|egfr\s*mutation|egfr\s*positive|egfr\s*\+", "EGFR", "mutant"),
    (r"egfr\s*wild.?type|egfr\s*negative|egfr\s*wt", "EGFR", "wild-type"),
    (r"alk\s*positive|alk\s*\+|alk\s*rearrang|alk\s*fusion", "ALK", "positive"),
    (r"alk\s*negative|alk\s*\-", "ALK", "negative"),
    (r"pd.?l1\s*positive|pd.?l1\s*\+|pd.?l1\s*high", "PD-L1", "positive"),
    (r"pd.?l1\s*negative|pd.?l1\s*\-|pd.?l1\s*low", "PD-L1", "negative"),
    (r"kras\s*mutant|kras\s*mutation|kras\s*\+", "KRAS", "mutant"),
    (r"kras\s*wild.?type|kras\s*wt", "KRAS", "wild-type"),
    (r"braf\s*v600|braf\s*mutant|braf\s*mutation|braf\s*\+", "BRAF", "mutant"),
    (r"braf\s*wild.?type|braf\s*wt", "BRAF", "wild-type"),
    (r"msi.?h|microsatellite\s*instability.?high", "MSI", "high"),
    (r"mss|microsatellite\s*stable|msi.?l", "MSI", "stable"),
    (r"brca\s*mutant|brca\s*mutation|brca1|brca2", "BRCA", "mutant"),
    (r"hpv\s*positive|hpv\s*\+|p16\s*positive|p16\s*\+", "HPV", "positive"),
    (r"hpv\s*negative|hpv\s*\-|p16\s*negative|p16\s*\-", "HPV", "negative"),
]

# Genomic assays.
ASSAY_PATTERNS: list[tuple[str, str]] = [
    (r"oncotype\s*dx", "Oncotype DX"),
    (r"mammaprint", "MammaPrint"),
    (r"decipher", "Decipher"),
    (r"prolaris", "Prolaris"),
    (r"endopredict", "EndoPredict"),
    (r"prosigna|pam\s*50", "Prosigna"),
]

# Section name patterns and the section type they stand for.
SECTION_PATTERNS: list[tuple[str, str]] = [
    (r"\babstract\b|\bsummary\b|\bsynopsis\b", "abstract"),
    (r"\bbackground\b", "background"),
    (r"\bintroduction\b|\bobjective\b|\bpurpose\b|\baim\b", "introduction"),
    (r"\bmethods?\b|\bstudy\s+design\b", "methods"),
    (r"\bsearch\s+strategy\b|\bliterature\s+search\b", "methods"),
    (r"\bstatistical\s+analysis\b", "methods"),
    (r"\bpatient\s+population\b|\bpatient\s+selection\b|\bstudy\s+population\b", "methods"),
    (r"\btreatment\s+protocol\b|\btreatment\s+plan\b|\btreatment\s+regimen\b", "methods"),
    (r"\bdose\b.*\bfraction\b|\bdose\s+constraint\b|\bdose\s+escalat\b", "methods"),
    (r"\bresults?\b|\boutcomes?\b|\bfindings?\b", "results"),
    (r"\bsurvival\b|\befficacy\b", "results"),
    (r"\btoxicit\w+\b|\badverse\s+events?\b|\bsafety\b", "results"),
    (r"\blocal\s+control\b|\bprogression.free\b", "results"),
    (r"\bdiscussion\b", "discussion"),
    (r"\bconclusion\b", "conclusion"),
    (r"\beligib\w+\b|\binclusion\s+criteria\b|\bexclusion\s+criteria\b", "eligibility"),
    (r"\breferences?\b|\bbibliography\b", "references"),
    (r"\backnowledg\w+\b|\bfunding\b|\bdisclosures?\b|\bconflict\b|\bauthor\s+contrib", "acknowledgments"),
    (r"\bsupplement\w+\b|\bappendix\b", "supplementary"),
    (r"\bdata\s+sharing\b|\bdata\s+availab\b", "supplementary"),
]

# Treatment modalities and the words that show them.
MODALITY_WORDS: dict[str, list[str]] = {
    "radiation": ["radiation", "radiotherapy", "rt", "imrt", "vmat", "proton", "photon", "external beam", "ebrt"],
    "chemotherapy": ["chemotherapy", "chemo", "cisplatin", "carboplatin", "paclitaxel", "docetaxel", "gemcitabine",
                     "fluorouracil", "5-fu"],
    "surgery": ["surgery", "surgical", "resection", "excision", "mastectomy", "lobectomy", "prostatectomy"],
    "immunotherapy": ["immunotherapy", "immune checkpoint", "pd-1", "pd-l1", "pembrolizumab", "nivolumab",
                      "atezolizumab", "durvalumab", "ipilimumab"],
    "targeted_therapy": ["targeted therapy", "targeted", "tyrosine kinase", "tki", "egfr", "her2", "alk", "braf",
                         "mek"],
    "hormone_therapy": ["hormone therapy", "hormonal", "endocrine", "tamoxifen", "letrozole", "anastrozole", "adt",
                        "androgen deprivation"],
    "brachytherapy": ["brachytherapy", "brachy", "hdr", "ldr", "interstitial", "intracavitary"],
    "sbrt": ["sbrt", "srs", "stereotactic", "radiosurgery", "cyberknife", "gamma knife"],
}


def any_contains(txt: Column, needles: Sequence[str]) -> Column:
    """True when the text holds one of the needles; one alternation, so one pass over the text."""
    import re

    return txt.rlike("|".join(re.escape(n) for n in needles))


def first_rule(txt: Column, rules: Sequence[tuple[str, str]], default: Column | None = None) -> Column:
    """Value of the first (pattern, value) rule whose pattern is found."""
    hits = [F.when(txt.rlike(pattern), F.lit(value)) for pattern, value in rules]
    return F.coalesce(*hits, default if default is not None else F.lit(None).cast("string"))


def first_contained(txt: Column, rules: Sequence[tuple[str, Sequence[str]]], default: Column) -> Column:
    """Canonical name of the first rule one of whose needles the text contains.

    The rules travel as one literal array: a CASE with this many branches would outgrow the
    JVM method limit and push the whole stage out of code generation.
    """
    table = F.array(
        *(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, needles)).alias("needles")) for name, needles in rules)
    )
    first = let(txt, lambda t: F.get(F.filter(table, lambda r: F.exists(r["needles"], lambda n: t.contains(n))), F.lit(0))["name"])
    return F.coalesce(first, default)


def _blank_to_null(txt: Column) -> Column:
    return F.nullif(F.trim(txt), F.lit(""))


def normalize_phase(txt: Column) -> Column:
    """Canonical phase by spelling; blank is NULL, unknown text is title-cased."""
    clean = _blank_to_null(txt)
    hits = [
        F.when(F.lower(clean).isin([canonical.lower(), *[s.lower() for s in spellings]]), F.lit(canonical))
        for canonical, spellings in PHASE_SPELLINGS
    ]
    return F.coalesce(*hits, F.initcap(clean))


def disease_rules() -> list[tuple[str, list[str]]]:
    """Disease rules, longest canonical name first."""
    ordered = sorted(DISEASE_SPELLINGS, key=len, reverse=True)
    return [(name, [name.lower(), *[s.lower() for s in DISEASE_SPELLINGS[name]]]) for name in ordered]


def normalize_category(txt: Column) -> Column:
    """Canonical disease whose spelling is contained in the text."""
    clean = _blank_to_null(txt)
    return first_contained(F.lower(clean), disease_rules(), F.initcap(clean))


def technique_rules() -> list[tuple[str, list[str]]]:
    """Technique rules in the order they are tried."""
    rules = [(name, [name.lower(), *[s.lower() for s in alt]]) for name, alt in TECHNIQUE_SPELLINGS.items()]
    return [*rules, ("Radiotherapy (unspecified)", ["radiotherapy", "radiation therapy"])]


def normalize_technique(txt: Column) -> Column:
    """Canonical technique, with a catch-all for unspecified radiotherapy."""
    clean = _blank_to_null(txt)
    return first_contained(F.lower(clean), technique_rules(), F.initcap(clean))


def marker_status(txt: Column) -> Column:
    """I8: map marker -> status from free text, the first declared status per marker kept."""
    low = F.lower(txt)
    names = list(dict.fromkeys(name for _, name, _ in MARKER_PATTERNS))
    entries = []
    for name in names:
        status = first_rule(low, [(p, s) for p, n, s in MARKER_PATTERNS if n == name])
        entries.append(F.when(status.isNotNull(), F.struct(F.lit(name).alias("key"), status.alias("value"))))
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def genomic_assay(txt: Column) -> Column:
    """I8: first genomic assay named in the text."""
    return first_rule(F.lower(txt), ASSAY_PATTERNS)


def section_type(name: Column, text: Column | None = None, head_chars: int | None = None) -> Column:
    """Section type by name, then by the text (its first ``head_chars``, if given), else "other"."""
    clean = F.trim(F.regexp_replace(F.lower(F.trim(name)), r"^#+", ""))
    found = first_rule(clean, SECTION_PATTERNS)
    if text is not None:
        judged = F.substring(text, 1, head_chars) if head_chars else text
        found = F.coalesce(found, first_rule(F.lower(judged), SECTION_PATTERNS))
    return F.coalesce(found, F.lit("other"))
