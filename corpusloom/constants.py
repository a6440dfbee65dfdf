"""Fixed values that must equal the original project's for matching results.

Everything in this module is data, stated once and in its natural order. Logic lives elsewhere.
"""

# --- fixed values: single-character words that are legitimate (case-sensitive) -------------------
ONE_CHAR_ALLOW_FR = ["À", "A", "L", "D", "N", "Y", "M", "S", "T", "à", "a", "l", "d", "n", "y", "m", "s", "t"]
ONE_CHAR_ALLOW_EN = ["A", "I", "O", "a", "o"]

# --- fixed values: letters that always take an apostrophe in French, in replacement order ---------
APOSTROPHE_LETTERS = ["L", "D", "N", "M", "S", "T", "l", "d", "n", "m", "s", "t"]
STRAIGHT_APOSTROPHE = "'"
CURVED_APOSTROPHE = "’"

# --- fixed values: similarity cut points ----------------------------------------------------------
LOW_SIMILARITY = 0.757
TIER_S1_BELOW = 0.85
TIER_S2_BELOW = 0.92

# --- fixed values: outlier bounds per similarity tier (feature -> (low, high)), natural order ------
FEATURES = [
    "len_ratio",
    "verb_ratio",
    "noun_ratio",
    "entity_ratio",
    "clause_ratio",
    "one_char_words_fr",
    "one_char_words_en",
    "potential_fr_accent_issues",
]
OUTLIER_CRITERIA = {
    "s1": {
        "len_ratio": (0.75, 1.92),
        "verb_ratio": (0.75, 1.50),
        "noun_ratio": (1.00, 1.75),
        "entity_ratio": (0.33, 1.00),
        "clause_ratio": (1.00, 1.50),
        "one_char_words_fr": (0.0, 1.0),
        "one_char_words_en": (0.0, 1.0),
        "potential_fr_accent_issues": (0.0, 0.1),
    },
    "s2": {
        "len_ratio": (0.75, 1.92),
        "verb_ratio": (0.50, 3.00),
        "noun_ratio": (0.67, 4.00),
        "entity_ratio": (0.17, 2.00),
        "clause_ratio": (0.50, 3.00),
        "one_char_words_fr": (0.0, 3.0),
        "one_char_words_en": (0.0, 3.0),
        "potential_fr_accent_issues": (0.0, 0.1),
    },
    "s3": {
        "len_ratio": (0.34, 3.93),
        "verb_ratio": (0.25, 5.00),
        "noun_ratio": (0.38, 12.00),
        "entity_ratio": (0.10, 4.00),
        "clause_ratio": (0.20, 6.00),
        "one_char_words_fr": (0.0, 11.0),
        "one_char_words_en": (0.0, 11.0),
        "potential_fr_accent_issues": (0.0, 0.1),
    },
}

# --- fixed values: the eleven columns whose OR excludes a pair (the accent entry is the raw count) --
EXCLUSION_COLUMNS = [
    "exclude_low_similarity",
    "exclude_len_ratio",
    "exclude_verb_ratio",
    "exclude_noun_ratio",
    "exclude_entity_ratio",
    "exclude_clause_ratio",
    "exclude_one_char_words_fr",
    "exclude_one_char_words_en",
    "exclude_figtext",
    "has_date_refs",
    "potential_fr_accent_issues",
]
RELAXED_FEATURES = [
    "len_ratio",
    "verb_ratio",
    "noun_ratio",
    "entity_ratio",
    "clause_ratio",
    "one_char_words_fr",
    "one_char_words_en",
]

# --- fixed values: text patterns (Python semantics; flags for Java are added where used) ---------
TRAILING_NUMBER_PATTERN = r"\s+\d+\s*$"
PARENTHETICAL_NUMBER_PATTERN = r"\s+\(\d+\)\s*$"
FIGURE_REFERENCE_PATTERN = {
    "en": r"\s*(?:Figure|Table|Fig\.?|Tab\.?)\s+\d+.*$",
    "fr": r"\s*(?:Figure|Tableau|Fig\.?|Tab\.?)\s+\d+.*$",
}
REPEATED_PUNCTUATION_PATTERN = r"[.!?]{2,}$"
DATE_PATTERN = (
    r"\b(?:19|20)\d{2}\b|(?:January|February|March|April|May|June|July|August|September|October"
    r"|November|December|janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre"
    r"|novembre|décembre|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\b"
)

# --- fixed values: clean-up substitutions, applied in this order ----------------------------------
CLEANUP_STEPS = [
    (r"^\s*(\d{1,3}[A-Za-z]?[\.\):]?)\s+", ""),
    (r"(?i)\(?\b(Figure|Table|Fig(?:ure)?|Tableau)\b\s*\d+[A-Za-z0-9\-\.]*\)?", ""),
    (r"\b(DFO|MPO)\s+\d{4}[a-z]?", ""),
    (r"[’‘`´]", "'"),
    (r"[–—−]", "-"),
    (r"\s+", " "),
]

# --- fixed values: prompt and instruction texts ----------------------------------------------------
PROMPT_FR_TO_EN = "translate French to English: {fr} <sep> {en}"
PROMPT_EN_TO_FR = "translate English to French: {en} <sep> {fr}"
INSTRUCTION_EN = "Translate the following English text to French. Output only the French translation, nothing else."
INSTRUCTION_FR = "Traduisez le texte français suivant en anglais. Ne donnez que la traduction anglaise, rien d'autre."
PROMPT_TEMPLATE_EN = "[INST] {instruction}\n\nEnglish: {text}\n\nFrench: [/INST]"
PROMPT_TEMPLATE_FR = "[INST] {instruction}\n\nFrançais: {text}\n\nAnglais: [/INST]"
RESPONSE_MARKER = "[/INST]"

# --- fixed values: tag constraints -----------------------------------------------------------------
TAG_PATTERN = r"</?KE\d+>"
TAG_OPEN_PREFIX = "<KE"
TAG_CLOSE_PREFIX = "</KE"
TAG_SUFFIX = ">"
TAG_POOL_SIZE = 1024
MAX_FORCED_TAGS = 128

# --- fixed values: statistics ---------------------------------------------------------------------
SIGMA_PERCENTILES = [0.5, 0.00135, 0.02275, 0.1587, 0.8413, 0.97725, 0.99865]
SIGMA_PERCENTILE_NAMES = ["p50", "p0_1", "p2_3", "p15_9", "p84_1", "p97_7", "p99_9"]
TRANSLATOR_PERCENTILES = [0.01, 0.1, 0.5, 0.9, 0.99]
TRANSLATOR_PERCENTILE_NAMES = ["p1", "p10", "p50", "p90", "p99"]
DESCRIBE_COLUMN_PERCENTILES = [0.5, 0.9, 0.99, 0.999]
DESCRIBE_COLUMN_PERCENTILE_NAMES = ["p50", "p90", "p99", "p99_9"]
DESCRIBE_DEFAULT_PERCENTILES = [0.25, 0.5, 0.75]
DESCRIBE_DEFAULT_PERCENTILE_NAMES = ["p25", "p50", "p75"]
HISTOGRAM_BINS = 30
KEEP_ABOVE_SIMILARITY = 0.8

# --- fixed values: survey weights ------------------------------------------------------------------
SURVEY_WEIGHTS = {"bad": -2, "good": 1, "best": 2, "worse": -1, "better": 1}

# --- fixed values: accent vocabulary cut-off -------------------------------------------------------
ACCENT_MAP_SIZE = 1000

# --- fixed values: training preparation ------------------------------------------------------------
SPLIT_SEED = 42
VAL_RATIO = 0.05
MAX_SOURCE_LEN = 512
MAX_TARGET_LEN = 512
LABEL_PAD_ID = -100
SWEEP_TRAIN_SAMPLES = 200000
SWEEP_EVAL_SAMPLES = 10000
SWEEP_ALPHA_FACTOR = 2.0

# --- fixed values: model registry (model, id, language map, source restriction, batch, accumulation,
#     and the sweep grids) ---------------------------------------------------------------------------
MODEL_REGISTRY = [
    {
        "model": "m2m100_418m",
        "model_id": "facebook/m2m100_418M",
        "language_map": {"en": "en", "fr": "fr"},
        "restrict_source_language": None,
        "batch_size": 12,
        "grad_accum": 2,
        "lr_grid": [7e-5, 1e-4, 2e-4],
        "r_grid": [8, 16, 32],
        "dropout_grid": [0.05],
    },
    {
        "model": "mbart50_mmt_fr",
        "model_id": "facebook/mbart-large-50-many-to-many-mmt",
        "language_map": {"en": "en_XX", "fr": "fr_XX"},
        "restrict_source_language": "en",
        "batch_size": 8,
        "grad_accum": 2,
        "lr_grid": [7e-5, 1e-4, 1.5e-4],
        "r_grid": [16, 32],
        "dropout_grid": [0.05],
    },
    {
        "model": "mbart50_mmt_en",
        "model_id": "facebook/mbart-large-50-many-to-many-mmt",
        "language_map": {"en": "en_XX", "fr": "fr_XX"},
        "restrict_source_language": "fr",
        "batch_size": 8,
        "grad_accum": 2,
        "lr_grid": [7e-5, 1e-4, 1.5e-4],
        "r_grid": [16, 32],
        "dropout_grid": [0.05],
    },
    {
        "model": "opus_mt_en_fr",
        "model_id": "Helsinki-NLP/opus-mt-tc-big-en-fr",
        "language_map": {"en": "en", "fr": "fr"},
        "restrict_source_language": "en",
        "batch_size": 16,
        "grad_accum": 2,
        "lr_grid": [1e-4, 2e-4, 3e-4],
        "r_grid": [8, 16, 32],
        "dropout_grid": [0.05],
    },
    {
        "model": "opus_mt_fr_en",
        "model_id": "Helsinki-NLP/opus-mt-tc-big-fr-en",
        "language_map": {"en": "en", "fr": "fr"},
        "restrict_source_language": "fr",
        "batch_size": 16,
        "grad_accum": 2,
        "lr_grid": [1e-4, 2e-4, 3e-4],
        "r_grid": [8, 16, 32],
        "dropout_grid": [0.05],
    },
]

# --- fixed values: translators compared in the evaluation (name, family, base id, merged paths) ----
TRANSLATORS = [
    {"translator_name": "nllb_3b_base_researchonly", "family": "nllb", "base_model_id": "facebook/nllb-200-3.3B",
     "merged_model_path": None, "merged_model_path_en_fr": None, "merged_model_path_fr_en": None},
    {"translator_name": "opus_mt_base", "family": "opus", "base_model_id": "Helsinki-NLP/opus-mt-tc-big-en-fr",
     "merged_model_path": None, "merged_model_path_en_fr": None, "merged_model_path_fr_en": None},
    {"translator_name": "opus_mt_finetuned", "family": "opus", "base_model_id": "Helsinki-NLP/opus-mt-tc-big-en-fr",
     "merged_model_path": None, "merged_model_path_en_fr": "merged/opus_mt_en_fr",
     "merged_model_path_fr_en": "merged/opus_mt_fr_en"},
    {"translator_name": "m2m100_418m_base", "family": "m2m100", "base_model_id": "facebook/m2m100_418M",
     "merged_model_path": None, "merged_model_path_en_fr": None, "merged_model_path_fr_en": None},
    {"translator_name": "m2m100_418m_finetuned", "family": "m2m100", "base_model_id": "facebook/m2m100_418M",
     "merged_model_path": "merged/m2m100_418m", "merged_model_path_en_fr": None, "merged_model_path_fr_en": None},
    {"translator_name": "mbart50_mmt_base", "family": "mbart50",
     "base_model_id": "facebook/mbart-large-50-many-to-many-mmt",
     "merged_model_path": None, "merged_model_path_en_fr": None, "merged_model_path_fr_en": None},
    {"translator_name": "mbart50_mmt_finetuned", "family": "mbart50",
     "base_model_id": "facebook/mbart-large-50-many-to-many-mmt",
     "merged_model_path": None, "merged_model_path_en_fr": "merged/mbart50_mmt_fr",
     "merged_model_path_fr_en": "merged/mbart50_mmt_en"},
]

# --- fixed value: the comparison report's layout (sample, samples, language, source, expected, base, fine-tuned) ----
COMPARISON_REPORT = (
    "\n[%d/%d] %s\ttext in\n\t%s\ntext out (expected)\n\t%s\ntext out (predicted with base model)\n\t%s\n"
    "text out (predicted with finetuned model)\n\t%s\n")
