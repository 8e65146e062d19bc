"""Values that results depend on: word lists, patterns, weights and limits."""

# Terms that carry no content.
STOPWORDS = [
    "a", "about", "an", "and", "are", "can", "do", "does", "for", "from", "how", "i", "in", "is", "it", "my", "of",
    "on", "the", "tell", "to", "what", "when", "where", "which", "with",
]

# Patterns over questions, evidence and answers.
TOKEN = r"[\p{L}\p{N}_-]{2,}"
SECTION_REFERENCE = r"⇒\s*([^\u2009,;:.\n]{3,80})"
FIGURE_REFERENCE = r"(?i)(?:⇒\s*)?Fig\.\s*(\d+)"
FIGURE_MENTION = r"\bFig\.\s*(\d+)\b"
INJECTION = (
    r"(?i)\b(?:ignore (?:all |the |any )?(?:previous|prior|system)|(?:system|developer) prompt"
    r"|reveal (?:your |the )?(?:instructions|prompt|rules)|act as|jailbreak)\b"
)
CITATION = r"(?i)\[p\.\s*(\d+)]"
NUMBER = r"(?<![A-Za-z])\d+(?:[.,]\d+)?"
COLOUR = r"(?i)\b(red|yellow|orange|green|white|blue)\b"
ASKS_PROCEDURE = r"\A.*\b(how|check|checking|inspect|inspection|verify|test)\b.*\z"
IS_PROCEDURE = r"\A.*\b(check|checking|inspection|inspecting|procedure|testing)\b.*\z"
ASKS_LIT = r"\b(on|lit|illuminated)\b"
IS_LIT = r"\b(comes on|lights up|lit|illuminated)\b"
FLASHES = r"\b(flash(?:es|ing)?|blink(?:s|ing)?)\b"
URGENT = r"\b(always|never|immediately|warning|do not|check|stop|drive|reduce|inflate)\b"
ACTION = r"\b(use|inspect|measure|verify|look for)\b"
REFUSAL = r"\A.*\b(sorry|unable|cannot|can't|couldn't|do not know|don't know|no information)\b.*\z"
LEAKAGE = ["example facts:", "example answer:", "question:", "manual facts:"]
COMPLETE_SUMMARY = r"(?s)\A.*[.!?](?:\s*\[p\. \d+])*\n?\z"
SENTENCE_END = r"(?<=[.!?])\s+"
PAGE_MARKER = r"^<!-- atlas-page: (\d+) -->$"
HEADING = r"^(#{1,6})\s+(.+?)\s*$"

# Texts.
ABSTENTION = "I couldn't find that information in the manual."
PROMPT = (
    "<|im_start|>user\nQuestion: %s\nOwner's-manual excerpts:\n%s\nCover every required point above. "
    "Answer using only these excerpts.<|im_end|>\n<|im_start|>assistant\n"
)
SUMMARY_PREFIX = "Required manual guidance: "
DEFAULT_SECTION = "Owner's manual"
FIGURES_HEADING = "manual figures"
INTRODUCTION_HEADING = "introduction to the subject"
CALLOUTS = ["warning", "note", "caution", "danger"]
QUALIFIER_PREFIX = "applicable only"
NO_TEXT = "_No extractable text on this page._"
FIGURES_QUALIFIER = "Figures and diagrams"

# Limits and weights.
TOP_K, VECTOR_CANDIDATES, FTS_CANDIDATES, PER_PAGE = 6, 36, 36, 2
MAX_HYBRID_DISTANCE, MAX_SEMANTIC_DISTANCE, MIN_HYBRID_SCORE, SEMANTIC_RANK = 0.62, 0.48, 0.0165, 3
FEEDBACK_RANK, FEEDBACK_DISTANCE = 16, 0.70
ORIGINAL_TERMS, EXPANDED_TERMS, FOCUS_TERMS = 14, 28, 12
VECTOR_WEIGHT, LEXICAL_WEIGHT, RANK_OFFSET = 0.58, 0.42, 60
BOTH_BONUS, COVERAGE_BONUS, BIGRAM_BONUS = 0.0012, 0.0032, 0.001
SECTION_WEIGHT, TEXT_WEIGHT, BM25_K1, BM25_B, MIN_IDF = 3.5, 1.0, 1.2, 0.75, 1e-6
RADIUS, REFERENCES, IMAGES, CONTEXT_CHARS = 2, 4, 8, 900
COMPLEMENT_RADIUS, COMPLEMENT_REFERENCES, REFERENCE_DECAY = 1, 2, 0.8
CHUNK_TOKENS, MAX_TOKENS, PRIMARY_SENTENCES, ALL_SENTENCES, SENTENCE_CHARS = 224, 256, 2, 5, 20
SUMMARY_WORDS, ANSWER_WORDS = (8, 120), 220

# Word lists of the transcript normaliser.
QUESTION_CUES = [
    "what", "which", "where", "when", "why", "how", "show", "tell", "find", "explain", "does", "do", "is", "are", "can", "manual",
]
YEAR_CONTEXT = [
    "what", "which", "tell", "model", "made", "manufactured", "atlas", "manual", "vehicle", "car", "cora", "year", "ear",
]
CAR_CONTEXT = [
    "year", "ear", "model", "vehicle", "atlas", "manual", "engine", "oil", "tire", "warning", "light", "car", "cora", "wire",
]
DOMAIN_WORDS = [
    "atlas", "volkswagen", "vehicle", "car", "engine", "oil", "warning", "indicator", "light", "lights", "jumper", "cable",
    "cables", "diagram", "battery", "tire", "tires", "pressure", "brake", "brakes", "parking", "coolant", "temperature",
    "windshield", "washer", "wiper", "wipers", "fuse", "box", "spare", "wheel", "seat", "belt", "airbag", "headlight",
    "headlights", "fuel", "cap", "towing", "capacity", "year", "model", "transmission", "steering", "dashboard", "symbol",
    "door", "hood", "trunk", "ignition", "service", "maintenance", "wire", "wires",
]
FUZZY_TERMS = [
    "atlas", "volkswagen", "vehicle", "engine", "warning", "indicator", "light", "lights", "jumper", "cable", "cables",
    "diagram", "battery", "tire", "tires", "pressure", "brake", "brakes", "parking", "coolant", "temperature", "windshield",
    "washer", "wiper", "wipers", "fuse", "spare", "wheel", "seat", "airbag", "headlight", "headlights", "fuel", "towing",
    "capacity", "model", "transmission", "steering", "dashboard", "symbol", "ignition", "service", "maintenance", "wire", "wires",
]
NEVER_FUZZY = [
    "about", "after", "again", "also", "been", "before", "could", "does", "from", "have", "here", "into", "just", "like",
    "made", "mean", "means", "more", "need", "only", "other", "should", "some", "than", "that", "their", "there", "these",
    "they", "this", "those", "under", "what", "when", "where", "which", "while", "with", "would", "your",
]
PHONETIC_FIXES = {"ear": "year", "eer": "year", "cora": "car", "carr": "car"}
JOINED_FIXES = {r"\bvolks\s+wagon\b": "volkswagen", r"\bcheck\s+in\s+gin\b": "check engine"}
