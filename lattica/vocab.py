"""Controlled vocabularies. They decide results, so they are stated in full and in one place."""

#: Relation names of the core experiment ontology.
RELATIONS = [
    "cites", "publishedIn", "writtenBy", "reports", "affiliatedWith", "employs", "locatedIn", "addresses", "motivates", "achieves", "encompasses",
    "comprises", "uses", "produces", "trainedOn", "evaluatedOn", "splitFrom", "designedFor", "comparesAgainst", "configures", "evaluates", "supports",
]

#: Entity types: scientific-IE types, free types and BIOES types to ontology types (None drops the entity).
SCIERC_TYPES = {"Method": "Method", "Task": "Task", "Metric": "EvaluationMetric", "Material": "Resource", "OtherScientificTerm": "Other", "Generic": None}
FREE_TYPES = {"Model": "Model", "Method": "Method", "Dataset": "Dataset", "Task": "Task", "Tool": "Tool", "Resource": "Resource", "Metric": "EvaluationMetric", "Language": "Language"}
BIOES_TYPES = {"solution": "Model", "method": "Method", "dataset": "Dataset", "research_problem": "Task", "tool": "Tool", "resource": "Resource", "language": "Language"}
HARD_TYPES = ["Model", "Method", "Dataset", "Tool", "EvaluationMetric", "Metric", "Task", "Resource", "Language"]

#: Single words that a gazetteer never matches.
FUNCTION_WORDS = [
    "a", "an", "and", "or", "but", "the", "of", "for", "to", "in", "on", "at", "by", "as", "is", "are", "was", "were", "be", "been", "being", "am", "this",
    "that", "these", "those", "it", "its", "we", "our", "ours", "their", "they", "them", "you", "your", "he", "she", "his", "her", "i", "can", "could", "may",
    "might", "will", "would", "shall", "should", "must", "do", "does", "did", "done", "has", "have", "had", "use", "used", "uses", "using", "find", "found",
    "make", "made", "get", "got", "show", "shown", "give", "given", "take", "see", "form", "set", "let", "new", "old", "present", "propose", "proposed",
    "simple", "such", "same", "more", "most", "less", "least", "many", "much", "very", "also", "however", "thus", "hence", "then", "than", "while", "which",
    "who", "what", "when", "where", "how", "why", "both", "each", "all", "any", "some", "no", "not", "only", "other", "others", "between", "within",
    "without", "via", "per", "with", "from", "into", "over", "under", "about", "above", "below", "if", "so", "because", "since", "though", "although",
    "whether", "either", "neither",
]
NOISE_NAMES = [
    "the", "this", "that", "these", "those", "it", "we", "our", "their", "they", "a", "an", "model", "method", "approach", "task", "system", "data", "result",
    "results", "paper", "work", "table", "figure",
]
GENERIC_LEADING = [
    "the", "a", "an", "this", "that", "these", "those", "our", "their", "its", "new", "present", "proposed", "current", "existing", "various", "several",
    "many", "most", "some", "each", "any", "other", "such", "same", "given", "concept", "idea", "notion", "kind", "number", "amount",
]

#: Words that are no concepts.
CONCEPT_STOPWORDS = [
    "these", "those", "therefore", "however", "because", "their", "about", "which", "with", "that", "this", "based", "using", "study", "paper", "method",
    "model", "models", "results", "show", "proposed", "approach", "propose", "achieve", "both", "between", "performance", "training", "learning", "neural",
    "network", "networks", "language", "tasks", "task",
]

VAGUE_ENTITIES = [
    "this paper", "the authors", "the paper", "our work", "our approach", "other schemes", "various variants", "the above", "the following",
    "additional analysis", "experimental setup", "the proposed", "recent work", "prior work", "baseline", "the model", "the method", "the algorithm",
    "the framework", "the system", "the approach", "the technique",
]
SKIPPED_SECTIONS = ["references", "bibliography", "acknowledgements", "acknowledgments", "appendix"]
GARBLED_SECTION = r"(?i)E\[CLS\]|E\[SEP\]|\bE1\s+E2\b|\bE_\d+\b|\[unused\d+\]|^figure\s+\d+$|^fig\.\s*\d+$|^table\s+\d+$|^references?$|^bibliography$|^acknowledgem|^appendix\s+[a-z]?$"
BROAD_DOMAINS = [
    "natural language processing", "nlp", "machine learning", "ml", "deep learning", "artificial intelligence", "ai", "computer vision", "transfer learning",
    "pre-training", "representation learning", "supervised learning", "semi-supervised learning", "unsupervised learning",
]
DESIGN_PHRASES = [
    "designed for", "designed to", "built for", "built to", "intended for", "intended to", "purpose of", "specifically for", "created for", "developed for",
    "meant for", "goal is to", "aims to", "allows bert to model",
]
DEFINING_PHRASES = [" is a ", " is an ", " are a ", " are an "]  # the longer ones of the rule all contain one of these
OBJECT_REQUIRED = ["comprises", "uses", "trainedon", "evaluatedon", "comparesagainst", "splitfrom", "writtenby", "publishedin"]
IS_A = r"\bis\s+an?\b|\bare\s+an?\b|\bare\s+(?:fine-tuning|feature-based|pre-training|classification|regression)|\bis\s+(?:one\s+of|an\s+example\s+of|a\s+type\s+of|a\s+form\s+of)|\bare\s+(?:both\s+)?examples?\s+of"
OBJECT_STOPWORDS = ["a", "an", "the", "of", "in", "on", "for", "to", "and", "or", "is", "are", "was"]
REFERENCE_HEADERS = ["acknowledgement", "acknowledgment", "references", "appendix", "thank", "we are grateful"]

#: Surface forms that papers add to an abbreviation.
VENDORS = ["openai", "google", "meta", "microsoft", "deepmind", "huggingface", "stanford", "berkeley"]
SIZES = ["base", "large", "small", "tiny", "medium", "xl", "xxl"]
SEPARATORS = ["_", "-", " "]
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}

#: A short list of frequent English words, for the offline share-of-known-words test.
ENGLISH_STOPWORDS = [
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being",
    "below", "between", "both", "but", "by", "can", "did", "do", "does", "doing", "down", "during", "each", "few", "for", "from", "further", "had", "has",
    "have", "having", "he", "her", "here", "hers", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "itself", "just", "me", "more", "most",
    "my", "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "our", "ours", "out", "over", "own", "same", "she", "should", "so",
    "some", "such", "than", "that", "the", "their", "theirs", "them", "then", "there", "these", "they", "this", "those", "through", "to", "too", "under",
    "until", "up", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "whom", "why", "will", "with", "you", "your", "yours",
]
