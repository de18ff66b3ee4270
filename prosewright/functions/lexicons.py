"""Word lists, patterns and thresholds.

Fixed values: results depend on each entry, so they are stated as they are.
"""

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = [
    "e.g", "i.e", "et al", "etc", "cf", "vs", "viz", "fig", "eq", "tab", "no", "dr", "mr", "mrs", "ms", "st", "prof",
    "approx", "ca", "sec", "ref", "al", "pp", "vol", "ed", "eds",
]

# Connectives.
CONNECTIVES = [
    "however", "moreover", "furthermore", "therefore", "thus", "hence",
    "consequently", "additionally", "nevertheless", "nonetheless", "meanwhile",
    "similarly", "conversely", "indeed", "notably", "accordingly",
    "subsequently", "overall", "finally", "firstly", "secondly", "thirdly",
    "besides", "instead", "likewise", "importantly", "specifically", "namely",
    "in addition", "on the other hand", "as a result", "for example",
    "for instance", "in contrast", "in particular",
]

# Hedges.
HEDGES = [
    "may", "might", "could", "would", "suggest", "suggests", "suggested",
    "appear", "appears", "appeared", "seem", "seems", "seemed", "tend",
    "tends", "tended", "likely", "possibly", "perhaps", "potentially",
    "presumably", "arguably", "apparently", "relatively", "somewhat",
    "generally", "probably",
]

# Additive connectives that count as a tell.
MOREOVER_FAMILY = ["moreover", "furthermore", "additionally", "in addition", "besides"]

# Inflated diction.
DICTION = [
    "delve", "delves", "delving", "leverage", "leverages", "leveraging",
    "utilize", "utilizes", "utilise", "harness", "harnesses", "streamline",
    "underscore", "underscores", "underscoring", "showcase", "showcases",
    "showcasing", "foster", "fosters", "navigate", "navigating", "facilitate",
    "boast", "boasts", "align", "aligns", "surpass", "surpassing", "seamless",
    "seamlessly", "robust", "intricate", "pivotal", "crucial", "comprehensive",
    "meticulous", "meticulously", "nuanced", "holistic", "innovative",
    "groundbreaking", "transformative", "remarkable", "myriad", "plethora",
    "realm", "landscape", "tapestry", "synergy", "testament", "underpinnings",
    "moreover", "furthermore", "additionally", "notably", "indeed",
]

# Hollow phrases, counted as plain substrings.
HOLLOW = [
    "it is important to note", "it is worth noting", "it is worth mentioning",
    "it should be noted", "plays a vital role", "plays a key role",
    "plays a crucial role", "a wide range of", "rich tapestry",
    "in today's world", "in today's fast-paced world", "in today's digital age",
    "in the realm of", "stands as a testament", "cannot be overstated",
    "paving the way", "navigate the complexities", "when it comes to",
    "at the end of the day",
]

# Forms of "to be" and irregular participles of the passive.
BE_FORMS = ["am", "is", "are", "was", "were", "be", "been", "being"]
PARTICIPLES = [
    "done", "made", "shown", "seen", "found", "given", "taken", "held", "known",
    "built", "brought", "kept", "left", "told", "sent", "put", "set", "run",
    "begun", "drawn", "grown", "written", "chosen", "driven", "proven", "born",
    "worn", "torn", "led", "read", "understood",
]

# Endings of nominalisations (words of more than five letters), in a text and in a changelog.
NOMINAL_ENDINGS = ["tion", "sion", "ment", "ness", "ity", "ance", "ence", "ancy", "ency", "ism", "ology"]
CHANGE_NOMINAL_ENDINGS = ["tion", "sion", "ment", "ness", "ity", "ance", "ence", "ism"]

# Subordinators.
SUBORDINATORS = [
    "because", "although", "though", "while", "whereas", "since", "if",
    "unless", "until", "when", "whenever", "where", "that", "which", "who",
    "whom", "whose",
]

# Connectives that a changelog looks for at a sentence's start.
CHANGE_CONNECTIVES = [
    "moreover", "furthermore", "however", "therefore", "thus", "additionally",
    "consequently", "hence", "nevertheless", "nonetheless", "indeed", "notably",
    "accordingly", "meanwhile", "similarly", "conversely", "besides", "importantly",
]

# Section of a heading by the first group that has one of its keywords.
SECTIONS = [
    ("abstract", ["abstract"]),
    ("introduction", ["introduction"]),
    ("related_work", ["related work", "background", "prior work", "literature"]),
    ("methods", ["method", "methods", "methodology", "materials and methods", "experimental setup", "approach", "materials"]),
    ("results", ["result", "results", "findings", "evaluation", "experiments"]),
    ("discussion", ["discussion"]),
    ("conclusion", ["conclusion", "concluding", "conclusions"]),
    ("references", ["references", "bibliography", "works cited"]),
    ("acknowledgements", ["acknowledgement", "acknowledgment", "acknowledgements", "acknowledgments"]),
]

# Words that stay lower-case in a title.
TITLE_SMALL = ["a", "an", "the", "and", "or", "of", "in", "on", "for", "to", "with", "at", "by", "from", "as", "into", "per", "via"]

# Relation cues and the strength of a claim they make, 1 to 5.
CUES = [
    (5, ["demonstrate", "demonstrates", "demonstrated", "prove", "proves", "proven", "guarantee", "guarantees", "guaranteed"]),
    (4, ["confirm", "confirms", "confirmed", "establish", "establishe", "establishes", "establishs", "established", "reveal", "reveals", "revealed"]),
    (3, [
        "is associated with", "associated with", "is linked to", "linked to", "correlate with", "correlates with", "correlated with",
        "lead to", "leads to", "led to", "result in", "results in", "resulted in", "show", "shows", "showed", "shown",
        "indicate", "indicates", "indicated", "report", "reports", "reported", "find", "finds", "found",
        "cause", "causes", "caused", "predict", "predicts", "predicted",
    ]),
    (2, [
        "suggest", "suggests", "suggested", "appear", "appears", "appeared", "seem", "seems", "seemed",
        "tend", "tends", "tended", "implies", "imply", "implied",
    ]),
    (4, ["is", "are", "was", "were"]),
]
DOWNTONERS = ["may", "might", "could", "possibly", "perhaps", "potentially", "conceivably", "arguably", "presumably", "tentatively"]
BOOSTERS = [
    "clearly", "conclusively", "definitively", "unambiguously", "strongly", "robustly", "consistently", "always", "invariably",
    "certainly", "undoubtedly",
]

# Spans that no rewrite may change, in the order in which they are masked.
SPANS = [
    ("latex_env", r"(?s)\\begin\{[^}]*\}.*?\\end\{[^}]*\}"),
    ("math_display", r"(?s)\$\$.+?\$\$|\\\[.+?\\\]"),
    ("math_inline", r"(?s)\$[^$\n]+?\$|\\\(.+?\\\)"),
    ("url", r"https?://[^\s)\]]+"),
    ("doi", r"\bdoi:\s*10\.\d{4,9}/[^\s)\]]+|\b10\.\d{4,9}/[^\s)\]]+"),
    ("ref", r"\b(?:Table|Tab\.|Figure|Fig\.|Eq\.|Equation|Section|Sec\.|Appendix)\s*\d+(?:\.\d+)*[a-z]?\b"),
    ("cite_num", r"\[\s*\d+(?:\s*[-–,]\s*\d+)*\s*\]"),
    ("cite_authoryear", r"\([^()]*?\b(?:19|20)\d{2}[a-z]?(?:\s*[;,]\s*[^()]*?\b(?:19|20)\d{2}[a-z]?)*\s*\)"),
    ("p_value", r"(?i)\bp\s*[<>=≤≥]\s*\.?\d+(?:\.\d+)?"),
    ("alnum_token", r"\b[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*\b"),
    ("quantity_unit", r"\b\d+(?:\.\d+)?\s?(?:%|°[CF]|[npµum]?g|[kmM]?g|[mM]?L|mL|kg|[npµm]?s|ms|Hz|[kMG]Hz|[kMG]?B|mm|cm|km|nm)(?![A-Za-z0-9])"),
    ("number", r"\b\d[\d,]*(?:\.\d+)?(?:[eE][-+]?\d+)?\b"),
]

# Thresholds.
RELIABLE_WORDS = 80
ALIGN_CLAIMS = 0.3
ALIGN_SENTENCES = 0.3
SAME_REMAINDER = 0.8
TRIMMED = 0.75
TIGHT_SECTIONS = ["methods", "results"]

# Fixed wording of composed prompts.
EXAMPLE_HEAD = "\n\nExample of the transformation in this field:\n\n"
JUDGE_ORIGINAL = "ORIGINAL:\n"
JUDGE_REWRITES = "\n\nREWRITES:\n"
EXEMPLAR_HEAD = "\n\nA paragraph of the author's own writing, for feel:\n"
NO_HEADINGS = "no headings found: section awareness disabled"
