"""Patterns and word lists of the document domain; every function that uses one takes it as a parameter.

Fixed values: results depend on these patterns, lists and their order (first match wins). Groups that repeat are possessive, since
Java's matcher needs a stack frame for each repetition otherwise.
"""

REQUIREMENT_TYPES = (
    ("submission", r"\b(shall submit|must submit|proposal shall|offeror(?:'s)? proposal shall|shall include|required to submit)\b"),
    ("instruction", r"\b(shall|must|required|are expected to|is responsible for|will provide)\b"),
    ("evaluation", r"\b(will evaluate|evaluation factor|evaluation criteria|best value|rated as|pass/fail)\b"),
    ("security", r"\b(clearance|classified|security|SCI|SAP|personnel security)\b"),
    ("deliverable", r"\b(deliverable|CDRL|milestone|schedule|roadmap)\b"),
)
TRIGGER_KEYWORDS = (
    ("shall", r"\bshall\b"),
    ("must", r"\bmust\b"),
    ("required", r"\b(required|required to|is required to)\b"),
    ("submit", r"\b(submit|submission|submitted)\b"),
    ("provide", r"\b(provide|provided|providing)\b"),
    ("deliver", r"\b(deliver|delivery|deliverable)\b"),
    ("maintain", r"\bmaintain\b"),
    ("comply", r"\b(comply|compliance)\b"),
    ("will", r"\bwill\b"),
)
SUBMISSION_CATEGORIES = (
    ("due_date", r"\b(due|deadline|no later than|submit(?:ted)? by|proposal submission schedule)\b"),
    ("format", r"\b(format|electronic|volume|page limit|font|microsoft office|pdf|excel)\b"),
    ("attachment", r"\b(attach(?:ment)?|annex|appendix|template|form|resume|questionnaire|pricing)\b"),
    ("content", r"\b(shall submit|must submit|proposal shall|offeror(?:'s)? proposal shall|shall include|required to submit|provide a draft|submit a)\b"),
    ("security", r"\b(unclassified|classified|clearance|scif|sci)\b"),
)
MODALITIES = (
    ("shall", r"\bshall\b"),
    ("must", r"\bmust\b"),
    ("required", r"\b(required to|is required to|are required to|required)\b"),
    ("will", r"\bwill\b"),
    ("informational", r"\bmay\b"),
)
ACTORS = (
    ("contractor", r"\b(contractor|offeror)\b"),
    ("government", r"\b(government|agency)\b"),
    ("cor", r"\b(COR)\b"),
    ("pm", r"\b(program manager|PM)\b"),
    ("co", r"\b(contracting officer|CO)\b"),
)
TASKING = r"\b(perform|provide|submit|deliver|maintain|develop|prepare|support|coordinate|update|report|track|inspect|manage)\b"
DELIVERABLE = r"\b(deliverable|cdrl|report|plan|schedule|roadmap|status report|submission|data item)\b"
EXPORT_TRIGGER = r"\b(shall|must|required|requires|is required to)\b"

SEARCH_STOPWORDS = (
    "the", "and", "for", "that", "with", "this", "from", "shall", "must", "will", "are", "not", "all", "any", "into",
    "their", "have", "has", "provide", "provides", "provided", "use", "using", "required", "requirement",
    "requirements", "contractor", "government",
)
LINK_STOPWORDS = (
    "the", "and", "for", "that", "with", "this", "from", "must", "shall", "provide", "support", "section", "sections",
    "appendix", "appendices", "contractor", "requirements", "required", "base", "idiq", "pws", "iaw", "each",
    "listed", "under",
)
TITLE_STOPWORDS = ("the", "and", "for", "with")
POSITIVE_FILENAMES = ("pws", "appendix", "section l", "section m", "cdrl")
NEGATIVE_FILENAMES = ("pricing", "template", "resume", "boe", "oci", "small business")
DOC_PRIORITIES = ((0, r"section\s+l"), (0, r"section\s+m"), (0, r"\bpws\b"), (1, r"hm\d+.*\.pdf"), (2, r"appendix"))
NOISY_FILENAMES = (
    r"pricing template",
    r"\bboe\b",
    r"questionnaire",
    r"resume template",
    r"clearance template",
    r"security clearance template",
    r"small business participation template",
    r"master project template",
    r"oci disclosure form",
    r"\.xlsx$",
)
IGNORED_FILENAMES = ("project.json",)
#: Namespace of name-based UUIDs for URLs (RFC 4122).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"

MARKING = r"(?:U|C|S|TS|FOUO|U//FOUO|U/FOUO|S//NF|TS//SI//NF)"
SIMPLE_MARKING = r"(?:U|C|S|TS|FOUO|U//FOUO|U/FOUO)"
DATE_ONLY = r"^(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\s+\d{1,2},\s+\d{4}$"
TOC_ENTRY = r"^(?i)(appendix\s+[A-Z]|attachment\s+\d+|\d+(?:\.\d+)*+)\s+(.+?)\s+([A-Z]?-?\d+)$"
TOC_TITLE = r"^(?i)(table of contents|contents|figures|appendices)$"
APPENDIX_HEADING = r"^(?i)(APPENDIX|ATTACHMENT|EXHIBIT|CDRL|CLIN)\s+([A-Z0-9.\-]+)\s*[-.:]?\s*(.*)$"
SECTION_HEADING = r"^(?i)(SECTION)\s+([A-Z0-9IVX.\-]+)\s*[-.:]?\s*(.*)$"
DECIMAL_HEADING = r"^(\d+(?:\.\d+)++)\s+(.+)$"
NUMBER_HEADING = r"^(\d+)\s+(.+)$"
WORD_FRAGMENTS = r"(?i)(?:Error!\s*Reference source not found\.?|Error!\s*Bookmark not defined\.?|Error!\s*No table of contents entries found\.?)"
#: Lines of outlines and imported text.
OUTLINE_NUMBERED = r"^(\d+(?:\.\d+)*)\s+(.+?)\s*$"
OUTLINE_LEADER = r"\.{4,}\s*[A-Z]?-?\d+\s*$"
OUTLINE_HASH = r"^(#+)\s+(.+)$"
OUTLINE_BOLD = r"^\*\*(.+?)\*\*$"
OUTLINE_NUMBER = r"^((?:[A-Za-z]+\.)?\d+(?:\.\d+)*|[A-Za-z]+\.\d+(?:\.\d+)*)\s+(.+)$"
OUTLINE_ORDERED = r"^(\d+\.|[A-Za-z]\.|(?:\([A-Za-z0-9]+\))+)\s+(.+)$"
#: A plain line is no outline heading if it reads like a sentence; markings that number no list, and markers that do.
OUTLINE_SENTENCE = r"(?i)^(?:the|this|these|those) |[.!?;:]$|^(?:\S+\s+){18}\S"
OUTLINE_LIST_MARKER = r"(?i)^(?:\d+\.|[a-z]\.|\((?!(?:U|C|S|TS|FOUO)\))(?:i{1,3}|iv|vi{0,3}|ix|x|\d{1,2}|[a-z])\))$"
OUTLINE_INLINE_ITEM = r"(?:^|(?<=\s))(\d+\.|[A-Za-z]\.|(?:\([A-Za-z0-9]+\))+)\s+"
OUTLINE_TABLE_PIPES = 6
OUTLINE_BULLET = r"^(\s*)[-*•·▪]\s+(.+)$"
OUTLINE_IMAGE_FILE = r"(?i)^\s*image\d+\.(?:png|jpe?g|gif|webp)\s*$"
OUTLINE_IMAGE_LINE = r"(?i)^\s*<!--\s*image\s*-->\s*$"
OUTLINE_MARGIN = r"^\s*\d{1,4}\s+(?=\S)"
#: Lines of imported text (without case), and how near and how short titles are.
IMPORT_APPENDIX = r"^appendix\s+([A-Z])\s+\(U\)\s+(.+?)(?:\s+\d+)?$"
IMPORT_CONTENTS = r"^(?:\(U\)\s*)?table of (?:contents|figures|tables)$"
IMPORT_DUTY = r"^the contractor shall:?$"
IMPORT_GENERIC = r"^the following requirements apply\b"
IMPORT_CAPTION = r"^(?:(?:figure|table)\b|table is unclassified)"
IMPORT_NO_TABLE = "table is unclassified"
IMPORT_BULLET = r"^(\s*)[-*•·]\s+(.+)$"
IMPORT_SUB_BULLET = r"^o\s+"
IMPORT_INLINE_BULLET = r"\s+o\s+(?=[A-Z])"
IMPORT_STUCK_PAGE = r"(.*?)(\d{1,3})"
IMPORT_WRAP_END = r"[A-Za-z0-9),]$"
IMPORT_WRAP_START = r"^[A-Z][A-Za-z0-9(]"
IMPORT_START = r"^#+\s+1(?:\.0+|\.1)?\s"
IMPORT_TITLE_REACH, IMPORT_SHORT_TITLE, IMPORT_LOOK_BACK, IMPORT_SEEN = 24, 6, 6, 12
IMPORT_STRONG_LINES, IMPORT_STRONG_HEADINGS, IMPORT_STRONG_ROOTS = 120, 4, 2
BLANK_NUMBER_LINE = r"^\s*\d{1,4}\s*$"
UNCLASSIFIED_LINE = r"^(?i)\s*\(?Unclassified//FOUO\)?\s*$"
FIGURE_LINE = r"^(?i)\s*\(?Figure is UNCLASSIFIED(?://FOUO)?\)?\s*$"
FIGURE_MARK = r"(?i)Figure is UNCLASSIFIED(?://FOUO)?\s*"
REMOVED_MARK = r"(?i)\bRemoved for classification\b"
MARGIN_NUMBER = r"^\s*\d{1,4}(?:\s{2,}|\t+)(?=\S)"
PAGE_LINE = r"^(?i)\s*(page\s+)?[A-Z]?-?\d+\s*$"
#: Lines of paragraphs, and where a heading starts inside one.
MARKDOWN_LINK = r"^\[([^\]]+)\]\(\.\)$"
IMAGE_TAG = r"^(?i)<!--\s*image\s*-->$"
MARKING_ONLY = r"^\(?[A-Z/]{1,12}\)?$"
INLINE_HEADING = r"(?i)(?=(?:^|\s)(?:\(?[A-Z]{0,3}\)?\s*)?(?:APPENDIX|ATTACHMENT|SECTION|\d+(?:\.\d+)++|\d+)\s+[A-Z])"
