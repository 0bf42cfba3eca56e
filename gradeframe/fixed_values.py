"""Changing any of them changes the results.

They define the answer letters, the relevance labels, the markers read as
missing, the patterns looked for in model text, the default prompt and the
wording of the text report.
"""

# --- fixed values -----------------------------------------------------------

ANSWER_LETTERS = ("A", "B", "C", "D", "E", "F", "G", "H", "I", "J")

# In output order.
RELEVANCE_LABELS = ("High Relevance", "Low Relevance", "Irrelevant")

# Default missing-value markers of pandas.read_csv.
MISSING_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Characters for which Python's str.isspace() is true.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Java patterns. (?U) makes \b, \d and \s follow Unicode; \x1c-\x1f are white
# space in Python but not in Java. A look at the first character comes before
# the word boundary, which is dear to test at every place.
SENTENCE_MARK = r"(?U)(?=[S\d])\b(?:S\d+[\s\x1c-\x1f]*:|\d+\.)"
ANSWER_MARK = r"(?iU)(?=a)\bAnswer:[\s\x1c-\x1f]*([A-J])\b"
LABEL_MARK = r"(?iU)\[(High Relevance|Low Relevance|Irrelevant)\]"

# z value of the 95 % interval.
Z_95 = 1.96

# Text that stands for a missing cell in a prompt.
MISSING_TEXT = "nan"

DEFAULT_PROMPT = """\
You are given a list of sentences and a multiple-choice question.

Your task is twofold:
(1) Select the most appropriate answer from the given options.
(2) Label each sentence as [High Relevance], [Low Relevance], or [Irrelevant]
    based on its contribution to answering the question.

Definitions:
- [High Relevance]: Directly supports the correct answer with essential information.
- [Low Relevance]: Provides useful context but is not critical to answering.
- [Irrelevant]: Unrelated to the question or not useful for reasoning.

Question and Options:
{options}

Sentences:
{sentences}

Return ONLY a JSON object in this exact format:
{{
  "Answer": "<letter>",
  "Sentence_Relevance": ["High Relevance", "Low Relevance", ...]
}}"""

# Column names of the results table.
RAW_RESPONSE = "Raw_Response"
SINGLE_ANSWER = "LLM_answer"
LABELS = "labels"
ERROR = "error"
WIDE_LABEL = "label_{}"

# JSON keys of a response.
JSON_ANSWER = "Answer"
JSON_LABELS = "Sentence_Relevance"

# Lines of the text report.
REPORT_TITLE = "=== Analysis Report ==="
REPORT_INPUT = "Input:  {}"
REPORT_MODEL = "Model:  {}"
REPORT_QUESTION = "--- {} ---"
REPORT_NO_COLUMN = "  Column '{}' not found in data. Skipping."
REPORT_NO_GOLD = "  (No correct-answer column configured — skipping accuracy.)"
REPORT_REFUSAL = "  Refusal Rate (answer not a valid letter):"
REPORT_ACCURACY = "  Accuracy:"
REPORT_LABEL_ACCURACY = "  Accuracy by majority sentence-relevance label:"
REPORT_LABELS = "--- Sentence Relevance Distribution ---"
REPORT_DISTRIBUTION = "  Relevance Distribution (% per row, mean ± 95% CI):"
REPORT_OVERALL = "Overall"
REPORT_INDENT = "    "
REPORT_NOTHING = "N/A"
REPORT_NO_DATA = "N/A (no data)"
