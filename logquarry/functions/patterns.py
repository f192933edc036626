"""Every regular expression and word list, in one place.

The bodies are plain text that Java and RE2 both accept.  `java` adds the flags
that give Java the intended meaning: ``U`` for Unicode character classes and
case folding, ``d`` so that ``.`` stops at a line feed only.
"""

# --- Fixed values: log header -------------------------------------------------
# Whitespace includes the unit separator, which the log format counts as blank.
_GAP = r"[\s\x1f]+"
LOG_HEADER = (
    r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})" + _GAP
    + r"\[([A-Z]+)\]" + _GAP
    + r"(\w+)" + _GAP
    + r"\(([^:]+):(\d+)\):" + _GAP
)
# Everything that ends a line in a text log.
LINE_ENDS = ("\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")
LINE_BREAK = r"\r\n|[" + "".join(LINE_ENDS) + "]"
NOT_BLANK = r"[^\s\x1f]"
# The characters that stripping removes from both ends of a text.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- Fixed values: redaction --------------------------------------------------
JWT = r"\beyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*\b"
API_KEY = r"\b(api[_-]?key|bearer|secret|token)[\s=:]+['\"]?([A-Za-z0-9_\-]{16,})['\"]?"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
IPV4 = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
JWT_MARK = "[REDACTED_JWT]"
API_KEY_MARK = "=[REDACTED_API_KEY]"
EMAIL_MARK = "[REDACTED_EMAIL]"
IPV4_MARK = "[REDACTED_IP]"

# --- Fixed values: statement guards -------------------------------------------
READ_ONLY_WORDS = ("SELECT", "WITH", "SHOW", "DESCRIBE", "EXPLAIN")
UNSAFE_QUERY = (
    r";|--|/\*|\b(INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|ATTACH|DETACH|INSTALL|LOAD|COPY|EXEC|EXECUTE"
    r"|CALL|GRANT|REVOKE|TRUNCATE|VACUUM|EXPORT|IMPORT|PRAGMA)\b"
)
UNSAFE_FILTER = (
    r";|--|/\*|\b(ATTACH|DETACH|PRAGMA|INSTALL|LOAD|COPY|INSERT|UPDATE|DROP|CREATE|ALTER|EXEC|EXECUTE"
    r"|CALL)\b"
)

# --- What Spark's own SQL can reach besides tables: methods of the virtual machine, files by path or by the class of a
# reader, names made from texts, and programs that rows are sent through
ENGINE_ACCESS = (
    r"\b(?:java_method|reflect|try_reflect|identifier)`?\s*\("
    r"|\b(?:parquet|orc|csv|json|text|xml|avro|binaryfile)`?\s*\.\s*`"
    r"|\.\s*`[^`]*[/\\:]|`[^`]*\.[^`]*`\s*\."
    r"|\b(?:transform|map|reduce)\b[\s\S]*\busing\s*r?['\"]"
)

# --- Fixed values: failures ---------------------------------------------------
TRACE_HEADING = "Traceback (most recent call last):"
TRACE_BODY = r"(Traceback \(most recent call last\):[\s\S]*?)"
TRACE_BLOCK = TRACE_BODY + r"(?=\n\n|\z)"
FAILURE_WORDS = ("error", "exception", "critical", "failed", "fatal", "traceback")
TRACES_TITLE = "\n--- EXTRACTED STACK TRACE ---\n"
LINES_TITLE = "Extracted Failure Lines:\n"
NO_FAILURE = "No explicit stack trace or exception block detected in log data."
CONTEXT_WORDS = ("ERROR", "WARN", "FAIL")
HEAD_LINES, MIDDLE_LINES, TAIL_LINES, MAX_LINES = 15, 15, 20, 50
CRASH_TITLE = "\n\n... [RECENT CRASH CONTEXT] ...\n"

# --- How a Python traceback reads: a frame, everything up to the last one, and the type and first line of the exception
FRAME = r'(?m)^\s+File "([^"]*)", line (\d+)(?:, in (\S+))?'
UP_TO_LAST_FRAME = r'(?s)^.*\n\s+File "[^"]*", line \d+[^\n]*'
EXCEPTION = r"(?m)^([A-Za-z_][A-Za-z0-9_.]*)(?:: ?([^\n]*))?$((?s:.*))"

# --- Fixed values: question routing -------------------------------------------
DIAGNOSTIC_PHRASES = (
    r"why", r"root\s+cause", r"crash(?:ed)?", r"fail(?:ed|ure)?", r"broke(?:n)?",
    r"exception", r"traceback", r"diagnos(?:e|is)", r"debug",
)
SQL_PHRASES = (
    r"how many", r"count", r"list", r"average", r"avg", r"sum", r"total", r"top\s+\d+",
    r"group\s+by", r"which\s+(?:app|service|source_file)", r"show\s+(?:events|logs|records)",
    r"select", r"where", r"filter", r"most", r"least", r"by\s+app", r"by\s+level", r"source_file",
)

# --- Fixed values: report -----------------------------------------------------
NO_RESULTS = "No results available for this question."
QUERY_ERROR = "Error executing query: "
EMPTY_RESULT = "Query executed successfully. Result is empty."
REPORT_TITLE = "# Question"
CAUSE_TITLE, RESULT_TITLE, WARNINGS_TITLE = "## Root Cause Analysis\n", "## Query Results\n", "## Warnings\n"
PREVIEW_ROWS = 5
SAMPLE_ROWS = 3


def java(body: str, ignore_case: bool = False) -> str:
    """`body` with the flags Spark needs."""
    return ("(?idU)" if ignore_case else "(?dU)") + body


def whole_words(phrases) -> str:
    return r"\b(?:" + "|".join(phrases) + r")\b"
