"""Scalar text functions, all Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that never are query terms.
STOPWORDS = ["the", "and", "for", "was", "were", "what", "how", "did", "does", "with", "that", "this", "from", "have"]
#: Parts of a query term that make it an error term; parts of a line that make it an error line; tool names.
ERROR_PARTS = ["error", "fail", "timeout", "panic", "refuse"]
ERROR_LINE = ["error", "failed", "panic", "timeout", "exhausted", "refused"]
TOOL_NAMES = ["bash", "read", "write", "edit", "glob", "grep", "list_directory", "view_file"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z to lower case, nothing else."""
    return F.when(c.rlike("[A-Z]"), F.translate(c, _UPPER, _LOWER)).otherwise(c)


def fold(c: Column) -> Column:
    """Unicode lower case, one character to one: U+0130 stays, and a capital sigma is always the inner small sigma."""
    odd = F.replace(F.lower(F.replace(F.replace(c, F.lit("Σ"), F.lit("σ")), F.lit("İ"), F.lit("\ue000"))), F.lit("\ue000"), F.lit("İ"))
    return F.when(c.contains("Σ") | c.contains("İ"), odd).otherwise(F.lower(c))


def fold_text(text: str) -> str:
    """fold() for a pattern on the driver."""
    return "".join(ch.lower() if len(ch.lower()) == 1 else ch for ch in text)


def smart_case_sensitive(pattern: str, case: str = "smart") -> bool:
    """Whether a pattern is matched with its case: case is smart, sensitive or insensitive."""
    return case == "sensitive" or (case == "smart" and any(ch.isupper() for ch in pattern))


def literal_find(line: Column, pattern: str, case: str = "insensitive") -> Column:
    """The first character position of the pattern, from 0; null if it isn't there or is empty."""
    if not pattern:
        return F.lit(None).cast("int")
    at = F.instr(line, pattern) if smart_case_sensitive(pattern, case) else F.instr(fold(line), fold_text(pattern))
    return F.when(at > 0, at - 1)


def trim_end(c: Column) -> Column:
    """Without white space, of any kind, at the end."""
    return F.regexp_replace(c, r"(?U)\s+$", "")


def split_lines(c: Column) -> Column:
    r"""Lines at \n or \r\n; a lone \r stays."""
    return F.split(c, "\r?\n", -1)


def query_terms(query: str) -> list[str]:
    """Terms of a query, in order, repeats kept: ASCII lower case, three bytes or more, no stop word."""
    parts = re.split(r"[^\w.\-]+", query)
    lowered = ["".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in p) for p in parts]
    return [p for p in lowered if len(p.encode()) >= 3 and p not in STOPWORDS]


def query_terms_of(c: Column) -> Column:
    """query_terms() of a column."""
    parts = F.transform(F.split(c, r"(?U)[^\p{Alnum}_.\-]+"), ascii_lower)
    return F.filter(parts, lambda p: (F.octet_length(p) >= 3) & ~p.isin(STOPWORDS))


def path_terms_of(c: Column) -> Column:
    """Words of a query that look like paths, without other characters around them."""
    words = F.filter(F.split(c, r"(?U)\s+"), lambda w: w.contains("/") | w.contains(".rs") | w.contains(".ts"))
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"(?U)^[^\p{Alnum}]+|[^\p{Alnum}]+$", ""))
    return F.filter(bare, lambda w: w != "")


def error_terms_of(terms: Column) -> Column:
    return F.filter(terms, lambda t: t.rlike("|".join(ERROR_PARTS)))


def project_label(cwd: Column) -> Column:
    """The last part of a path, %20 as a space; null if blank."""
    last = F.element_at(F.split(F.regexp_replace(cwd, r"[/\\]+$", ""), r"[/\\]"), -1)
    label = F.replace(last, F.lit("%20"), F.lit(" "))
    return F.when(F.trim(label) != "", label)


def locator(harness: Column, doc_id: Column, msg_idx: Column) -> Column:
    """harness:id#n, n from 1; without #n for a null index."""
    head = F.concat(harness, F.lit(":"), doc_id)
    return F.when(msg_idx.isNull(), head).otherwise(F.concat(head, F.lit("#"), (msg_idx + 1).cast("string")))


def short_locator(c: Column) -> Column:
    """A locator with its id cut to eight characters."""
    rest = F.substring_index(c, "#", -1)
    return F.concat(F.split_part(c, F.lit(":"), F.lit(1)), F.lit(":"), F.substring(F.split_part(F.split_part(c, F.lit(":"), F.lit(2)), F.lit("#"), F.lit(1)), 1, 8), F.when(c.contains("#"), F.concat(F.lit("#"), rest)).otherwise(""))


def one_line(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def flat_line(c: Column) -> Column:
    """Each white space as a space, other control characters dropped, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?U)\s", " "), r"\p{Cc}", ""))


def scrub(c: Column) -> Column:
    """Control characters as spaces, one for one."""
    return F.regexp_replace(c, r"\p{Cc}", " ")


def truncate(c: Column, n: int, marker: str) -> Column:
    """At most n characters, then the marker if there were more."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(marker))).otherwise(c)


def strip_ansi(c: Column) -> Column:
    """Without terminal escapes: CSI, OSC and two-character ones."""
    return F.regexp_replace(c, "\x1b(?:\\[[0-?]*[ -/]*[@-~]|\\][^\x07\x1b]*(?:\x07|\x1b\\\\)?|[@-Z\\\\^_])", "")


def encode_project_dir(c: Column) -> Column:
    return F.regexp_replace(c, r"[/.\\:]", "-")


def safe_name(c: Column) -> Column:
    """A file name: path and control characters as _, not blank, at most 180 bytes of whole characters."""
    clean = F.regexp_replace(F.regexp_replace(c, r"[/\\:*?\"<>|\p{Cc}]", "_"), r"^\.+$", "_")
    clean = F.when(F.trim(clean) == "", "artifact").otherwise(clean)
    octets = F.substring(clean.cast("binary"), 1, 180)
    whole = F.regexp_extract(F.hex(octets), "^((?:[0-7].|[CD]...|E.....|F.......)*)", 1)
    return F.when(F.octet_length(clean) <= 180, clean).otherwise(F.decode(F.unhex(whole), "UTF-8"))


def safe_id(c: Column) -> Column:
    """Whether an id can be part of a path."""
    return (c != "") & (c != ".") & (c != "..") & ~c.rlike(r"[/\\:\p{Cc}]")


def file_uri_path(c: Column) -> Column:
    """The path of a file URI; other texts stay.  A plus sign is itself."""
    return F.when(c.startswith("file://"), F.url_decode(F.replace(F.regexp_replace(c, "^file://(?:localhost)?", ""), F.lit("+"), F.lit("%2B")))).otherwise(c)
