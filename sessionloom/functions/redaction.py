"""Masking of credentials: one alternation in one pass, the earliest match at each place wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK, REDACTED = "********", "[redacted]"
#: vendors' prefixes, each with the least length of what follows.
VENDOR_PREFIXES = [
    ("sk-", 16),
    ("sk_", 16),
    ("AKIA", 16),
    ("ASIA", 16),
    ("ghp_", 20),
    ("gho_", 20),
    ("ghs_", 20),
    ("ghr_", 20),
    ("github_pat_", 20),
    ("xoxa-", 10),
    ("xoxb-", 10),
    ("xoxp-", 10),
    ("xoxr-", 10),
    ("AIza", 30),
    ("ya29.", 20),
    ("glpat-", 20),
    ("npm_", 30),
    ("pypi-", 20),
    ("hf_", 30),
    ("SG.", 20),
    ("Bearer ", 12),
    ("bearer ", 12),
    ("rk_live_", 20),
    ("sk_live_", 20),
]
#: Names whose value is a secret.
SECRET_NAMES = [
    "api_key",
    "api-key",
    "apikey",
    "api_secret",
    "access_key",
    "access-key",
    "secret_key",
    "secret-key",
    "client_secret",
    "private_key",
    "private-key",
    "password",
    "passwd",
    "passphrase",
    "token",
    "access_token",
    "refresh_token",
    "auth_token",
    "aws_secret_access_key",
    "database_url",
    "redis_url",
]
#: Fixed value: characters of a token.
TOKEN = r"[A-Za-z0-9\-_.+/=]"
_ID, _NO_DOT = "[A-Za-z0-9_]", r"[A-Za-z0-9\-_+/=]"


def pattern() -> str:
    """The alternation, in Java's syntax.  Group 1: what stays before a named secret's value."""
    vendors = []
    for prefix, least in VENDOR_PREFIXES:
        vendors.append(prefix.replace(".", r"\.") + TOKEN + f"{{{least},}}")
    pem = r"-----BEGIN[\s\S]*?-----END[^\n]*|-----BEGIN[\s\S]*"
    jwt = rf"(?={TOKEN}{{24,}})eyJ{_NO_DOT}*+\.{_NO_DOT}*+\.{_NO_DOT}*+(?!\.)"
    listed = f"(?i:{'|'.join(SECRET_NAMES)})(?=[^\\p{{IsAlphabetic}}\\p{{N}}_])"
    like = f"(?:{_ID}*(?:_key|apikey)(?!{_ID})|{_ID}*(?:secret|password|passwd|credential)|(?!{_ID}*tokens(?!{_ID})){_ID}*token)"
    name = f"(?>{listed}|(?=(?i:{like})){_ID}++)"
    value = r"""(?:(?<=")[^"]+|(?<=')[^']+|(?<!["'])[^\p{IsWhite_Space};,)}\]]+)"""
    named = rf"""((?<!{_ID}){name}["' ]*+[=:] *+["']?+){value}"""
    return "|".join([pem, *vendors, jwt, named])


def quoted(name: str) -> str:
    """Only `name = "value"`, in this spelling, wherever it stands.  Group 1 as in pattern()."""
    return rf'''(\Q{name}\E = ")[^"]+'''


def may_hold(c: Column) -> Column:
    """Whether a text has any of the strings without which pattern() matches nothing: plain searches, far cheaper than it."""
    exact = ["-----BEGIN", "eyJ", *(prefix for prefix, _ in VENDOR_PREFIXES)]
    folded = F.lower(c)
    named = ["key", "secret", "passw", "passphrase", "credential", "token", "_url"]
    out = F.lit(False)
    for x in exact:
        out |= c.contains(x)
    for x in named:
        out |= folded.contains(x)
    return out


def mask(c: Column, replacement: str = MASK, only: str | None = None) -> Column:
    """The text with every credential replaced; a named secret keeps its name.  With only, what that pattern matches."""
    masked = F.regexp_replace(c, only or pattern(), "$1" + replacement.replace("$", "\\$"))
    return masked if only else F.when(may_hold(c), masked).otherwise(c)


def redact(c: Column) -> Column:
    return mask(c, REDACTED)


def count(c: Column, only: str | None = None) -> Column:
    """How many credentials mask() replaces."""
    found = F.regexp_count(c, F.lit(only or pattern()))
    return found if only else F.when(may_hold(c), found).when(c.isNotNull(), 0)
