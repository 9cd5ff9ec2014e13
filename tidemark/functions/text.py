"""Column builders for paths, hashes, text, secrets and routes."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of each language.
LANGUAGE_EXTENSIONS = {
    "python": (".py", ".pyi"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "typescript": (".ts", ".tsx", ".mts", ".cts"),
    "java": (".java",),
    "c": (".c", ".h"),
    "cpp": (".cpp", ".hpp", ".cc", ".cxx"),
    "go": (".go",),
    "rust": (".rs",),
    "php": (".php", ".phtml", ".php3", ".php4", ".php5", ".php7", ".phps"),
}

# Word lists and prefixes of the secret classifier.
EXACT_PLACEHOLDERS = ("password", "secret", "default", "123456", "admin", "none", "null", "localhost", "test")
PLACEHOLDER_PARTS = ("dummy", "placeholder", "example", "sample", "changeme", "change_me", "your_api_key", "your_secret", "your_key", "xxx", "mock", "fake", "todo", "fixme")
SECRET_PREFIXES = (
    "sk_live_", "sk_test_", "rk_live_", "ghp_", "gho_", "xoxb-", "xoxp-", "AKIA",
    "-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN OPENSSH PRIVATE KEY-----",
)
SENSITIVE_NAMES = (
    "password", "passwd", "secret", "token", "access_token", "refresh_token", "api_key", "apikey", "auth_token", "authorization",
    "bearer_token", "credit_card", "card_number", "ssn", "private_key", "session_token", "client_secret",
)
SAFE_NAME_PARTS = ("obscure", "masked", "redact", "redacted", "hash", "hashed", "safe", "clean", "anonymized", "obfuscated", "censored", "filter", "filtered")

# Token formats that redaction removes, in order.
REDACTED = "[REDACTED_SECRET]"
REDACTED_KEY = "[REDACTED_PRIVATE_KEY]"
TOKEN_FORMATS = (
    r"\bsk_live_[0-9a-zA-Z_]+\b", r"\bsk_test_[0-9a-zA-Z_]+\b", r"\brk_live_[0-9a-zA-Z_]+\b",
    r"\bghp_[0-9a-zA-Z_]{20,}\b", r"\bgho_[0-9a-zA-Z_]{20,}\b", r"\bghu_[0-9a-zA-Z_]{20,}\b", r"\bghs_[0-9a-zA-Z_]{20,}\b", r"\bghr_[0-9a-zA-Z_]{20,}\b",
    r"\bglpat-[0-9a-zA-Z_-]{20,}\b", r"\bxoxb-[0-9a-zA-Z_-]+\b", r"\bxoxp-[0-9a-zA-Z_-]+\b", r"\bxoxa-[0-9a-zA-Z_-]+\b", r"\bxoxr-[0-9a-zA-Z_-]+\b",
    r"\bAKIA[0-9A-Z]{16}\b", r"\bAIzaSy[0-9A-Za-z_-]{25,}\b",
)
PRIVATE_KEY = r"-----BEGIN [A-Z0-9 ]+PRIVATE KEY-----[\s\S]+?-----END [A-Z0-9 ]+PRIVATE KEY-----"
ASSIGNMENT = r"""(?i)\b([a-zA-Z0-9_]*(?:api_key|apikey|secret|password|passwd|token|access_token|refresh_token|auth_token|client_secret|private_key|_key)\b)(\s*[:=]\s*)(["'])(?!\[REDACTED_(?:SECRET|PRIVATE_KEY)\]\3)(.+?)\3"""
BEARER = r"(?i)(Bearer\s+)[A-Za-z0-9\-._~+/]{20,}=*"


def short_hash(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by colons; a null part counts as empty."""
    return F.substring(F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def extension(path: Column) -> Column:
    """The last suffix with its dot in lower case, empty if none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def language_of(path: Column) -> Column:
    ext = extension(path)
    out = None
    for name, suffixes in LANGUAGE_EXTENSIONS.items():
        out = F.when(ext.isin(*suffixes), name) if out is None else out.when(ext.isin(*suffixes), name)
    return out.otherwise("unknown")


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression; ``*`` crosses slashes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            body = pattern[i:end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end + 1
        else:
            out.append(re.sub(r"([^\w/])", r"\\\1", c))
    return "(?s)^" + "".join(out) + "$"


def lines_of(text: Column) -> Column:
    """Lines without the empty piece that a final newline leaves."""
    pieces = F.split(text, "\n")
    return F.when(F.get(pieces, F.size(pieces) - 1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)


def bits_per_char(s: Column) -> Column:
    """Shannon's measure of a text by itself; 0 for an empty or null one."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    n = F.size(chars)
    each = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(F.length(s) > 0, F.aggregate(each, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


def sensitive_name(name: Column) -> Column:
    low = F.lower(name)
    return F.forall(F.array(*map(F.lit, SAFE_NAME_PARTS)), lambda x: ~F.contains(low, x)) & F.exists(F.array(*map(F.lit, SENSITIVE_NAMES)), lambda x: F.contains(low, x))


def is_secret(name: Column, value: Column, bits: Column) -> Column:
    """Whether assigning ``value`` to ``name`` looks like a hardcoded credential."""
    low = F.lower(value)
    usable = (F.length(value) >= 8) & ~low.isin(*EXACT_PLACEHOLDERS) & F.forall(F.array(*map(F.lit, PLACEHOLDER_PARTS)), lambda x: ~F.contains(low, x))
    known = F.exists(F.array(*map(F.lit, SECRET_PREFIXES)), lambda x: F.startswith(value, x))
    mixed = value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]")
    return usable & (known | sensitive_name(name) & (F.length(value) >= 12) & ((bits > 3.3) | mixed | (F.length(value) >= 20)))


def mask(value: Column) -> Column:
    return F.when(F.length(value) > 10, F.concat(F.substring(value, 1, 4), F.lit("..."), F.right(value, F.lit(4)))).otherwise("***")


# Pieces that any text must hold, of which a redacted format takes something.
ASSIGNED_WORDS = ("key", "secret", "passw", "token")
FORMAT_STARTS = ("sk_live_", "sk_test_", "rk_live_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xoxb-", "xoxp-", "xoxa-", "xoxr-", "AKIA", "AIzaSy")


def redact(text: Column) -> Column:
    """Key blocks, then assignments, then known token formats; null becomes empty.

    Most texts hold none of the pieces without which no pattern can match, which
    plain searches find far faster than the patterns fail.
    """
    whole = F.coalesce(text, F.lit(""))
    has = lambda s, parts: reduce(or_, [F.contains(s, F.lit(p)) for p in parts])
    out = F.regexp_replace(whole, PRIVATE_KEY, REDACTED_KEY)
    out = F.regexp_replace(out, ASSIGNMENT, "$1$2$3" + REDACTED + "$3")
    out = F.regexp_replace(out, "|".join(TOKEN_FORMATS), REDACTED)  # formats don't overlap, so one pass does for all
    out = F.regexp_replace(out, BEARER, "$1" + REDACTED)
    assigned = has(whole, ('"', "'")) & has(F.lower(whole), ASSIGNED_WORDS)
    touched = F.contains(whole, F.lit("PRIVATE KEY")) | has(whole, FORMAT_STARTS) | assigned | F.contains(F.lower(whole), F.lit("bearer"))
    return F.when(touched, out).otherwise(whole)


def contains_ignoring_case(col: Column, needle: str) -> Column:
    return F.coalesce(F.contains(F.lower(col), F.lit(needle.lower())), F.lit(False))


def route_path(url: Column) -> Column:
    """The path of a URL without query or fragment, slashes collapsed, no slash at the end."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/?#]*", ""), r"[?#].*$", "")
    clean = F.regexp_replace(F.concat(F.lit("/"), path), "/+", "/")
    return F.when(F.length(clean) > 1, F.regexp_replace(clean, "/$", "")).otherwise(clean)


def route_group(path: Column) -> Column:
    """The first segment of a route, ``/`` if it has none."""
    first = F.split_part(path, F.lit("/"), F.lit(2))
    return F.when(first == "", "/").otherwise(F.concat(F.lit("/"), first))


def repository_id(remote: Column, path: Column) -> Column:
    """First 16 hex digits of the hash of the remote address, or of the path where there is none."""
    return F.substring(F.sha2(F.lower(F.trim(F.coalesce(F.when(F.trim(remote) != "", remote), path))), 256), 1, 16)


def git_url(url: Column) -> Column:
    """HTTPS form of a repository address without user, suffix or slash at the end."""
    https = F.regexp_replace(F.trim(url), r"^(?:git@|ssh://git@)([^:/]+)[:/]", "https://$1/")
    return F.regexp_replace(F.regexp_replace(https, r"^https?://(?:[^@/]+@)?", "https://"), r"(?:\.git)?/*$", "")


def drop_severity(severity: Column) -> Column:
    """One level lower; info stays."""
    return F.when(severity == "critical", "high").when(severity == "high", "medium").when(severity == "medium", "low").otherwise("info")


def shown_path(path: Column, authenticated: bool) -> Column:
    """The path for those who are signed in, its last part for others."""
    return path if authenticated else F.element_at(F.split(path, "/"), -1)


# Words that make a route sensitive.
SENSITIVE_ROUTE_WORDS = (
    "admin", "user", "users", "account", "accounts", "profile", "profiles", "setting", "settings", "password", "passwords", "secret", "secrets", "key", "keys",
    "credential", "credentials", "token", "tokens", "payment", "payments", "refund", "refunds", "billing", "checkout", "finance", "invoice", "invoices", "order", "orders",
    "privilege", "privileges", "role", "roles", "permission", "permissions", "audit", "audits", "security", "config", "configuration", "manage", "management",
    "internal", "private", "sensitive", "upload", "export", "delete", "destroy", "purge", "update", "create", "grant", "revoke", "transfer",
)


def sensitive_route(path: Column) -> Column:
    """Whether one of the route's words is sensitive."""
    return F.arrays_overlap(F.regexp_extract_all(F.lower(path), F.lit("[a-z0-9]+"), F.lit(0)), F.array(*map(F.lit, SENSITIVE_ROUTE_WORDS)))
