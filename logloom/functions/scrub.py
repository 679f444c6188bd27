"""Removal of credentials from text and from JSON documents.

`scrub_text` is three chained native regular expressions and stays inside
generated code.  `scrub_json` edits documents of unknown shape; a native test
decides which rows have anything to look at.  Of those, documents whose strings
stand as they are spelled (no escapes) are edited natively, the others in an
Arrow UDF.  There a document is not rebuilt: its tokens are scanned once, and
only the string literals that hold a credential are replaced, so everything
else stays byte for byte, however deep it lies.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Marker, key names and patterns must equal those the log writers
# use, or old and new records would be redacted differently.
REDACTED = "[REDACTED]"
SENSITIVE_KEYS = (
    r"s3[_-]?secret|s3[_-]?key|secret[_-]?access[_-]?key|access[_-]?key[_-]?id"
    r"|aws[_-]?secret|aws[_-]?access|api[_-]?key|apikey|secret|password|passwd"
    r"|token|authorization|auth[_-]?token|bearer"
)
KEY_VALUE_PATTERN = (
    r"""(?i)(\\?["']?(?:s3[_-]?secret|s3[_-]?key|secret[_-]?access[_-]?key"""
    r"""|access[_-]?key[_-]?id|aws[_-]?secret|aws[_-]?access|api[_-]?key|apikey"""
    r"""|secret|password|token)\\?["']?\s*[:=]\s*\\?["']?)([^"'\s\\,}]+)"""
)
SQL_SECRET_PATTERN = r"(?i)\b(KEY_ID|SECRET)\s+'([^']+)'"
BEARER_PATTERN = r"(?i)(Bearer\s+)[A-Za-z0-9._\-]+"

TEXT_RULES = (
    (KEY_VALUE_PATTERN, "{1}" + REDACTED),
    (SQL_SECRET_PATTERN, "{1} '" + REDACTED + "'"),
    (BEARER_PATTERN, "{1}" + REDACTED),
)
# Strings under these keys may themselves hold a JSON document.
EMBEDDED_JSON_KEYS = ("arguments", "content")

# Every pattern and every sensitive key holds one of these words, so text with
# none of them needs no regular expression.  The long s counts as an s in the patterns.
HINTS = ("secret", "key", "passw", "token", "bearer", "aws", "authorization", "\u017f")


# Blanks as Python's patterns see them; the JVM's Unicode class lacks the four separators.
_JVM_BLANK = r"\s\x1c-\x1f"


def _jvm(pattern: str) -> str:
    """The pattern with Unicode classes, so that both engines redact the same text."""
    unicode = pattern.replace("(?i)", "(?iU)")
    return re.sub(r"\\s(?=[*+])", lambda _: f"[{_JVM_BLANK}]", unicode).replace(r"'\s\\,", rf"'{_JVM_BLANK}\\,")


def _hinted(c: Column) -> Column:
    lower, hit = F.lower(c), F.lit(False)
    for word in HINTS:
        hit = hit | lower.contains(word)
    return hit


def scrub_text(c: Column) -> Column:
    """Redact credentials written as key/value pairs, SQL literals or bearer tokens.

    Plain substring tests, several times faster than the patterns, let clean
    text through as it is.
    """
    clean = c
    for pattern, replacement in TEXT_RULES:
        clean = F.regexp_replace(clean, _jvm(pattern), replacement.replace("{1}", "$1"))
    return F.when(_hinted(c), clean).otherwise(c)


_RULES = [(re.compile(pattern), replacement.replace("{1}", r"\1")) for pattern, replacement in TEXT_RULES]
_SENSITIVE = re.compile(SENSITIVE_KEYS, re.IGNORECASE)
_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[{}\[\],:]', re.DOTALL)
_CLOSES = {"}": "{", "]": "["}


def scrub_plain(text: str) -> str:
    for pattern, replacement in _RULES:
        text = pattern.sub(replacement, text)
    return text


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    except RecursionError:  # too deep for the parser; the scan below needs no recursion
        return True
    return True


def _clean_literal(literal: str, key: str | None) -> str:
    """A JSON string literal under `key`, or its replacement."""
    if key is not None and _SENSITIVE.fullmatch(key):
        return json.dumps(REDACTED)
    value = json.loads(literal) if "\\" in literal else literal[1:-1]
    if value.isascii() and "\\" not in value:  # an embedded document spells no character by an escape
        lower = value.lower()
        if not any(word in lower for word in HINTS):
            return literal
    embedded = key in EMBEDDED_JSON_KEYS and value.lstrip()[:1] in ("{", "[") and _is_json(value)
    clean = _edited(value) if embedded else scrub_plain(value)
    return literal if clean == value else json.dumps(clean, ensure_ascii=literal.isascii())


def _edited(document: str) -> str:
    """The JSON text with the literals of credentials replaced.

    One pass over its tokens.  A frame holds the bracket, the key in force
    (a list passes its own on to its items) and whether a name comes next.
    """
    out, copied, frames = [], 0, []
    for token in _TOKEN.finditer(document):
        mark = token[0]
        top = frames[-1] if frames else None
        if mark in "{[":
            frames.append([mark, top[1] if top and mark == "[" else None, mark == "{"])
        elif mark in "}]":
            if not top or top[0] != _CLOSES[mark]:
                return scrub_plain(document)
            frames.pop()
        elif mark == ",":
            if top and top[0] == "{":
                top[2] = True
        elif mark == ":":
            if top:
                top[2] = False
        elif top and top[2]:
            top[1] = json.loads(mark) if "\\" in mark else mark[1:-1]
        else:
            clean = _clean_literal(mark, top[1] if top else None)
            if clean != mark:
                out += [document[copied : token.start()], clean]
                copied = token.end()
    if frames:
        return scrub_plain(document)
    return "".join(out) + document[copied:] if out else document


def scrub_document(text: str | None) -> str | None:
    """One JSON document without its credentials; other text by the text rules.

    A document with nothing to redact comes back as it is, so that "did the
    text change" is the same question as "was something redacted".
    """
    if text is None:
        return None
    return _edited(text) if _is_json(text) else scrub_plain(text)


# What the first character of a text says to the UDF: to be scrubbed, or scrubbed natively and only to be passed on.
_TO_SCRUB, _SCRUBBED = "?", "="


def _answer(text: str) -> str:
    return text[1:] if text[0] == _SCRUBBED else scrub_document(text[1:])


@F.pandas_udf(T.StringType())
def _scrub_documents(docs: pd.Series) -> pd.Series:
    return docs.map(_answer, na_action="ignore")


# White space inside a document, as itself or in JSON escapes of any nesting.
_GAP = rf"(?:[{_JVM_BLANK}]|\\+(?:[nrtfb]|u[0-9a-fA-F]{{4}}))"
_KEY_VALUE_KEYS = KEY_VALUE_PATTERN.split("(?:", 1)[1].split(")", 1)[0]
# Where a rule can apply to a document as it is written: a sensitive name between quotes before a
# colon; a name of the key/value rule before a colon or equals sign; the SQL and bearer forms; or
# an escape that spells a character of a rule (ASCII, and the two letters that fold to k and s).
SECRET_GATE = "(?iU)" + "|".join((
    rf'"(?:{SENSITIVE_KEYS})\\*"{_GAP}*:',
    rf"""(?:{_KEY_VALUE_KEYS})[\\"']*{_GAP}*[:=]""",
    rf"""(?:KEY_ID|SECRET){_GAP}+'""",
    rf"Bearer{_GAP}+[A-Za-z0-9._\-]",
    r"\\u(?:00[2-7][0-9a-f]|017f|212a)",
))


# Stands for the marker in text that does not hold this character itself.
_MARK = "\x01"
# After a word: its value is the marker already and the rule changes nothing.  Either nothing is quoted and the value ends
# behind the marker, however deep it is escaped; or name and value stand between quotes of one depth; or the SQL form.
_DONE = rf"""(?! *[:=] *{_MARK}(?:["', }}]|\\+["nrt]))(?!(\\*)" *: *\1"{_MARK}\1")(?! '{_MARK}')"""
# The same for ASCII text in lower case, by the literal word that a match holds: without case folding and with a
# literal first each pattern is a fast search.  A key/value name counts by its last part, as nothing is anchored.
_G, _THEN = _GAP.replace("A-F", ""), rf"""[\\"']*{_GAP.replace("A-F", "")}*[:=]"""
WORD_GATES = {
    "token": rf"token{_DONE}{_THEN}",
    "password": rf"password{_DONE}{_THEN}",
    "secret": rf"secret{_DONE}(?:{_THEN}|{_G}+')",
    "key": rf"(?:(?:s3|api|secret[_-]?access)[_-]?key|access[_-]?key[_-]?id){_DONE}{_THEN}|key_id(?! '{_MARK}'){_G}+'",
    "aws": rf"aws[_-]?access{_DONE}{_THEN}",
    "passwd": rf'"passwd{_DONE}\\*"{_G}*:',
    "authorization": rf'"authorization{_DONE}\\*"{_G}*:',
    "bearer": rf'"bearer{_DONE}\\*"{_G}*:|bearer{_G}+[a-z0-9._\-]',
    "\\u": r"\\u(?:00[2-7][0-9a-f]|017f|212a)",
}


def may_hold_secret(c: Column) -> Column:
    """Native test of a document, false only where no rule changes anything.

    Substring tests come first; only text that holds one of the words meets its pattern.  A count
    like `"tokens": 5` holds a word and is no secret, and passes here, as does a value that is
    redacted already.  Text beyond ASCII, where letters fold in other ways, meets the pattern for all.
    """
    marked, hit = F.lower(F.replace(c, F.lit(REDACTED), F.lit(_MARK))), F.lit(False)
    for word, pattern in WORD_GATES.items():
        hit = hit | (marked.contains(word) & marked.rlike(pattern))
    beyond = (_hinted(c) | c.contains("\\u")) & c.rlike(SECRET_GATE)
    # the condition looks at the same text as the gates, so that it is made once a row and not once a word
    return F.when((F.octet_length(marked) == F.length(marked)) & ~c.contains(_MARK), hit).otherwise(beyond)


# The text rules for a document whose strings are spelled without escapes.  A match holds no double quote, so it lies
# within one string; a string before a colon is a name, and names stay.  The names of the key/value rule are reduced to
# their last parts, as in the gate: what is replaced is the run behind the separator.
_IN_VALUE = r'(?=[^"]*+" *+(?!:))'
PLAIN_RULES = (
    (
        r"""(?i)((?=[sptak])(?:secret(?:[_-]?access[_-]?key)?|password|token|(?:s3|api)[_-]?key|access[_-]?key[_-]?id|aws[_-]?access)"""
        rf"""'? *+[:=] *+'?)[^"' ,}}]++{_IN_VALUE}""",
        "$1" + REDACTED,
    ),
    (rf"""(?i)\b(KEY_ID|SECRET) +'[^'"]++'{_IN_VALUE}""", "$1 '" + REDACTED + "'"),
    (rf"(?i)(Bearer +)[A-Za-z0-9._\-]++{_IN_VALUE}", "$1" + REDACTED),
)
_SENSITIVE_NAME = rf'(?i)"(?=[sapbt])(?:{SENSITIVE_KEYS})" *+:'


def _is_plain(c: Column) -> Column:
    """Whether a text is one JSON document of printable ASCII without escapes and without a sensitive name.

    The strict parser stops after the first value, so another one is put behind: a string that only an
    escape can spell is the second of two where, and only where, the text before it is one whole value.
    """
    both = F.try_parse_json(F.concat(F.lit("["), c, F.lit(',"\\u0001"]')))
    whole = F.try_variant_get(both, "$[1]", "string") == "\u0001"
    return ~c.contains("\\") & ~c.rlike(r"\P{Print}") & ~c.rlike(_SENSITIVE_NAME) & F.coalesce(whole, F.lit(False))


def _scrub_plain_document(c: Column) -> Column:
    (key_value, put), (sql, put_sql), (bearer, put_bearer) = PLAIN_RULES
    clean = F.regexp_replace(c, key_value, put)
    clean = F.when(c.contains("'"), F.regexp_replace(clean, sql, put_sql)).otherwise(clean)
    return F.when(F.lower(c).contains("bearer"), F.regexp_replace(clean, bearer, put_bearer)).otherwise(clean)


def scrub_json(c: Column) -> Column:
    """Redact credentials by key name and by text rule inside a JSON document.

    Texts scrubbed natively pass through the UDF as well: what is decided before it, once a row,
    would else be decided again behind it.
    """
    native = F.concat(F.lit(_SCRUBBED), _scrub_plain_document(c))
    suspicious = F.when(may_hold_secret(c), F.when(_is_plain(c), native).otherwise(F.concat(F.lit(_TO_SCRUB), c)))
    return F.coalesce(_scrub_documents(suspicious), c)
