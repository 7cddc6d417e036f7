"""Normal form of pages before hashing, visible text, entities and error pages, as Column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F

from .text import squeeze

#: Form fields whose value changes with every request.
VOLATILE_FIELDS = ["__VIEWSTATE", "__VIEWSTATEGENERATOR", "__VIEWSTATEENCRYPTED", "__EVENTVALIDATION", "__PREVIOUSPAGE", "__REQUESTDIGEST"]
#: The named references that are decoded.
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "euro": "€", "ordm": "º", "ordf": "ª", "laquo": "«", "raquo": "»", "ndash": "–", "mdash": "—", "hellip": "…", "aacute": "á", "eacute": "é", "iacute": "í", "oacute": "ó", "uacute": "ú", "agrave": "à", "acirc": "â", "ecirc": "ê", "ocirc": "ô", "atilde": "ã", "otilde": "õ", "ccedil": "ç"}
GONE = "[removido]"


#: Hidden fields that guard against forgery, and what changes in addresses and texts between captures.
GUARDS = "__RequestVerificationToken|csrf[-_]?token|authenticity_token"
SESSION = r"""(?i)\b(jsessionid|phpsessid|aspsessionid[a-z]*)=[^&"';\s]+"""
BREAKER = r"(?i)([?&](?:v|ver|version|_|cb|t)=)\d{6,}"
UPDATED = r"(?i)(ltim[ao]\s+(?:atualiza|actualiza)[^<:]*[:\s]+)[^<]{4,40}"


def normal_form(page: Column) -> Column:
    """A page without what changes between captures of the same content.

    Elements first (scripts and styles, hidden fields by name), then attributes, then what stands in addresses and text.
    """
    named = lambda names: rf"""<input\b(?=[^>]*?\bname\s*=\s*["']?({names})\b)"""
    quoted = r"""\s*=\s*(?:"[^"]*"|'[^']*')"""
    steps = {
        r"(?is)<(script|style)\b[^>]*>.*?</\1>": f"<$1>{GONE}</$1>",
        f"(?i){named('|'.join(VOLATILE_FIELDS))}[^>]*>": f'<input name="$1" value="{GONE}" />',
        rf"(?i)({named(GUARDS)}[^>]*?\bvalue){quoted}": f'$1="{GONE}"',
        rf"(?i)\b(nonce|id|for){quoted}": f'$1="{GONE}"',
        SESSION: f"$1={GONE}",
        BREAKER: f"$1{GONE}",
        UPDATED: f"$1{GONE}",
    }
    for pattern, new in steps.items():
        page = F.regexp_replace(page, pattern, new)
    return F.trim(F.regexp_replace(page, r"\s+", " "))


def content_hash(page: Column) -> Column:
    return F.sha2(normal_form(page), 256)


_REFERENCE = re.compile(r"&#x([0-9a-f]+);|&#(\d+);|&([a-z]+);", re.I)


def _decoded(m: re.Match) -> str:
    code = int(m[1], 16) if m[1] else int(m[2]) if m[2] else None
    if code is None:
        return ENTITIES.get(m[3].lower(), m[0])
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]


def _decode(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else _REFERENCE.sub(_decoded, x).replace("&amp;", "&"))


def decode_entities(s: Column) -> Column:
    """Character references: numeric, and the named ones above; ``&amp;`` last, so nothing is decoded twice."""
    return F.when(s.contains("&"), F.pandas_udf(_decode, "string")(s)).otherwise(s)


def visible_text(page: Column) -> Column:
    t = F.regexp_replace(normal_form(page), r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    return squeeze(decode_entities(F.regexp_replace(t, r"<[^>]*>", " ")))


#: What the title of an error page says; 404 stands alone, not in a longer number, a telephone number or a code.
CODE_404 = r"(?<![\p{L}\d])(?<!\d[ .()-]{1,2})404(?![\p{L}\d]|\)?[ .-]?\d)"
ERROR_TITLE = rf"{CODE_404}|(?<!\p{{L}})erro(?:s|rs?)?(?!\p{{L}})|not found|n[aã]o encontrad"


def soft_404(page: Column) -> Column:
    """An error page that was served as if it were content."""
    return F.coalesce(page.rlike(rf"(?i)<title>[^<]*(?:{ERROR_TITLE})|BlobNotFound|<Error><Code>"), F.lit(False))
