"""Text of transactions as columns: merchant names, tokens, fingerprints (FN-09..14, FN-19..21, JN-05)."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations in merchant names and what they stand for.
ABBREVIATIONS = {
    "MSFT": "Microsoft", "AMZN": "Amazon", "AWS": "AWS", "GOOGL": "Google", "GOOG": "Google", "INTL": "International",
    "PYMNT": "Payment", "PYMT": "Payment", "PMT": "Payment", "SVC": "Service", "SVCS": "Services",
    "SUBSCR": "Subscription", "SUBS": "Subscription", "MBR": "Member", "MBRSHP": "Membership", "MNTHLY": "Monthly",
    "YRLY": "Yearly", "ANNL": "Annual", "RECUR": "Recurring", "AUTOPAY": "Autopay", "DIG": "Digital", "DGTL": "Digital",
    "TECH": "Technology", "ENTMT": "Entertainment", "ENTERTN": "Entertainment",
}
# Tokens that say nothing about the merchant.
STOP_WORDS = ["COM", "WWW", "POS", "CARD", "DEBIT", "CREDIT", "ACH"]


#: Small letters that decompose into a plain Latin letter and marks, and that letter.
_PAIRS = [(m, unicodedata.normalize("NFD", m)[0]) for m in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))) if m == m.lower() and "a" <= unicodedata.normalize("NFD", m)[0] <= "z" and len(unicodedata.normalize("NFD", m)) > 1]
MARKED, PLAIN = ("".join(p[i] for p in _PAIRS) for i in (0, 1))


def nil_if_blank(c: Column) -> Column:
    """Trimmed text, null if nothing is left (FN-12)."""
    return F.nullif(F.trim(c), F.lit(""))


def folded(c: Column) -> Column:
    """Lower case without diacritics, for comparison (FN-19): Latin letters with marks, and marks that stand alone."""
    plain = F.octet_length(c) == F.length(c)  # ASCII has no marks, and most texts are ASCII
    return F.when(plain, F.lower(c)).otherwise(F.regexp_replace(F.translate(F.lower(c), MARKED, PLAIN), r"\p{M}+", ""))


def identity_token(c: Column) -> Column:
    """Folded text with every run of other characters as one space (FN-09); null counts as empty."""
    return F.trim(F.regexp_replace(folded(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def tokens(c: Column) -> Column:
    """Distinct identity tokens."""
    return F.filter(F.array_distinct(F.split(identity_token(c), " ")), lambda t: t != "")


def jaccard(a: Column, b: Column) -> Column:
    """Share of tokens that two token arrays have in common; 0 if both are empty (JN-05)."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def fingerprint(*fields: Column) -> Column:
    """Identity tokens of the fields joined by a pipe (FN-10)."""
    return F.concat_ws("|", *[identity_token(f.cast("string")) for f in fields])


def normalized_merchant(raw: Column) -> Column:
    """Up to four words that name the merchant (FN-13); null counts as empty."""
    upper = F.upper(F.coalesce(raw, F.lit("")))
    cleaned = F.regexp_replace(upper, r"[*#/]+", " ")
    cleaned = F.regexp_replace(cleaned, r"\b\d{2,}\b", " ")
    cleaned = F.regexp_replace(cleaned, r"\b[A-Z]*\d[A-Z0-9\-]{2,}\b", " ")
    words = F.filter(F.split(cleaned, r"[^\p{L}\p{M}\p{N}]+"), lambda w: (w != "") & ~w.isin(STOP_WORDS))
    known = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v))])
    return F.array_join(F.transform(F.slice(words, 1, 4), lambda w: F.coalesce(known[w], F.initcap(F.lower(w)))), " ")


def contains_any(text: Column, phrases: list[str]) -> Column:
    """True if the folded text holds one of the phrases, anywhere; one pattern, so the text is built once."""
    return F.coalesce(text.rlike("|".join(re.escape(p) for p in phrases)), F.lit(False))


def signals_any(text: Column, terms: list[str]) -> Column:
    """FN-20: a term of one token must be a token of the text, others may be anywhere."""
    single = [t for t in terms if t.isalnum()]
    whole = [rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(single)})(?![\p{{L}}\p{{N}}])"] if single else []
    return F.coalesce(text.rlike("|".join([*whole, *[re.escape(t) for t in terms if not t.isalnum()]])), F.lit(False))


def memo_shape(memo: Column) -> Column:
    """A memo without what differs from bill to bill: digits, references, months (FN-21)."""
    out = F.lower(F.coalesce(memo, F.lit("")))
    out = F.regexp_replace(out, r"\b[a-f0-9]{8,}\b", " ")
    out = F.regexp_replace(out, r"\d+", " ")
    out = F.regexp_replace(out, r"\b(invoice|inv|ref|reference|order|txn|transaction|id|no)\b", " ")
    out = F.regexp_replace(out, r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b", " ")
    return F.trim(F.regexp_replace(out, r"[^\p{L}]+", " "))
