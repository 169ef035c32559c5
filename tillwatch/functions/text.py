"""Masking and normalising of failure descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillwatch import constants as K


def mask_description(text: Column, unicode_words: bool = False) -> Column:
    """Replace variable tokens by placeholders. The rule order matters: a timestamp or an
    amount is masked before its digits could be read as an id or a reference number.

    ``unicode_words`` widens ``\\b`` and ``\\d`` from ASCII to Unicode.
    """
    for pattern, placeholder in K.MASK_RULES:
        text = F.regexp_replace(text, ("(?U)" if unicode_words else "") + pattern, placeholder)
    return text


def normalise_template(text: Column) -> Column:
    """Trim, collapse whitespace, lower-case (``lower``, not case folding)."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " "))


def template_hash(text: Column) -> Column:
    return F.sha2(normalise_template(text), 256)
