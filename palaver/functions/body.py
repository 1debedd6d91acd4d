"""Text stored in a length-prefixed binary message body."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .expr import let

# Fixed values of the body format: class name, bytes between it and the length, and the
# lead bytes that announce a two-byte or four-byte little-endian length.
CLASS_NAME = "NSString"
HEADER_BYTES = 5
LONG_LENGTHS = {0x81: 2, 0x82: 4}


def body_text(blob: Column) -> Column:
    """Text of a body column, null when the body is absent, foreign or truncated.

    ISO-8859-1 maps each byte to one character, so string functions address bytes.
    """
    return let(F.decode(blob, "ISO-8859-1"), _payload)


def _payload(chars: Column) -> Column:
    def number(start: Column, width: int) -> Column:
        digits = F.reverse(F.substr(chars, start, F.lit(width)))
        return F.conv(F.hex(F.encode(digits, "ISO-8859-1")), 16, 10).cast("long")

    def prefixed(lead_at: Column) -> Column:
        lead = number(lead_at, 1)
        choices = F.struct(lead_at.alias("at"), lead.alias("size"))
        for mark, width in LONG_LENGTHS.items():
            complete = lead_at + F.lit(width) <= F.char_length(chars)
            long_form = F.struct(
                (lead_at + F.lit(width)).alias("at"),
                F.when(complete, number(lead_at + F.lit(1), width)).alias("size"))
            choices = F.when(lead == mark, long_form).otherwise(choices)
        return choices

    def content(head: Column) -> Column:
        fits = head["at"] + head["size"] <= F.char_length(chars)
        raw = F.encode(F.substr(chars, head["at"] + F.lit(1), head["size"].cast("int")), "ISO-8859-1")
        return F.when(fits, F.make_valid_utf8(raw.cast("string")))

    found = F.instr(chars, CLASS_NAME)
    lead_at = F.when(found > 0, found + F.lit(len(CLASS_NAME) + HEADER_BYTES))
    lead_at = F.when(lead_at <= F.char_length(chars), lead_at)
    return let(lead_at, lambda at: F.when(at.isNotNull(), let(prefixed(at), content)))
