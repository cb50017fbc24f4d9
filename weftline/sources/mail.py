"""Filters over a table of messages (uid, from, to, cc, subject, date, body, has_attachment)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import usable_pattern


def mail_events(
    messages: DataFrame, last_uid: int = 0, from_address: str | None = None, to_address: str | None = None,
    subject: str | None = None, cc: list[str] | None = None, has_attachment: bool | None = None,
) -> DataFrame:
    """Messages past a uid that pass every filter given; addresses compare without case; a bad pattern rejects all.

    ``from``, ``to`` and ``cc`` are arrays of addresses.
    """
    out = messages.where(F.col("uid") > last_uid)
    for name, address in (("from", from_address), ("to", to_address)):
        if address:
            low = address.lower()
            out = out.where(F.coalesce(F.exists(F.col(f"`{name}`"), lambda x: F.lower(x) == low), F.lit(False)))
    if subject:
        pattern = usable_pattern(subject)
        out = out.where(F.lit(False) if pattern is None else F.coalesce(F.col("subject").rlike(pattern), F.lit(False)))
    if cc:
        wanted = F.array(*[F.lit(a.lower()) for a in cc])
        out = out.where(F.coalesce(F.arrays_overlap(F.transform("cc", F.lower), wanted), F.lit(False)))
    if has_attachment is not None:
        out = out.where(F.col("has_attachment") == has_attachment)
    return out
