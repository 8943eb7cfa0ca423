"""Scalar functions as Column builders; only hashing, clipping and per-row masking need Arrow batches."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed: letters and numbers of any script make a word.
WORD_CHARS = r"\p{IsAlphabetic}\p{N}"
NOT_WORD = rf"[^{WORD_CHARS}]+"
HIDDEN_TEXT = "[forgotten]"
RRF_CONSTANT = 60
SCOPE = ["space_id", "tenant_id", "user_id", "agent_id", "project_id", "thread_id"]
STATE_PRIORITY = {"tombstone": 0, "unsupported": 1, "derived": 2, "current": 3, "set": 4, "rule": 5}
SUPPORT_PRIORITY = {"deleted": 0, "unsupported": 1, "supported": 2, "no_evidence": 3}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def canonical_part(x: Column | str) -> Column:
    """Lower-cased runs of letters and digits joined by one space."""
    return F.trim(F.regexp_replace(F.lower(_c(x)), NOT_WORD, " "))


def lexical_terms(x: Column | str) -> Column:
    """The words of a text, in order, with repeats."""
    return F.filter(F.split(F.lower(F.coalesce(_c(x), F.lit(""))), NOT_WORD), lambda t: t != "")


def usable_term(t: Column) -> Column:
    return (F.length(t) >= 2) | (F.octet_length(t) != F.length(t))


def phrase_present(query: Column, phrase: Column) -> Column:
    """Whether a normalised query contains a phrase as whole words; a phrase beyond ASCII also as a substring."""
    spaced = F.concat(F.lit(" "), query, F.lit(" ")).contains(F.concat(F.lit(" "), phrase, F.lit(" ")))
    return (phrase != "") & (spaced | ((F.octet_length(phrase) != F.length(phrase)) & query.contains(phrase)))


def state_overlap(query: str, fields: list[Column]) -> Column:
    """4 for each field that the query contains as a phrase, 1 for each usable word of a field among the query's words."""
    import re

    words = sorted({w for w in re.split(r"[\W_]+", query.lower()) if w})
    normal = F.lit(" ".join(w for w in re.split(r"[\W_]+", query.lower()) if w))
    terms = F.array(*[F.lit(w) for w in words if len(w) >= 2 or not w.isascii()]) if words else F.array().cast("array<string>")
    parts = []
    for f in fields:
        f = F.coalesce(f, F.lit(""))
        parts.append(F.when(phrase_present(normal, canonical_part(f)), 4).otherwise(0))
        parts.append(F.size(F.filter(lexical_terms(f), lambda t: usable_term(t) & F.array_contains(terms, t))))
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def fnv1a64(parts: list[str | None]) -> str:
    """64-bit FNV-1a over the parts' UTF-8 bytes with a 0xff step after each part, as 16 hex digits. A null is skipped."""
    h = 0xCBF29CE484222325
    for part in parts:
        for b in (part or "").encode():
            h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        h = ((h ^ 0xFF) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def stable_hash(*cols: Column | str) -> Column:
    """fnv1a64 of columns, Arrow-batched; a null counts as the empty text."""
    udf = F.pandas_udf(T.StringType())(_hash_rows)
    return udf(F.struct(*[F.coalesce(_c(c).cast("string"), F.lit("")).alias(f"p{i}") for i, c in enumerate(cols)]))


def _hash_rows(rows: pd.DataFrame) -> pd.Series:
    return pd.Series([fnv1a64(list(row)) for row in rows.itertuples(index=False, name=None)], dtype=object)


def slot_id(entity: Column, subject_key: Column, predicate_key: Column) -> Column:
    return F.concat(F.lit("slot_"), stable_hash(F.coalesce(entity, subject_key), predicate_key))


def generated_id(kind: str, space: str, parts: list[str], narrower: list[str | None] | None = None) -> str:
    """kind_ and the hash of space, parts and, if any narrower id is set, the hash of those."""
    more = []
    if narrower and any(x is not None for x in narrower):
        more = [fnv1a64([("=" + x) if x is not None else "" for x in narrower])]
    return f"{kind}_{fnv1a64([space, *parts, *more])}"


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def neighbor_score(score: Column, distance: Column) -> Column:
    return score / (1 + F.abs(distance))


def estimate_tokens(x: Column | str) -> Column:
    """The most of the words, a quarter of the characters (rounded up) and one."""
    words = F.size(F.filter(F.split(_c(x), r"\s+"), lambda t: t != ""))
    return F.greatest(words, F.ceil(F.length(_c(x)) / 4).cast("int"), F.lit(1))


def estimate_tokens_py(text: str) -> int:
    return max(len(text.split()), -(-len(text) // 4), 1)


def clip_to_budget(text: str, budget: int) -> str:
    """Whole words while the estimate stays within the budget."""
    out = ""
    for word in text.split():
        longer = f"{out} {word}" if out else word
        if estimate_tokens_py(longer) > budget:
            break
        out = longer
    return out


def utc_minute(ms: Column | str) -> Column:
    """`YYYY-MM-DD HH:MMZ (ms)`, empty for null."""
    m = _c(ms)
    return F.when(m.isNull(), "").otherwise(F.concat(F.date_format(F.timestamp_millis(m), "yyyy-MM-dd HH:mm'Z'"), F.lit(" ("), m.cast("string"), F.lit(")")))


def mask_pattern(values: list[str]) -> str | None:
    """A pattern of whole words, the longest first; values are trimmed and lower-cased, and of three characters at least."""
    import re

    kept = sorted({v.strip().lower() for v in values if len(v.strip()) >= 3}, key=lambda v: (-len(v), v))
    if not kept:
        return None
    word = r"[\p{IsAlphabetic}\p{N}]"
    return rf"(?<!{word})(?iu:{'|'.join(re.escape(v) for v in kept)})(?!{word})"


def mask_values(x: Column | str, values: list[str]) -> Column:
    pattern = mask_pattern(values)
    return _c(x) if pattern is None else F.regexp_replace(_c(x), pattern, HIDDEN_TEXT.replace("[", r"\[").replace("]", r"\]"))


def selector_match(selector: Column, *texts: Column) -> Column:
    """A trimmed, lower-cased selector is a substring of any text; an empty one of none."""
    s = F.lower(F.trim(selector))
    return (s != "") & reduce(lambda a, b: a | b, [F.coalesce(F.lower(t).contains(s), F.lit(False)) for t in texts])


def template_value(value: Column, template: Column, trigger_value: Column, subject: Column, predicate: Column) -> Column:
    filled = template
    for name, col in (("{value}", trigger_value), ("{object_value}", trigger_value), ("{subject}", subject), ("{predicate}", predicate)):
        filled = F.replace(filled, F.lit(name), F.coalesce(col, F.lit("")))
    return F.coalesce(value, filled, trigger_value)


def after(ms: Column, seq: Column, boundary_ms: Column, boundary_seq: Column) -> Column:
    """Later, or at the same time with both sequence numbers given and the greater one."""
    return (ms > boundary_ms) | ((ms == boundary_ms) & F.coalesce(seq > boundary_seq, F.lit(False)))


def rrf_share(rank0: Column, weight: float = 1.0) -> Column:
    return F.lit(float(weight)) / (F.lit(RRF_CONSTANT) + rank0 + 1)


def matched_terms(terms: list[str], text: Column) -> Column:
    """How many of the query's words are substrings of a text."""
    return reduce(lambda a, b: a + b, [F.when(F.lower(text).contains(t), 1).otherwise(0) for t in terms], F.lit(0))


def state_kind(status: Column, polarity: Column, asserted_by: Column, claim_kind: Column) -> Column:
    return (
        F.when(status.isin("retracted", "tombstoned", "redacted"), "tombstone")
        .when((status != "active") | (polarity != "affirmative"), "unsupported")
        .when(asserted_by == "extractor_derived", "derived")
        .when(claim_kind == "constraint", "rule")
        .otherwise("current")
    )


def state_priority(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in STATE_PRIORITY.items() for x in kv]), kind)


def support_priority(state: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SUPPORT_PRIORITY.items() for x in kv]), state)


def state_text(**fields: Column) -> Column:
    """A JSON object with its keys in alphabetical order, nulls included."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def to_millis(value: object) -> int | None:
    """milliseconds from a number, a datetime (UTC if it names no zone) or an RFC 3339 text."""
    from datetime import datetime, timezone

    if value is None or isinstance(value, int):
        return value
    if isinstance(value, float):
        return int(value)
    at = value if isinstance(value, datetime) else datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)
