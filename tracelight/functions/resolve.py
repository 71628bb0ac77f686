"""Conflict rules between the findings of one value, as Spark SQL array expressions.

All findings of one (field, value) sit in one small array, at most one entry per type and
provider, so the rules need no self-join. Each rule looks at the complete array, not at what
other rules have left over.
"""

from __future__ import annotations

from tracelight.functions.patterns import (
    CARD_WORDS,
    DATE_WORDS,
    ID_WORDS,
    PLATE_WORDS,
    TIME_WORDS,
    matches,
    path_has,
)


def resolve(hits: str, path: str, field_value: str, value: str) -> str:
    """Findings that survive the conflict rules.

    ``field_value`` is the whole stripped field, ``value`` the text the findings share; they
    differ only for providers that report spans.
    """
    on_card, on_time = path_has(path, CARD_WORDS), path_has(path, TIME_WORDS)
    epoch = matches(field_value, r"^[0-9]{10,13}(\.[0-9]+)?$")
    numeric = f"({matches(field_value, '^[0-9]+$')} or {matches(value, '^[0-9]+$')})"
    has_card = f"exists({hits}, c -> c.pii_type = 'CREDIT_CARD')"
    # The strongest rival of another type; among equal priorities the earliest finding.
    top = (
        f"array_max(transform(filter({hits}, r -> r.pii_type <> h.pii_type), "
        "r -> named_struct('priority', r.priority, 'earliest', -r.seq, 'confidence', r.confidence)))"
    )
    return f"""filter({hits}, h -> not (
        case h.pii_type
            when 'PHONE_NUMBER' then ({on_time} and {epoch}) or {has_card}
            when 'DATE_OF_BIRTH' then
                {on_time} or ({path_has(path, ID_WORDS)} and {numeric}) or {has_card} or {on_card}
            when 'CREDIT_CARD' then
                h.confidence < 0.8D and {path_has(path, DATE_WORDS)} and not {on_card}
            when 'DRIVER_LICENSE' then {path_has(path, PLATE_WORDS)}
            when 'NAME' then {path_has(path, PLATE_WORDS)}
            when 'ADDRESS' then {path_has(path, PLATE_WORDS)}
            else false
        end
        or coalesce(exists(array({top}), t -> t.priority > h.priority and t.confidence >= h.confidence), false)
    ))"""


def keep_types(hits: str, enabled: list[str]) -> str:
    """Findings of the enabled types; runs last, so a disabled type can still suppress others."""
    names = ", ".join(f"'{t}'" for t in enabled)
    return f"filter({hits}, e -> e.pii_type in ({names}))" if enabled else f"filter({hits}, e -> false)"
