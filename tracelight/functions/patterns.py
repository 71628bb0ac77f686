"""Value predicates, field-name context and confidence as Spark SQL expressions.

A value is tested in the JVM, in the same stage as its scan, without a join, a shuffle or Python.
The functions take SQL fragments (a column name, a lambda variable) and return SQL text: parsing
one text is far cheaper on the driver than building hundreds of Column objects one by one.
"""

from __future__ import annotations

from tracelight.schemas import PRIORITY

# The fifteen value patterns in detection order (search semantics, ASCII classes).
VALUE_PATTERNS = {
    "SSN": r"^\d{3}-\d{2}-\d{4}$|^\d{9}$",
    "EMAIL": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "PHONE_NUMBER": r"(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}|\+?\d{10,15}",
    "CREDIT_CARD": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "IP_ADDRESS": r"\b(?:\d{1,3}\.){3}\d{1,3}\b|\b([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b",
    "DATE_OF_BIRTH": (
        r"\b(0[1-9]|1[0-2])[-/](0[1-9]|[12]\d|3[01])[-/](19|20)\d{2}\b"
        r"|\b(19|20)\d{2}[-/](0[1-9]|1[0-2])[-/](0[1-9]|[12]\d|3[01])\b"
    ),
    "NAME": r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+$",
    "BANK_ACCOUNT": r"^\d{8,17}$",
    "IBAN": r"^[A-Z]{2}\d{2}[A-Z0-9]{4,30}$",
    "SWIFT_CODE": r"^[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}([A-Z0-9]{3})?$",
    "AWS_ACCESS_KEY": r"^AKIA[0-9A-Z]{16}$",
    "AWS_SECRET_KEY": r"^[A-Za-z0-9/+=]{40}$",
    "ITIN": r"^9\d{2}[78]\d{5}$",
    "NATIONAL_INSURANCE_NUMBER": r"^[A-Z]{2}\d{6}[A-Z]?$",
    "MAC_ADDRESS": r"^([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})$",
}

# Words looked for anywhere in the lower-cased field path.
TIME_WORDS = [
    "time", "timestamp", "created_at", "updated_at", "modified_at",
    "event_time", "logged_at", "occurred_at",
]
PLATE_WORDS = ["license_plate", "licenseplate", "plate", "vehicle_plate", "registration_plate"]
CARD_WORDS = ["card", "credit", "cc", "payment"]
DATE_WORDS = ["date", "birth", "dob", "age"]
ID_WORDS = [
    "id", "identifier", "vehicle_id", "customer_id", "user_id",
    "account_id", "order_id", "product_id", "transaction_id",
]
NAME_INDICATORS = [
    "first_name", "firstname", "last_name", "lastname", "full_name", "fullname",
    "person_name", "customer_name", "cardholder_name", "account_name", "user_name",
    "driver_name", "passenger_name", "employee_name", "contact_name",
]

# Fixed values: (confidence, alternatives); every word of one alternative must be in the path.
PATH_BOOSTS = {
    "SSN": (0.95, [["ssn"]]),
    "EMAIL": (0.95, [["email"], ["mail"]]),
    "PHONE_NUMBER": (0.95, [["phone"], ["tel"]]),
    "IP_ADDRESS": (0.95, [["ip"]]),
    "DATE_OF_BIRTH": (0.90, [["dob"], ["birth"]]),
    "BANK_ACCOUNT": (0.95, [["bank"], ["account"], ["routing"]]),
    "IBAN": (0.95, [["iban"]]),
    "SWIFT_CODE": (0.95, [["swift"], ["bic"]]),
    "AWS_ACCESS_KEY": (0.95, [["aws", "access", "key"]]),
    "AWS_SECRET_KEY": (0.95, [["aws", "secret"]]),
    "ITIN": (0.95, [["itin"]]),
    "NATIONAL_INSURANCE_NUMBER": (0.95, [["national", "insurance"], ["ni_number"], ["nino"]]),
    "MAC_ADDRESS": (0.90, [["mac", "address"]]),
}
BASE_CONFIDENCE = 0.70
HINT_CONFIDENCE = 0.85

SUPPORTED_TYPES = list(VALUE_PATTERNS)

# Position of a finding in the list of one value: the patterns, then the two field-name hints.
DETECTION_ORDER = {t: i for i, t in enumerate([*VALUE_PATTERNS, "NAME_HINT", "ADDRESS"])}

_STRIP = r"' \t\n\r\u000B\u000C'"


def strip(value: str) -> str:
    """Value without leading and trailing ASCII white space."""
    return f"btrim({value}, {_STRIP})"


def matches(value: str, pattern: str) -> str:
    """True where a part of the value matches."""
    return f"rlike({value}, r'{pattern}')"


def path_has(path: str, words: list[str]) -> str:
    """True where the lower-cased path contains any of the words."""
    return matches(f"lower({path})", "|".join(words))


def _all_of(path: str, alternatives: list[list[str]]) -> str:
    every = [" and ".join(f"contains(lower({path}), '{w}')" for w in words) for words in alternatives]
    return " or ".join(f"({e})" for e in every)


# A cheap condition every match of the type meets; saves the regex on most values.
_SHAPES = {
    "SSN": "length({v}) in (9, 11)",
    "EMAIL": "contains({v}, '@')",
    "PHONE_NUMBER": r"length({v}) >= 10 and rlike({v}, r'\d{{3}}[-.\s]?\d{{4}}')",
    "CREDIT_CARD": "length({v}) >= 16",
    "IP_ADDRESS": (
        "(contains({v}, '.') and length({v}) - length(replace({v}, '.', '')) >= 3 "
        "or contains({v}, ':') and length({v}) - length(replace({v}, ':', '')) >= 7)"
    ),
    "DATE_OF_BIRTH": "length({v}) >= 10 and (contains({v}, '-') or contains({v}, '/'))",
    "NAME": "length({v}) >= 5",
    "BANK_ACCOUNT": "length({v}) between 8 and 17",
    "IBAN": "length({v}) between 8 and 34",
    "SWIFT_CODE": "length({v}) in (8, 11)",
    "AWS_ACCESS_KEY": "length({v}) = 20",
    "AWS_SECRET_KEY": "length({v}) = 40",
    "ITIN": "length({v}) = 9",
    "NATIONAL_INSURANCE_NUMBER": "length({v}) in (8, 9)",
    "MAC_ADDRESS": "length({v}) = 17",
}


# The patterns that may match inside a value; all others only match a whole value.
_INNER = ["PHONE_NUMBER", "CREDIT_CARD", "IP_ADDRESS", "DATE_OF_BIRTH"]


def may_hold_pii(path: str, value: str) -> str:
    """Necessary condition for a finding on a stripped value: a few short regexes, all codegen.

    The first regex drops most prose words in one scan: every pattern needs a digit, ``@`` or
    ``:``, except names (capitalised word then space), SWIFT codes and keys (six capitals),
    40-letter keys and hyphenated MAC addresses of letters; the shortest match (a name) has five
    characters. Then come all whole-value patterns as one alternation, tried at the first position
    only, and the four inner patterns behind their shapes. So the array of findings is built only for values
    that have any.
    """
    shape = matches(value, r"[0-9@:]|^[A-Z]{6}|^[A-Z][a-z]+\s")
    candidate = f"length({value}) >= 5 and ({shape} or length({value}) in (17, 40))"
    whole = matches(value, "^(?:" + "|".join(p for t, p in VALUE_PATTERNS.items() if t not in _INNER) + ")")
    inner = " or ".join(pattern_test(t, value) for t in _INNER)
    found = f"{candidate} and ({whole} or {inner})"
    return f"({found}) or {_name_hint(path, value)} or {_address_hint(path, value)}"


def _name_hint(path: str, value: str) -> str:
    # Every indicator holds "name", so most paths are settled by one substring test.
    named = matches(f"replace(lower({path}), '-', '_')", "|".join(NAME_INDICATORS))
    letter = matches(value, r"\p{L}")
    return f"(contains(lower({path}), 'name') and {named} and length({value}) >= 2 and {letter})"


def _address_hint(path: str, value: str) -> str:
    # "address" is part of every other address indicator.
    digits = matches(value, "^[0-9]+$")
    return f"(contains(lower({path}), 'address') and length({value}) >= 5 and not {digits})"


def luhn_ok(text: str) -> str:
    """Luhn check of a card match after dropping hyphens and blanks."""
    return f"luhn_check(translate({text}, '- ', ''))"


def unlikely_ssn(text: str) -> str:
    """Numbers never given out, and the textbook example."""
    digits = f"replace({text}, '-', '')"
    return f"(startswith({digits}, '000') or startswith({digits}, '666') or {digits} = '123456789')"


def confidence(pii_type: str, path: str, value: str, matched: str) -> str:
    """Confidence of a pattern match, from the field path and the match itself."""
    if pii_type == "CREDIT_CARD":
        return f"if({luhn_ok(matched)}, 0.95D, 0.50D)"
    if pii_type == "NAME":
        short = f"size(split({value}, r'\\s+')) <= 5"
        named = f"contains(lower({path}), 'name')"
        return f"if({named}, if({short}, 0.90D, 0.70D), if({short}, 0.50D, 0.30D))"
    boost, alternatives = PATH_BOOSTS[pii_type]
    score = f"if({_all_of(path, alternatives)}, {boost}D, {BASE_CONFIDENCE}D)"
    if pii_type == "SSN":
        score = f"if({unlikely_ssn(matched)}, 0.30D, {score})"
    return score


def pattern_test(pii_type: str, value: str) -> str:
    """True where the stripped value matches the type's pattern."""
    return f"({_SHAPES[pii_type].format(v=value)} and {matches(value, VALUE_PATTERNS[pii_type])})"


def _accepted(pii_type: str, path: str, value: str) -> str:
    """The pattern matches, and not on a field path where that counts as no finding at all."""
    test = pattern_test(pii_type, value)
    if pii_type == "PHONE_NUMBER":
        return f"({test} and not {path_has(path, TIME_WORDS)})"
    if pii_type == "NAME":
        return f"({test} and not {path_has(path, PLATE_WORDS)})"
    return test


def _hit(order: str, pii_type: str, score: str, matched: str) -> str:
    return (
        f"named_struct('seq', {DETECTION_ORDER[order]}, 'pii_type', '{pii_type}', 'confidence', {score}, "
        f"'priority', {PRIORITY.get(pii_type, 0)}, 'pattern_matched', {matched}, 'provider', 'pattern')"
    )


def pattern_hits(path: str, value: str) -> str:
    """All raw findings of a stripped value as one array of structs, in detection order."""
    hits = []
    for pii_type, pattern in VALUE_PATTERNS.items():
        matched = f"regexp_extract({value}, r'{pattern}', 0)"
        hit = _hit(pii_type, pii_type, confidence(pii_type, path, value, matched), matched)
        hits.append(f"if({_accepted(pii_type, path, value)}, {hit}, null)")
    hint = f"concat('field_name_hint:', {path})"
    name_hint = f"{_name_hint(path, value)} and not {_accepted('NAME', path, value)}"
    hits.append(f"if({name_hint}, {_hit('NAME_HINT', 'NAME', f'{HINT_CONFIDENCE}D', hint)}, null)")
    address = _hit("ADDRESS", "ADDRESS", f"{HINT_CONFIDENCE}D", hint)
    hits.append(f"if({_address_hint(path, value)}, {address}, null)")
    return f"array_compact(array({', '.join(hits)}))"
