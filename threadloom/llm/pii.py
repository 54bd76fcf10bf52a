"""Pseudonyms that keep the format of personal numbers, addresses and dates.

Values are found by one pattern, validated by kind (check digits, ranges, real
dates) and replaced by what a keyed Feistel network makes of them within their
format. The network is a permutation, so different values stay different, and the
same value gets the same pseudonym in every document. Everything is Spark SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of each Feistel network.
ROUNDS = 8
#: Fixed patterns, by kind, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9])\+?1?[ .-]?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9])\+[1-9][0-9]{0,2}(?:[ .-][0-9]{2,4}){2,4}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A date's first day and the days of the Gregorian cycle from it, as a product.
EPOCH, CYCLE = "1700-01-01", (189, 773)


def _number(key: str, round_: str, half: str, place: str) -> str:
    """SQL for a pseudo-random number from the key, the round, half of the value and a place in the other half.

    One digest serves 32 places, so that long values take one for each 32.
    """
    digest = f"sha2(concat_ws('|', '{key}', {round_}, {half}, {place} div 8), 256)"
    return f"cast(conv(substr({digest}, 8 * ({place} % 8) + 1, 7), 16, 10) as bigint)"


def _feistel_text(value: str, key: str) -> str:
    """SQL that permutes a string within its format: digits stay digits, letters stay letters of their case.

    The string's positions are dealt to two halves, odd and even; in turn, each
    character of one half is moved within its class by an amount that the other half decides.
    """
    move = (
        "CASE WHEN c RLIKE '[0-9]' THEN chr(48 + (ascii(c) - 48 + {n}) % 10) "
        "WHEN c RLIKE '[a-z]' THEN chr(97 + (ascii(c) - 97 + {n}) % 26) "
        "WHEN c RLIKE '[A-Z]' THEN chr(65 + (ascii(c) - 65 + {n}) % 26) ELSE c END"
    ).format(n=_number(key, "r", "array_join(filter(s, (x, k) -> k % 2 <> r % 2), '')", "cast(i as int)"))
    step = f"transform(s, (c, i) -> CASE WHEN i % 2 <> r % 2 THEN c ELSE {move} END)"
    return f"array_join(aggregate(sequence(1, {ROUNDS}), split({value}, ''), (s, r) -> {step}), '')"


def _feistel_number(value: str, a: int, b: int, key: str) -> str:
    """SQL that permutes the numbers below a * b: each part of (value div b, value mod b) is moved by the other."""
    left = f"struct((s.x + {_number(key, 'r', 's.y', '0')}) % {a} AS x, s.y AS y)"
    right = f"struct(s.x AS x, (s.y + {_number(key, 'r', 's.x', '0')}) % {b} AS y)"
    state = f"struct(cast({value} div {b} as bigint) AS x, cast({value} % {b} as bigint) AS y)"
    return (
        f"aggregate(sequence(1, {ROUNDS}), {state}, (s, r) -> CASE WHEN r % 2 = 1 THEN {left} ELSE {right} END, "
        f"s -> s.x * {b} + s.y)"
    )


def _let(value: str, name: str, body: str) -> str:
    """SQL that names a value for the body."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _luhn(digits: str) -> str:
    """SQL for the Luhn sum, modulo 10, of a string of digits; the last is the check digit."""
    weigh = "CASE WHEN k % 2 = 0 THEN cast(d as int) ELSE (2 * cast(d as int)) div 10 + (2 * cast(d as int)) % 10 END"
    return f"(aggregate(transform(reverse(split({digits}, '')), (d, k) -> {weigh}), 0L, (x, y) -> x + y) % 10)"


def _by_kind(m: str, key: str) -> dict[str, str]:
    """SQL for the pseudonym of a match of each kind; null where the value isn't valid."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    # the new digits take the places of the old ones, one after another
    refill = (
        f"array_join(transform(split({m}, ''), (c, i) -> CASE WHEN c RLIKE '[0-9]' THEN "
        f"substr(n, length(regexp_replace(substr({m}, 1, cast(i as int) + 1), '[^0-9]', '')), 1) ELSE c END), '')"
    )
    address = f"aggregate(split({m}, '[.]'), 0L, (x, o) -> x * 256 + cast(o as bigint))"
    new_address = _let(
        _feistel_number(address, 65536, 65536, f"{key}/ipv4"), "n",
        "concat_ws('.', n div 16777216, (n div 65536) % 256, (n div 256) % 256, n % 256)",
    )
    iso = f"CASE WHEN {m} RLIKE '^[0-9]{{4}}' THEN {m} ELSE concat(substr({m}, 7, 4), '-', substr({m}, 4, 2), '-', substr({m}, 1, 2)) END"
    cycle = CYCLE[0] * CYCLE[1]
    day = f"datediff(d, date'{EPOCH}')"
    new_day = f"date_add(date'{EPOCH}', cast({_feistel_number(day, *CYCLE, f'{key}/date')} as int))"
    shown = f"CASE WHEN {m} RLIKE '^[0-9]{{4}}' THEN date_format(e, 'yyyy-MM-dd') ELSE concat(date_format(e, 'dd'), substr({m}, 3, 1), date_format(e, 'MM'), substr({m}, 6, 1), date_format(e, 'yyyy')) END"
    date = _let(
        f"try_cast({iso} AS date)", "d",
        f"CASE WHEN d IS NOT NULL AND {day} BETWEEN 0 AND {cycle - 1} THEN {_let(new_day, 'e', shown)} END",
    )
    # a card keeps its first digit, which names its kind, and gets the check digit of its other digits
    inner = _feistel_text("substr(d, 2, length(d) - 2)", f"{key}/card")
    check = f"concat(p, (10 - {_luhn("concat(p, '0')")}) % 10)"
    card = _let(digits, "d", f"CASE WHEN {_luhn('d')} = 0 AND length(d) BETWEEN 13 AND 19 THEN {_let(f'concat(substr(d, 1, 1), {inner})', 'p', _let(check, 'n', refill))} END")
    # a subscriber's number changes, the country code stays
    code = f"CASE WHEN {m} RLIKE '^[+]' THEN length(regexp_extract({m}, '^[+]([0-9]{{1,3}})', 1)) WHEN length({digits}) = 11 THEN 1 ELSE 0 END"
    phone = _let(
        digits, "d",
        f"CASE WHEN length(d) BETWEEN 7 AND 15 THEN {_let(code, 'k', _let(f"concat(substr(d, 1, k), {_feistel_text('substr(d, k + 1)', f'{key}/phone')})", 'n', refill))} END",
    )
    ssn = f"CASE WHEN {m} NOT RLIKE '^(000|666|9)' AND {m} NOT RLIKE '-00-|-0000$' THEN {_let(_feistel_text(digits, f'{key}/ssn'), 'n', refill)} END"
    moved = f"concat(substr({m}, 5), substr({m}, 1, 4))"
    rest = f"aggregate(split({moved}, ''), 0, (x, c) -> CASE WHEN c RLIKE '[0-9]' THEN (x * 10 + cast(c as int)) % 97 ELSE (x * 100 + ascii(c) - 55) % 97 END)"
    bank = _feistel_text(f"substr({m}, 5)", f"{key}/iban")
    of_zero = "aggregate(split(concat(b, c2, '00'), ''), 0, (x, c) -> CASE WHEN c RLIKE '[0-9]' THEN (x * 10 + cast(c as int)) % 97 ELSE (x * 100 + ascii(c) - 55) % 97 END)"
    iban = f"CASE WHEN {rest} = 1 THEN {_let(bank, 'b', _let(f'substr({m}, 1, 2)', 'c2', f"concat(c2, lpad(98 - {of_zero}, 2, '0'), b)"))} END"
    # the domain of an address stays, as far as it names no person
    email = f"concat({_feistel_text(f"lower(substring_index({m}, '@', 1))", f'{key}/email')}, '@', substring_index({m}, '@', -1))"
    return {
        "email": email,
        "ipv4": f"CASE WHEN forall(split({m}, '[.]'), o -> cast(o as int) < 256 AND o RLIKE '^(0|[1-9])') THEN {new_address} END",
        "date": date, "ssn": ssn, "phone": phone, "iban": iban, "card": card,
    }


def _kind(m: str) -> str:
    anchored = " ".join(f"WHEN {m} RLIKE r'^(?:{p})$' THEN '{k}'" for k, p in PATTERNS.items())
    return f"CASE {anchored} END"


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs(doc_id, text, ...)`` with pseudonyms in ``text``, and what was found in ``pii``.

    pii is an array of (kind, start, length, pseudonym), start in characters of the
    original text; it is empty for texts without valid values and for null or empty
    ones, which stay as they are. Values that fail validation stay. An existing column
    pii is replaced, all others are kept; repeated rows are treated alike.

    The replacement is a permutation for each kind: an IPv4 address in 32 bits, a date
    in its 400-year cycle, cards and IBANs under a new check digit, other values
    character by character. Equal values written in different case (e-mail) or
    punctuation (numbers) get the same new value in their own punctuation.
    """
    if "'" in key or "\\" in key:
        raise ValueError("the key must not hold quotes or backslashes")
    branches = " ".join(f"WHEN '{k}' THEN {sql}" for k, sql in _by_kind("m", key).items())
    found = docs.drop("pii").withColumn(
        "_matches",
        F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")),
    )
    found = found.withColumn("_matches", F.coalesce("_matches", F.array().cast("array<string>")))
    some = F.size("_matches") > 0
    found = found.withColumn("_between", F.when(some, F.split("text", ANY)))
    changed = f"transform(_matches, m -> struct({_kind('m')} AS kind, m AS old, CASE {_kind('m')} {branches} END AS new))"
    found = found.withColumn("_changed", F.when(some, F.expr(changed)))
    # where each match starts: after the pieces and matches before it
    starts = """
        transform(sequence(0, size(_matches) - 1), i ->
            aggregate(slice(_between, 1, i + 1), 0, (x, t) -> x + length(t)) + aggregate(slice(_matches, 1, i), 0, (x, t) -> x + length(t)))
    """
    found = found.withColumn("_starts", F.when(some, F.expr(starts)))
    text = "concat(array_join(zip_with(slice(_between, 1, size(_changed)), _changed, (t, c) -> concat(t, coalesce(c.new, c.old))), ''), element_at(_between, -1))"
    pii = """
        filter(zip_with(_changed, _starts, (c, s) -> struct(c.kind AS kind, s AS start, length(c.old) AS length, c.new AS pseudonym)), f -> f.pseudonym IS NOT NULL)
    """
    none = "cast(array() AS array<struct<kind: string, start: int, length: int, pseudonym: string>>)"
    done = found.withColumn("text", F.when(some, F.expr(text)).otherwise(F.col("text"))).withColumn(
        "pii", F.when(some, F.expr(pii)).otherwise(F.expr(none))
    )
    return done.drop("_matches", "_between", "_changed", "_starts")


def is_private(pii: Column) -> Column:
    """Whether anything was found."""
    return F.size(pii) > 0
