"""Machine-readable codes: QR payloads and machine-readable zones, as Columns over strings and arrays of strings.

A parser gives a map of fields; null where the payload isn't of its kind. Payloads are columns: what
decodes them from images is an adapter (docloom.sources.adapters).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.sources.rules import DocumentRules, builtin_rules

MAP = "map<string,string>"


def _map(pairs: list[tuple[str, Column]]) -> Column:
    """A map of the pairs whose value is not null; null if there are none."""
    entries = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs)), lambda e: e["value"].isNotNull())
    return F.when(F.size(entries) > 0, F.map_from_entries(entries))


def _parts(payload: Column) -> Column:
    return F.split(F.substring_index(payload, "\x00", 1), r"\|")


def _sex(code: Column, male: str, female: str) -> Column:
    return F.when(code == male, "Nam").when(code == female, "Nữ")


def health_card(payload: Column) -> Column:
    return T.let(_parts(payload), _health_card)


def _health_card(parts: Column) -> Column:
    part = lambda i: T.pipe_field(parts, i)
    number = part(0)
    text = lambda c: F.coalesce(T.hex_to_text(c), c)
    return _map(
        [
            ("idNumber", F.when(number.rlike(r"^(?:[0-9]{10}|[A-Z]{2}[0-9]{13})\z"), number)),
            ("fullName", text(part(1))),
            ("dateOfBirth", part(2)),
            ("objectCode", part(5)),
            ("validFrom", part(6)),
            ("dateOfIssue", part(8)),
            ("fiveYearContinuous", part(12)),
            ("sex", _sex(part(3), "1", "2")),
            ("placeOfResidence", T.empty_to_null(T.hex_to_text(part(4)))),
            ("issuePlace", text(part(15))),
        ]
    )


def citizen_card(payload: Column) -> Column:
    return T.let(_parts(payload), _citizen_card)


def _citizen_card(parts: Column) -> Column:
    part = lambda i: T.pipe_field(parts, i)
    number, old = part(0), part(1)
    return _map(
        [
            ("idNumber", F.when(number.rlike(r"^[0-9]{12}\z"), number)),
            ("oldIdNumber", F.when(old.rlike(r"^[0-9]{9,12}\z"), old)),
            ("fullName", part(2)),
            ("dateOfBirth", T.ddmmyyyy(part(3))),
            ("sex", part(4)),
            ("placeOfResidence", part(5)),
            ("dateOfIssue", T.ddmmyyyy(part(6))),
        ]
    )


def party_card(payload: Column) -> Column:
    return T.let(_parts(payload), _party_card)


def _party_card(parts: Column) -> Column:
    part = lambda i: T.pipe_field(parts, i)
    day = lambda i: F.when(part(i).rlike(r"^[0-9]{8}\z"), T.ddmmyyyy(part(i)))
    fits = (F.size(parts) >= 7) & part(0).rlike(r"^(?:[0-9]{12}|[0-9]{2}\.[0-9]{6})\z") & day(2).isNotNull() & day(3).isNotNull() & day(6).isNotNull()
    found = _map([("cardNumber", part(0)), ("fullName", part(1)), ("dateOfBirth", day(2)), ("partyJoinDate", day(3)), ("officialDate", day(4)), ("dateOfIssue", day(6)), ("partyOrganization", part(5))])
    return F.when(fits, found)


#: Name -> parser of one payload; users may add theirs.
QR_PARSERS: dict[str, Callable[[Column], Column]] = {"bhyt_qr": health_card, "cccd_qr": citizen_card, "dang_vien_qr": party_card}


# ---------------------------------------------------------------- machine-readable zones


def _squeezed(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, r"(?U)\s+", ""))


def mrz_lines(texts: Column, kind: str = "td1") -> Column:
    """The first three (td1) or two (td3) lines that look like a machine-readable zone; null if there are fewer."""
    low, high, count = (25, 36, 3) if kind == "td1" else (40, 48, 2)
    fit = lambda s: F.length(s).between(low, high) & F.contains(s, F.lit("<")) & s.rlike(r"^[A-Z0-9<]+\z")
    found = F.filter(F.transform(texts, _squeezed), lambda s: F.coalesce(fit(s), F.lit(False)))
    return F.when(F.size(found) >= count, F.slice(found, 1, count))


def _line(lines: Column, i: int) -> Column:
    return _squeezed(F.get(lines, i))


def _checked(line: Column, start: int, length: int, at: int) -> Column:
    return T.check_digit(F.substring(line, start + 1, length)) == F.substring(line, at + 1, 1)


def td1_checks(lines: Column) -> Column:
    one, two = _line(lines, 0), _line(lines, 1)
    ok = (F.length(one) >= 15) & (F.length(two) >= 15) & _checked(one, 5, 9, 14) & _checked(two, 0, 6, 6) & _checked(two, 8, 6, 14)
    return F.coalesce(ok, F.lit(False))


def td3_checks(lines: Column) -> Column:
    two = _line(lines, 1)
    return F.coalesce((F.length(two) >= 28) & _checked(two, 0, 9, 9) & _checked(two, 13, 6, 19) & _checked(two, 21, 6, 27), F.lit(False))


def _zone(line: Column, start: int, length: int) -> Column:
    return T.empty_to_null(F.translate(F.substring(line, start + 1, length), "<", ""))


def td1(lines: Column) -> Column:
    one, two, three = (_line(lines, i) for i in range(3))
    enough = F.length(two) >= 15
    found = _map(
        [
            ("documentNumber", F.when(F.length(one) >= 15, _zone(one, 5, 9))),
            ("idNumber", F.when(F.length(one) >= 15, T.empty_to_null(F.regexp_extract(F.substr(one, F.lit(16)), "[0-9]{12}", 0)))),
            ("dateOfBirth", F.when(enough, T.yymmdd(F.substring(two, 1, 6)))),
            ("sex", F.when(enough, _sex(F.substring(two, 8, 1), "M", "F"))),
            ("dateOfExpiry", F.when(enough, T.yymmdd(F.substring(two, 9, 6), expiry=True))),
            ("nationality", F.when(F.substring(two, 16, 3) == "VNM", "Việt Nam")),
            ("fullName", T.empty_to_null(T.mrz_name(three))),
        ]
    )
    return F.when(F.size(lines) >= 3, found)


def td3(lines: Column) -> Column:
    two = _line(lines, 1)
    found = _map(
        [
            ("idNumber", _zone(two, 0, 9)),
            ("nationality", F.when(F.substring(two, 11, 3) == "VNM", "Việt Nam")),
            ("dateOfBirth", T.yymmdd(F.substring(two, 14, 6))),
            ("sex", _sex(F.substring(two, 21, 1), "M", "F")),
            ("dateOfExpiry", T.yymmdd(F.substring(two, 22, 6), expiry=True)),
            ("personalIdNumber", F.when(F.length(two) >= 42, _zone(two, 28, 14))),
        ]
    )
    return F.when((F.size(lines) >= 2) & (F.length(two) >= 28), found)


# ---------------------------------------------------------------- reading by the rules of types


def union_payloads(*payloads: Column) -> Column:
    """Payloads of several images of a document, each once, in order; null arrays are empty."""
    return F.array_distinct(F.concat(*(F.coalesce(p, F.array().cast("array<string>")) for p in payloads)))


def only(parsed: Column, names: Iterable[str]) -> Column:
    """The named fields of a parsed map (all if none are named) that are not empty; null if there are none."""
    names = list(names)
    kept = F.map_filter(parsed, lambda k, v: (k.isin(*names) if names else F.lit(True)) & (v != ""))
    return F.when(F.size(kept) > 0, kept)


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), 0)


def _is_of(parsed: Column, rules: DocumentRules) -> Column:
    """Whether parsed fields are of a type: its idNumber must be there and match, where the type has one."""
    number = next((f for f in rules.fields if f.name == "idNumber"), None)
    if number is None:
        return parsed.isNotNull()
    value = F.try_element_at(parsed, F.lit("idNumber"))
    return F.coalesce(T.full_match(value, number.regex) if number.pattern else value != "", F.lit(False))


def parse(payloads: Column, texts: Column, rules: Iterable[DocumentRules] | None = None) -> Column:
    """struct of what every parser that the rules name makes of a document, each run once.

    A parser of payloads has an array of maps, a machine-readable zone (td1, td3) one map, which is
    null where its check digits are wrong. Make this a column before `identify` and `read` use it.
    """
    rules = list(builtin_rules() if rules is None else rules)
    named = sorted({c.parser for r in rules for c in r.structured if c.kind == "qr" and c.parser in QR_PARSERS})
    zone = {"td1": lambda z: F.when(td1_checks(z), td1(z)), "td3": lambda z: F.when(td3_checks(z), td3(z))}
    zones = sorted({_zone_kind(c) for r in rules for c in r.structured if c.kind == "mrz"})
    found = [F.transform(payloads, QR_PARSERS[p]).alias(p) for p in named]
    found += [T.let(mrz_lines(texts, z), zone[z]).cast(MAP).alias(z) for z in zones]
    return F.struct(F.lit(0).alias("_"), *found)


def _zone_kind(code) -> str:
    return "td3" if "td3" in (code.format, code.parser.removeprefix("mrz_")) else "td1"


def _first_fit(parsed: Column, rules: DocumentRules, names: Iterable[str]) -> Column:
    return _first(F.transform(parsed, lambda m: F.when(_is_of(m, rules), only(m, names))))


def _missing_from(codes: Column, new: Column) -> Column:
    return F.map_filter(new, lambda k, v: ~F.map_contains_key(codes, k))


def identify(payloads: Column, hint: Column | None = None, rules: Iterable[DocumentRules] | None = None) -> Column:
    """struct<doc_type, codes> of the first type whose codes alone make a document up; null if none does. A hinted type is tried first."""
    rules = list(builtin_rules() if rules is None else rules)
    return T.let(parse(payloads, F.array().cast("array<string>"), rules), lambda parsed: identified(parsed, hint, rules))


def _named(doc_type: str) -> Callable[[Column], Column]:
    return lambda codes: F.when(codes.isNotNull(), F.struct(F.lit(doc_type).alias("doc_type"), codes.cast(MAP).alias("codes")))


def identified(parsed: Column, hint: Column | None, rules: Iterable[DocumentRules]) -> Column:
    """`identify` of what `parse` has made."""
    tries = []
    for r in rules:
        for c in r.structured if r.structured_complete else ():
            if c.kind == "qr" and c.parser in QR_PARSERS:
                tries.append((r.doc_type, T.let(_first_fit(parsed[c.parser], r, c.maps_to), _named(r.doc_type))))
    if not tries:
        return F.lit(None).cast(f"struct<doc_type:string,codes:{MAP}>")
    hinted = [F.when(hint == t, c) for t, c in tries] if hint is not None else []
    return F.coalesce(*hinted, *(c for _, c in tries))


def read(doc_type: Column, payloads: Column, texts: Column, rules: Iterable[DocumentRules] | None = None) -> Column:
    """struct<codes, kinds> for documents of known types: earlier codes win field by field, later ones fill gaps.

    Machine-readable zones count only if their check digits are right.
    """
    rules = list(builtin_rules() if rules is None else rules)
    return T.let(parse(payloads, texts, rules), lambda parsed: codes_of(doc_type, parsed, rules))


def _adding(new: Column, kind: str, names: Iterable[str]) -> Callable[[Column], Column]:
    """From struct<codes, kinds> to the same with what `new` has of the named fields and codes lacks."""

    def added(s: Column) -> Column:
        gaps = _missing_from(s["codes"], F.coalesce(only(new, names), F.create_map().cast(MAP)))
        kinds = lambda g: F.when((F.size(g) > 0) & ~F.array_contains(s["kinds"], kind), F.concat(s["kinds"], F.array(F.lit(kind)))).otherwise(s["kinds"])
        return T.let(gaps, lambda g: F.struct(F.map_concat(s["codes"], g).alias("codes"), kinds(g).alias("kinds")))

    return added


def codes_of(doc_type: Column, parsed: Column, rules: Iterable[DocumentRules]) -> Column:
    """`read` of what `parse` has made."""
    out = F.struct(F.create_map().cast(MAP).alias("codes"), F.array().cast("array<string>").alias("kinds"))
    for r in rules:
        if not r.structured:
            continue
        state = F.struct(F.create_map().cast(MAP).alias("codes"), F.array().cast("array<string>").alias("kinds"))
        for c in r.structured:
            if c.kind == "qr" and c.parser in QR_PARSERS:
                mine = _first(parsed[c.parser])
            elif c.kind == "mrz":
                mine = parsed[_zone_kind(c)]
            else:
                continue

            state = T.let(state, _adding(mine, c.kind, c.maps_to))
        out = F.when(doc_type == r.doc_type, state).otherwise(out)
    return out


def merge_first_wins(maps: Iterable[Column]) -> Column:
    """One map of several; the first that has a key decides its value."""
    return reduce(lambda a, b: F.map_concat(a, _missing_from(a, b)), maps)
