"""A first schema drafted from column names and types."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame

from kithlink.plans.schema import Column, Comparison, Level, Schema, SchemaError, Source
from kithlink.sources.store import column_type

#: The names that mean each role.
NAMES = {
    "id": [
        "id",
        "unique_id",
        "uid",
        "record_id",
        "rec_id",
        "row_id",
        "rowid",
        "recid",
        "index",
        "row_number",
        "rownum",
    ],
    "first_name": [
        "first_name",
        "firstname",
        "first_names",
        "fname",
        "first",
        "given_name",
        "givenname",
        "given_names",
        "given",
        "forename",
        "forenames",
        "name_first",
        "prenom",
    ],
    "middle_name": [
        "middle_name",
        "middlename",
        "middle",
        "middle_initial",
        "mname",
        "second_name",
    ],
    "surname": [
        "surname",
        "surnames",
        "last_name",
        "lastname",
        "lname",
        "last",
        "family_name",
        "familyname",
        "name_last",
        "nom",
    ],
    "full_name": [
        "name",
        "full_name",
        "fullname",
        "person_name",
        "display_name",
        "first_and_surname",
        "forename_surname",
    ],
    "gender": [
        "gender",
        "sex",
    ],
    "birth_date": [
        "dob",
        "date_of_birth",
        "birth_date",
        "birthdate",
        "birthday",
        "born",
    ],
    "date": [
        "date",
    ],
    "email": [
        "email",
        "e_mail",
        "mail",
        "email_address",
        "emailaddress",
    ],
    "phone": [
        "phone",
        "telephone",
        "phone_number",
        "phonenumber",
        "tel",
        "mobile",
        "mobile_number",
        "cell",
        "cellphone",
        "cell_phone",
        "fax",
    ],
    "postcode": [
        "postcode",
        "post_code",
        "postal_code",
        "postalcode",
        "zip",
        "zipcode",
        "zip_code",
        "pincode",
        "pin_code",
    ],
    "address": [
        "address",
        "addr",
        "street",
        "street_address",
        "street_name",
        "address_line",
        "address_1",
        "address1",
        "address_tokens",
    ],
    "city": [
        "city",
        "town",
        "suburb",
        "locality",
        "municipality",
    ],
    "region": [
        "state",
        "county",
        "province",
        "region",
        "territory",
    ],
    "country": [
        "country",
        "nation",
        "country_code",
    ],
    "national_id": [
        "ssn",
        "soc_sec_id",
        "social_security_number",
        "nino",
        "ni_number",
        "national_id",
        "national_insurance_number",
        "nhs_number",
        "passport",
        "passport_number",
        "tax_id",
        "tin",
        "sin",
        "driver_licence",
        "drivers_license",
        "licence_number",
        "license_number",
    ],
    "latitude": [
        "lat",
        "latitude",
    ],
    "longitude": [
        "lon",
        "lng",
        "long",
        "longitude",
    ],
}
#: Parts of names, in the order they are tried.
PARTS = (
    ("email", "email"),
    ("e_mail", "email"),
    ("phone", "phone"),
    ("telephone", "phone"),
    ("mobile", "phone"),
    ("postcode", "postcode"),
    ("postal", "postcode"),
    ("zip", "postcode"),
    ("address", "address"),
    ("street", "address"),
    ("birth", "birth_date"),
    ("dob", "birth_date"),
    ("gender", "gender"),
    ("ssn", "national_id"),
    ("passport", "national_id"),
    ("nino", "national_id"),
    ("licen", "national_id"),
    ("latitude", "latitude"),
    ("longitude", "longitude"),
    ("country", "country"),
    ("city", "city"),
    ("county", "region"),
    ("state", "region"),
    ("province", "region"),
    ("middle", "middle_name"),
    ("first", "first_name"),
    ("given", "first_name"),
    ("forename", "first_name"),
    ("surname", "surname"),
    ("last", "surname"),
    ("family", "surname"),
    ("date", "date"),
    ("name", "full_name"),
)
ROLES = {*NAMES, "text", "number", "boolean", "list", "ignore"}


def role_of(name: str, kind: str | None) -> str:
    """The role a name and a type suggest."""
    key = re.sub(r"[^a-z0-9]+", "_", re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower()).strip("_")
    named = next((r for r, words in NAMES.items() if key in words), None) or next((r for part, r in PARTS if part in key), "text")
    if kind is None:
        return "ignore"
    if kind == "boolean":
        return "boolean"
    if kind == "double":
        return named if named in ("latitude", "longitude") else "number"
    if kind == "date":
        return "birth_date" if named == "birth_date" else "date"
    if kind == "string_list":
        return "address" if named == "address" else "list"
    return "text" if named in ("latitude", "longitude") else named


def _ladder(*levels: tuple) -> tuple[Level, ...]:
    return (Level("null"), *(Level(*x) for x in levels), Level("else"))


def _for(role: str, kind: str) -> tuple[tuple[Level, ...], bool, str | None]:
    """(levels, term frequencies, blocking source) of a role."""
    names = _ladder(("exact",), ("jaro_winkler", 0.92), ("jaro_winkler", 0.85))
    if kind == "string_list":
        return _ladder(("exact",), ("list_jaccard", 0.5), ("list_overlap", 1)), False, None
    return {
        "first_name": (names, True, None), "middle_name": (names, True, None), "surname": (names, True, "rare_value"), "full_name": (names, True, "rare_value"),
        "gender": (_ladder(("exact",)), False, None), "boolean": (_ladder(("exact",)), False, None),
        "birth_date": (_ladder(("exact",), ("date_within", 2), ("date_within", 365)), False, "exact_value"), "date": (_ladder(("exact",), ("date_within", 7)), False, None),
        "phone": (_ladder(("exact",), ("levenshtein", 1)), True, "rare_value"), "postcode": (_ladder(("exact",), ("levenshtein", 1)), True, "rare_value"),
        "address": (_ladder(("exact",), ("levenshtein", 2), ("jaro_winkler", 0.88)), True, None), "city": (_ladder(("exact",), ("levenshtein", 1)), True, None),
        "region": (_ladder(("exact",)), True, None), "country": (_ladder(("exact",)), True, None), "national_id": (_ladder(("exact",), ("levenshtein", 1)), False, "exact_value"),
        "number": (_ladder(("exact",), ("percentage_within", 0.05)), False, None),
    }.get(role, (_ladder(("exact",), ("jaro_winkler", 0.9)), True, None))


#: What goes first when the code's bits run out.
PRIORITY = ("national_id", "surname", "full_name", "first_name", "birth_date", "email", "phone", "postcode", "place", "address", "city", "middle_name", "gender", "list", "date", "text", "number", "boolean", "region", "country")


def draft(inputs: DataFrame | list[DataFrame], unique_id: str | None = None, roles: dict[str, str] | None = None) -> tuple[Schema, dict[str, str], list[str]]:
    """(schema, role by column, notes)."""
    frames = inputs if isinstance(inputs, list) else [inputs]
    kinds = {f.name: column_type(f.dataType) for f in frames[0].schema.fields}
    notes = []
    for i, other in enumerate(frames[1:], 2):
        there = {f.name: column_type(f.dataType) for f in other.schema.fields}
        for n, k in kinds.items():
            if n not in there:
                raise SchemaError(f"column {n!r} is not in input {i}")
            if k is not None and there[n] != k:
                raise SchemaError(f"column {n!r} is {k} in the first input and {there[n]} in input {i}")
        notes += [f"{n!r} is only in input {i} and left out" for n in there if n not in kinds]
    for n, r in (roles or {}).items():
        if n not in kinds or r not in ROLES:
            raise SchemaError(f"no such column or role: {n}={r}")
    found = {n: (roles or {}).get(n) or role_of(n, k) for n, k in kinds.items()}
    identity = unique_id or next((n for n, r in found.items() if r == "id" and kinds[n] == "string"), None)
    columns, entries, blocking = [], [], []
    lat, lon = (next((n for n, r in found.items() if r == want and kinds[n] == "double"), None) for want in ("latitude", "longitude"))
    for n, r in found.items():
        if n == identity or r in ("ignore", "id") or kinds[n] is None:
            if kinds[n] is None:
                notes.append(f"{n!r} has a type that cannot be read and is left out")
            continue
        if r in ("latitude", "longitude"):
            continue
        columns.append(Column(n, kinds[n]))
        if r == "email":
            columns.append(Column(f"{n}_username", None, n, ("email_username",)))
            levels = (Level("null"), Level("exact", column=n), Level("exact", label="same username", column=f"{n}_username"), Level("jaro_winkler", 0.92, column=f"{n}_username"), Level("else"))
            entries.append(("email", Comparison(n, (n, f"{n}_username"), levels, True)))
            blocking.append(Source("rare_value", n, f"{n} rare_value"))
            continue
        levels, tf, source = _for(r, kinds[n])
        if kinds[n] == "double" and r != "number":
            continue
        entries.append((r, Comparison(n, (n,), levels, tf)))
        if source:
            blocking.append(Source(source, n, f"{n} {source}"))
    if lat and lon:
        columns += [Column(lat, "double"), Column(lon, "double")]
        entries.append(("place", Comparison("place", (lat, lon), _ladder(("geo_within", 0.5), ("geo_within", 5.0)))))
    if not columns:
        raise SchemaError("no column can be compared")
    entries.sort(key=lambda e: PRIORITY.index(e[0]) if e[0] in PRIORITY else len(PRIORITY))
    kept, bits = [], 0
    for _, c in entries:
        if bits + c.bits <= 32:
            kept.append(c)
            bits += c.bits
        else:
            notes.append(f"{c.name!r} has no room left in the code")
    if not blocking and any(c.type == "string" for c in columns):
        first = next(c.name for c in columns if c.type == "string")
        blocking.append(Source("rare_value", first, f"{first} rare_value"))
    schema = Schema(tuple(columns), tuple(kept), tuple(blocking), identity)
    schema = replace(schema, columns=tuple(replace(c, type=schema.derived_type(c)) if c.source else c for c in schema.columns), _by_name={})
    schema.check()
    return schema, found, notes
