"""Locations and phones together: several places in one field, and whether a phone fits its place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, digits, first_match, let, no_text, present

# Dialling codes, longest first, and their countries.
COUNTRIES = {"852": "Hong Kong", "44": "UK", "49": "Germany", "91": "India", "86": "China", "81": "Japan", "65": "Singapore", "61": "Australia", "33": "France", "1": "US"}
# Area codes of the United States and their cities.
AREA_CODES = {
    "212": "New York", "646": "New York", "917": "New York", "718": "New York", "202": "Washington", "213": "Los Angeles", "310": "Los Angeles",
    "415": "San Francisco", "312": "Chicago", "773": "Chicago", "617": "Boston", "857": "Boston", "206": "Seattle", "713": "Houston", "512": "Austin",
    "305": "Miami", "404": "Atlanta", "214": "Dallas", "602": "Phoenix", "503": "Portland", "702": "Las Vegas",
}
# Cities that tell a country.
CITIES = {
    "Germany": ["Frankfurt", "Berlin", "Munich"], "UK": ["London"], "France": ["Paris"], "Hong Kong": ["Hong Kong"], "Singapore": ["Singapore"], "China": ["Beijing", "Shanghai"],
    "Japan": ["Tokyo"], "Australia": ["Sydney", "Melbourne"], "India": ["Delhi", "Mumbai"],
}
# Cities that tell the US, larger cities of the US, and codes of its states.
US_KNOWN = ["New York", "Los Angeles", "Chicago", "Houston", "Boston", "Seattle", "Miami", "Atlanta", "Dallas", "Austin", "San Francisco"]
US_CITIES = [
    "New York", "Washington", "Los Angeles", "Chicago", "Houston", "Philadelphia", "Phoenix", "San Antonio", "San Diego", "Dallas", "San Jose", "Austin", "Jacksonville",
    "San Francisco", "Boston", "Seattle", "Denver", "Miami", "Atlanta", "Portland", "Las Vegas", "Detroit", "Memphis", "Nashville", "Baltimore", "Charlotte",
]
STATES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME",
    "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA",
    "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC",
]
DC = r"(?i)Washington,?\s*D\.?C\.?"
PAIR = "struct<location:string,phone:string>"


def country_code(phone: Column) -> Column:
    """The dialling code after a plus, or null."""
    return let(F.regexp_replace(phone, r"[\s\-\(\)]", ""), lambda p: F.coalesce(*(F.when(p.startswith("+" + c), F.lit(c)) for c in COUNTRIES)))


def country_of(code: Column) -> Column:
    return let(code, lambda v: F.coalesce(*(F.when(v == c, F.lit(n)) for c, n in COUNTRIES.items())))


def location_country(location: Column) -> Column:
    """The country that the text of a place tells, or null."""
    known = [F.when(location.rlike(DC), F.lit("US"))] + [F.when(any_of([F.contains(location, F.lit(c)) for c in cs]), F.lit(n)) for n, cs in CITIES.items()]
    return F.coalesce(*known, F.when(location.rlike(r",\s*[A-Z]{2}\z") | any_of([F.contains(location, F.lit(c)) for c in US_KNOWN]), F.lit("US")))


def phone_location_check(phone: Column, location: Column, country: Column | None = None) -> Column:
    """struct(valid, mismatch, reason). `country` is the place's country where it is known from elsewhere."""
    p = present(phone)
    area = first_match(F.regexp_replace(p, r"[\s\-\(\)]", ""), r"^\+?1(\d{3})", 1)
    city = let(area, lambda v: F.coalesce(*(F.when(v == a, F.lit(c)) for a, c in AREA_CODES.items())))
    said = lambda valid, mismatch, reason: F.struct(F.lit(valid).alias("valid"), F.lit(mismatch).alias("mismatch"), F.lit(reason).cast("string").alias("reason"))

    def verdict(place: Column, code: Column, city: Column) -> Column:
        where = F.coalesce(country if country is not None else no_text(), location_country(place))
        there = F.contains(F.lower(place), F.lower(city)) | ((city == "Washington") & place.rlike(DC))
        return (
            F.when(p.isNull() | place.isNull(), said(False, False, "missing-data")).when(code.isNull(), said(False, False, "no-country-code"))
            .when(where != country_of(code), said(False, True, "country-mismatch")).when((code == "1") & city.isNotNull() & ~there, said(True, True, "city-mismatch")).otherwise(said(True, False, None))
        )

    return let(present(location), lambda place: let(country_code(phone), lambda code: let(city, lambda c: verdict(place, code, c))))


def looks_like_location(c: Column) -> Column:
    n = F.length(digits(c))
    forms = [r"^[A-Z][a-z]+(?:\s+[A-Z]?[a-z]+)*\z", r"^[A-Z][a-z]+(?:\s+[A-Z]?[a-z]+)*,\s*[A-Z]{2}\z", DC, r"^St\.\s+[A-Z][a-z]+"]
    return c.rlike("[a-zA-Z]") & (n * 2 <= F.length(c)) & any_of([c.rlike(p) for p in forms])


def is_us(pair: Column) -> Column:
    place = pair["location"]
    state = first_match(place, r",\s*([A-Z]{2})\b", 1).isin(STATES)
    return F.coalesce(country_code(pair["phone"]) == "1", F.coalesce(state, F.lit(False)) | place.rlike(DC) | any_of([F.contains(place, F.lit(c)) for c in US_CITIES]))


def multi_location(location: Column, phone: Column, us_first: bool = True) -> Column:
    """struct(several, location, phone, locations, pairs) of a field of lines. A phone line belongs to the place before it; a place that is
    followed by another takes the last phone seen, the last one also the row's own; a line may hold both. Places in the United States come first if asked."""
    lines = F.filter(F.transform(F.split(location, r"\n+"), lambda s: F.trim(s)), lambda s: s != "")
    pair = lambda place, number: F.struct(place.alias("location"), number.cast("string").alias("phone"))
    state = lambda pairs, last, pending: F.struct(pairs.alias("pairs"), last.cast("string").alias("last"), pending.cast("string").alias("pending"))
    none = F.array().cast(f"array<{PAIR}>")

    def step(s: Column, x: Column) -> Column:
        flush = lambda number: F.when(s["pending"].isNotNull(), F.concat(s["pairs"], F.array(pair(s["pending"], number)))).otherwise(s["pairs"])
        number = F.regexp_replace(x, r"[\s\-\(\)]", "").rlike(r"^\+?\d{7,15}\z")
        inner = first_match(x, r"(\+\d+[\d\s\-\(\)]+)", 1)
        place = F.trim(F.regexp_replace(x, r"\+\d+[\d\s\-\(\)]+", ""))
        both = x.rlike(r"\+\d+[\d\s\-\(\)]{7,}")
        return (
            F.when(number, state(flush(x), x, no_text()))
            .when(both & let(place, lambda p: (p != "") & looks_like_location(p)), state(F.concat(s["pairs"], F.array(pair(place, inner))), s["last"], s["pending"]))
            .when(~both & looks_like_location(x), state(flush(s["last"]), s["last"], x)).otherwise(s)
        )

    def close(s: Column) -> Column:
        return F.when(s["pending"].isNotNull(), F.concat(s["pairs"], F.array(pair(s["pending"], F.coalesce(s["last"], phone))))).otherwise(s["pairs"])

    pairs = F.coalesce(F.aggregate(lines, state(none, no_text(), no_text()), step, close), none)
    ordered = lambda ps: F.when(F.size(ps) > 1, F.concat(F.filter(ps, is_us), F.filter(ps, lambda p: ~is_us(p)))).otherwise(ps) if us_first else ps
    shown = lambda ps: F.struct(
        (F.size(ps) > 1).alias("several"), F.get(ps, 0)["location"].alias("location"), F.coalesce(F.get(ps, 0)["phone"], phone).alias("phone"),
        F.transform(ps, lambda p: p["location"]).alias("locations"), ps.alias("pairs"),
    )
    return let(pairs, lambda ps: let(ordered(ps), shown))
