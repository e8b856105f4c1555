"""What a query asks for: structured constraints, non-geographic intent, and result verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from terralex import fixed_values as fv
from terralex.functions.text import fold, trimmed

_SPACE = f"[{fv.JS_SPACE}]"


def _pattern(template: str) -> str:
    return template.replace("{S}", _SPACE)


def _any_match(text: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def _let(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times, which keeps the generated code small."""
    return F.transform(F.array(value), body)[0]


def country_intent(folded: Column) -> Column:
    return _any_match(folded, fv.COUNTRY_INTENT_PATTERNS)


def requested_continent(folded: Column) -> Column:
    padded = F.concat(F.lit(" "), folded, F.lit(" "))
    choice = None
    for continent, aliases in fv.CONTINENT_ALIASES:
        hit = reduce(lambda a, b: a | b, [padded.contains(f" {alias} ") for alias in aliases])
        choice = F.when(hit, continent) if choice is None else choice.when(hit, continent)
    return choice


def _tidy_capital(fragment: Column) -> Column:
    for pattern in (fv.CAPITAL_TRAILING_PUNCTUATION, fv.CAPITAL_CONJUNCTION_TAIL, fv.CAPITAL_PHRASE_TAIL):
        fragment = F.regexp_replace(fragment, _pattern(pattern), "")
    return trimmed(fragment)


def requested_capital(text: Column, folded: Column, wants_country: Column) -> Column:
    """The first pattern that matches decides, even when its fragment cleans to nothing."""
    original = F.coalesce(text, F.lit(""))
    choice = None
    for index, (target, template) in enumerate(fv.CAPITAL_PATTERNS):
        subject = original if target == "original" else folded
        pattern = _pattern(template)
        value = _tidy_capital(F.regexp_extract(subject, pattern, 1))
        if index == 2:
            value = trimmed(F.regexp_replace(value, fv.CAPITAL_FOLDED_TAIL, ""))
        hit = subject.rlike(pattern)
        choice = F.when(hit, value) if choice is None else choice.when(hit, value)
    return F.when(wants_country, F.nullif(choice, F.lit("")))


def constraints(text: Column, folded: Column | None = None) -> Column:
    folded = fold(text) if folded is None else folded

    def read(x: Column) -> Column:
        return F.named_struct(
            F.lit("entity_type"), F.when(x["wants"], F.lit("country")),
            F.lit("continent"), requested_continent(x["folded"]),
            F.lit("capital"), requested_capital(x["text"], x["folded"], x["wants"]),
        )

    def intend(x: Column) -> Column:
        return _let(F.named_struct(
            F.lit("text"), x["text"], F.lit("folded"), x["folded"], F.lit("wants"), country_intent(x["folded"])
        ), read)

    return _let(F.named_struct(F.lit("text"), text, F.lit("folded"), folded), intend)


def constrained(constraint: Column) -> Column:
    return (
        constraint["entity_type"].isNotNull()
        | constraint["continent"].isNotNull()
        | constraint["capital"].isNotNull()
    )


def _equivalent_folded(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def _similarity_folded(a: Column, b: Column) -> Column:
    left, right = F.replace(a, F.lit(" "), F.lit("")), F.replace(b, F.lit(" "), F.lit(""))
    longest = F.greatest(F.length(left), F.length(right))
    return F.when((left == "") | (right == ""), F.lit(0.0)).otherwise(
        F.lit(1.0) - F.levenshtein(left, right).cast("double") / longest.cast("double")
    )


def equivalent_text(left: Column, right: Column) -> Column:
    pair = F.struct(fold(left).alias("a"), fold(right).alias("b"))
    return _let(pair, lambda x: _equivalent_folded(x["a"], x["b"]))


def edit_similarity(left: Column, right: Column) -> Column:
    pair = F.struct(fold(left).alias("a"), fold(right).alias("b"))
    return _let(pair, lambda x: _similarity_folded(x["a"], x["b"]))


def rejection_reasons(result_type: Column, continent: Column, capital: Column, wanted: Column) -> Column:
    """Why a result contradicts the constraints; an empty array accepts it."""
    type_clash = wanted["entity_type"].isNotNull() & ~F.coalesce(result_type == wanted["entity_type"], F.lit(False))
    seen = F.struct(
        type_clash.alias("type_clash"),
        wanted["continent"].isNotNull().alias("has_continent"), wanted["capital"].isNotNull().alias("has_capital"),
        fold(continent).alias("continent"), fold(wanted["continent"]).alias("wanted_continent"),
        fold(capital).alias("capital"), fold(wanted["capital"]).alias("wanted_capital"),
    )

    def judge(x: Column) -> Column:
        same_continent = _equivalent_folded(x["continent"], x["wanted_continent"])
        same_capital = _equivalent_folded(x["capital"], x["wanted_capital"]) | (
            _similarity_folded(x["capital"], x["wanted_capital"]) >= fv.CAPITAL_SIMILARITY_FLOOR
        )
        return F.array_compact(F.array(
            F.when(x["type_clash"], F.lit(fv.REASON_TYPE)),
            F.when(x["has_continent"] & ~same_continent, F.lit(fv.REASON_CONTINENT)),
            F.when(x["has_capital"] & ~same_capital, F.lit(fv.REASON_CAPITAL)),
        ))

    return _let(seen, judge)


def non_geographic_intent(folded: Column) -> Column:
    """struct(domain, reason), or null when the query may be geographic."""
    def judge(f: Column) -> Column:
        media = f.rlike(fv.MEDIA_MARKER) & f.rlike(fv.MEDIA_CONTENT)
        club = f.rlike(fv.CLUB_MARKER) & f.rlike(fv.CLUB_ACHIEVEMENT)
        open_question = (f == "") | _any_match(f, fv.GEOGRAPHIC_QUESTION_PATTERNS)
        none = F.lit(None).cast("struct<domain:string,reason:string>")
        return F.when(open_question, none).when(media, _intent(fv.MEDIA_INTENT)).when(club, _intent(fv.CLUB_INTENT))

    return _let(folded, judge)


def _intent(pair: tuple[str, str]) -> Column:
    return F.named_struct(F.lit("domain"), F.lit(pair[0]), F.lit("reason"), F.lit(pair[1]))


def geographic_type(result_type: Column) -> Column:
    return F.lower(F.coalesce(result_type, F.lit(""))).isin(*fv.GEOGRAPHIC_TYPES)
