"""The deterministic text an entity is embedded from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terralex import fixed_values as fv
from terralex.functions.text import trim_to_null, trimmed


def _fill(template: str, *values: Column) -> Column:
    """Fill `{}` slots; a null value makes the whole line null, so `concat_ws` skips it."""
    pieces = template.split("{}")
    parts: list[Column] = []
    for index, piece in enumerate(pieces):
        if piece:
            parts.append(F.lit(piece))
        if index < len(values):
            parts.append(values[index])
    return F.concat(*parts)


def _present(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _joined(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.array_join(items, ", "))


def _opening(name: Column, description: Column, aliases: Column) -> list[Column]:
    names = F.concat_ws(". ", _present(name["en"]), _present(name["vi"]))
    return [
        F.when(names != "", _fill("{}.", names)),
        trim_to_null(description["en"]),
        trim_to_null(description["vi"]),
        _fill(fv.LINE_ALIASES_EN, _joined(aliases["en"])),
        _fill(fv.LINE_ALIASES_VI, _joined(aliases["vi"])),
    ]


def _location() -> list[Column]:
    return [
        _fill(fv.LINE_REGION, _present(F.col("region"))),
        _fill(fv.LINE_CONTINENT, _present(F.col("continent"))),
        _fill(fv.LINE_COUNTRY_CODE, _present(F.col("country_code"))),
    ]


def _both(sentences: tuple[str, str], en: Column, vi: Column, *rest: Column) -> list[Column]:
    return [_fill(sentences[0], en, *rest), _fill(sentences[1], vi, *rest)]


def _only(condition: Column, lines: list[Column]) -> list[Column]:
    return [F.when(condition, line) for line in lines]


def document_text(version: str = fv.DEFAULT_TEXT_VERSION) -> Column:
    """One text per entity row; columns follow the entity schema."""
    if version not in fv.TEXT_VERSIONS:
        raise ValueError(f"unsupported embedding text version: {version or '(empty)'}")
    name, facts = F.col("name"), F.col("facts")
    lines = _opening(name, F.col("description"), F.col("aliases"))
    languages = _fill(fv.LINE_LANGUAGES, _joined(facts["languages"]))
    if version == "v1":
        # A capital city prints its flag here; the frozen text keeps that line.
        capital = F.coalesce(_present(facts["capital"]), F.when(facts["is_capital"], F.lit("true")))
        lines += _location() + [
            _fill(fv.LINE_COUNTRY, _present(facts["country"])),
            _fill(fv.LINE_CAPITAL, capital),
            _fill(fv.LINE_CURRENCY, _present(facts["currency"])),
            languages,
        ]
    else:
        en, vi = _present(name["en"]), _present(name["vi"])
        capital, currency = trim_to_null(facts["capital"]), trim_to_null(facts["currency"])
        country = trim_to_null(facts["country"])
        kind = F.col("type")
        sentences = _only(kind == "country", _both(fv.TYPE_SENTENCES["country"], en, vi))
        for place in ("city", "landmark"):
            inside, alone = (kind == place) & country.isNotNull(), (kind == place) & country.isNull()
            sentences += _only(inside, _both(fv.PLACE_IN_COUNTRY_SENTENCES[place], en, vi, country))
            sentences += _only(alone, _both(fv.TYPE_SENTENCES[place], en, vi))
        seat = (kind == "city") & facts["is_capital"]
        sentences += _only(seat, _both(fv.CITY_IS_CAPITAL_SENTENCES, en, vi, country))
        country_only = _both(fv.COUNTRY_CAPITAL_SENTENCES[version], en, vi, capital)
        country_only += _both(fv.CURRENCY_SENTENCES, en, vi, currency)
        lines += sentences + _location() + _only(kind == "country", country_only) + [languages]
    return F.concat_ws("\n", *[trim_to_null(line) for line in lines])


def selected_document_text(version: str | None = None) -> Column:
    """Text for a collection load: only the released versions may be chosen."""
    chosen = fv.DEFAULT_TEXT_VERSION if version is None else version.strip()
    if chosen not in fv.SELECTABLE_TEXT_VERSIONS:
        raise ValueError(f"unsupported embedding text version: {chosen or '(empty)'}")
    return document_text(chosen)


def query_input(text: Column, strategy: str, prompt: str = fv.QUERY_INSTRUCTION) -> Column:
    clean = trimmed(text)
    if strategy == "prefix":
        return F.concat(F.lit(fv.QUERY_PREFIX), clean)
    if strategy == "prompt":
        return F.concat(F.lit(prompt), clean)
    raise ValueError(f"unsupported query strategy: {strategy}")


def document_input(text: Column, strategy: str) -> Column:
    clean = trimmed(text)
    if strategy == "prefix":
        return F.concat(F.lit(fv.DOCUMENT_PREFIX), clean)
    if strategy == "raw":
        return clean
    raise ValueError(f"unsupported document strategy: {strategy}")


def instruction_id(prompt: Column) -> Column:
    return F.concat(F.lit(fv.INSTRUCTION_ID_PREFIX), F.substring(F.sha2(prompt, 256), 1, 16))
