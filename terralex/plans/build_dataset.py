"""Gazetteer dumps -> one enriched entity table with its manifest."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralex import fixed_values as fv
from terralex.operators import enrich, quality
from terralex.operators.filters import dataset_options
from terralex.operators.normalize import city_entities, country_entities, gazetteer_id, keep_first, select_representative
from terralex.session import Scratch, fail_on_errors, materialise, materialise_counted
from terralex.sources import concordance, gazetteer


@dataclass(frozen=True)
class Dumps:
    """Line tables of the raw dumps; lines that carry their position (`read_positioned_lines`) settle which of
    several rows of one id is the first. Concordance sources, lines or an archive's features, are callables so that
    one failing stays isolated."""

    cities: DataFrame
    countries: DataFrame
    admin1: DataFrame
    alternate_names: DataFrame
    features: Mapping[str, Callable[[], DataFrame]] = field(default_factory=dict)


def load_backbone(dumps: Dumps, types: list[str]) -> DataFrame:
    """Validated entities of the requested types, first occurrence of an id kept; bad rows fail."""
    countries = fail_on_errors(gazetteer.parse_countries(dumps.countries))
    parts = []
    for kind in types:
        if kind == "country":
            parts.append(_first_ids(fail_on_errors(country_entities(_first_lines(countries))), dumps.countries))
        else:
            cities = _first_lines(fail_on_errors(gazetteer.parse_cities(dumps.cities)))
            divisions = fail_on_errors(gazetteer.parse_admin1(dumps.admin1))
            parts.append(_first_ids(fail_on_errors(city_entities(cities, countries, divisions)), dumps.cities))
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.unionByName(other)
    return rows


def _first_lines(rows: DataFrame) -> DataFrame:
    """Of parsed rows of one id the one that stands first in the files, where lines carry their position."""
    return keep_first(rows, "geoname_id", "line_at") if "line_at" in rows.columns else rows


def _first_ids(entities: DataFrame, lines: DataFrame) -> DataFrame:
    """The same for entities of lines without a position: the order in which Spark numbers them. Ids of different
    types differ, so each type is settled by itself."""
    if "line_at" in lines.columns:
        return entities
    return keep_first(entities.withColumn("_load", F.monotonically_increasing_id()), "id", "_load")


def enrich_names(entities: DataFrame, alternate_lines: DataFrame) -> DataFrame:
    selected = entities.select(gazetteer_id().alias("geoname_id")).where(F.col("geoname_id").isNotNull())
    names = fail_on_errors(gazetteer.parse_alternate_names(alternate_lines, selected))
    return enrich.apply_alternate_names(entities, names)


def requested_counts() -> dict[str, Column]:
    """Entities with a gazetteer id per type, as aggregates by type."""
    return {kind: F.count_if((F.col("type") == kind) & gazetteer_id().isNotNull()) for kind in fv.BACKBONE_TYPES}


def enrich_concordance(entities: DataFrame, features: Mapping[str, Callable[[], DataFrame]], requested_by_type: Mapping[str, int], keep: Scratch) -> tuple[DataFrame, dict]:
    """Per type: skip lines by id mention, parse, match one to one, apply. A failing type leaves its entities as they were."""
    outputs, report = [], {"byType": {}, "requested": 0, "matched": 0, "ambiguous": 0, "invalid": 0, "scanned": 0, "skippedUnmatched": 0, "nameEn": 0, "nameVi": 0, "ambiguitySamples": []}
    attempted = succeeded = 0
    columns = entities.columns
    outputs.append(entities.where(~F.col("type").isin(*fv.BACKBONE_TYPES)))
    for kind in ("country", "city"):
        typed = entities.where(F.col("type") == kind)
        requested = requested_by_type.get(kind, 0)
        if not requested:
            outputs.append(typed)
            continue
        attempted += 1
        try:
            applied, part = _enrich_type(typed, features[kind](), kind, keep)
        except (AnalysisException, KeyError, OSError) as error:  # the source of this type is missing or unreadable
            part = {"status": "unavailable", "requested": requested, "matched": 0, "ambiguous": 0, "invalid": 0, "scanned": 0, "skippedUnmatched": 0, "nameEn": 0, "nameVi": 0, "error": str(error).splitlines()[0] if str(error) else type(error).__name__}
            outputs.append(typed)
        else:
            succeeded += 1
            outputs.append(applied.select(*columns))
        listed = part.pop("ambiguityCandidates", None)
        if listed is not None:
            known = report.get("ambiguityCandidates")
            report["ambiguityCandidates"] = listed if known is None else known.unionByName(listed)
        report["byType"][kind] = part
        for key in ("requested", "matched", "ambiguous", "invalid", "scanned", "skippedUnmatched", "nameEn", "nameVi"):
            report[key] += part.get(key, 0)
        room = fv.SAMPLE_LIMIT - len(report["ambiguitySamples"])
        report["ambiguitySamples"] += part.get("ambiguitySamples", [])[:max(0, room)]
    report["ambiguitySamplesTruncated"] = report["ambiguous"] > fv.SAMPLE_LIMIT
    report["status"] = enrich.enrichment_status(attempted, succeeded)
    rows = outputs[0]
    for other in outputs[1:]:
        rows = rows.unionByName(other)
    return rows, report


def _enrich_type(typed: DataFrame, lines: DataFrame, kind: str, keep: Scratch) -> tuple[DataFrame, dict]:
    features, read = keep.counted(concordance.feature_properties(lines), scanned=F.count("*"))
    targets = typed.select(gazetteer_id().alias("geoname_id")).where(F.col("geoname_id").isNotNull())
    parsed, seen = keep.counted(concordance.parse_features(concordance.worth_parsing(features, targets), kind), parsed=F.count("*"), invalid=F.count_if(F.size("_errors") > 0))
    candidates = parsed.where("_admissible").select("gn_id", "wof_id", "placetype", "name_en", "name_vi", "aliases_en", "aliases_vi")
    matched = keep(enrich.match_concordance(typed, candidates))
    applied, totals = keep.counted(enrich.apply_concordance(matched, typed.columns), **enrich.concordance_counts())
    listed = materialise(enrich.ambiguity_samples(matched, candidates))
    samples = [
        {"type": r["type"], "geonamesId": r["gn_id"], "candidates": r["n"], "smallestCandidate": r["w"]}
        for r in matched.where("match = 'ambiguous'").select("type", "gn_id", F.col("c_candidate_count").alias("n"), F.col("c_wof_id").alias("w")).orderBy("gn_id").limit(fv.SAMPLE_LIMIT).collect()
    ]
    report = {
        "status": "ok", "requested": totals["requested"], "matched": totals["matched"], "ambiguous": totals["ambiguous"],
        "nameEn": totals["name_en"], "nameVi": totals["name_vi"], "scanned": read["scanned"],
        "skippedUnmatched": read["scanned"] - seen["parsed"], "invalid": seen["invalid"], "ambiguitySamples": samples,
        "ambiguityCandidates": listed,
    }
    return applied, report


def build_dataset(dumps: Dumps, sources=fv.PUBLIC_SOURCES, types=fv.BACKBONE_TYPES, limit: int | None = None) -> tuple[DataFrame, dict]:
    """(entities, manifest). Selection comes before enrichment, so only survivors are enriched. Counts are taken
    while tables are written; the steps between are removed at the end."""
    options = dataset_options(sources, types, limit)
    report = {"status": "disabled", "requested": 0, "matched": 0, "ambiguous": 0, "invalid": 0, "scanned": 0, "skippedUnmatched": 0}
    with Scratch(dumps.cities.sparkSession) as keep:
        backbone, counted = keep.counted(load_backbone(dumps, options["loaded_types"]), rows=F.count("*"))
        before = counted["rows"]
        selected = keep(select_representative(backbone, limit)) if limit is not None and limit < before else backbone
        entities = enrich_names(selected, dumps.alternate_names)
        if "wof" in options["sources"]:
            entities, requested = keep.counted(entities, **requested_counts())
            entities, report = enrich_concordance(entities, dumps.features, requested, keep)
        entities, summary = materialise_counted(entities, **quality.coverage_counts(), **{f"in {c}": n for c, n in quality.continent_counts().items()})
        continents = {c: summary.pop(f"in {c}") for c in fv.CONTINENTS}
        failures = quality.coverage_failures(summary["city_count"], continents)
        if failures:
            raise ValueError("; ".join(failures))
        issues, checks = keep.counted(quality.quality_issues(entities), **quality.quality_counts())
        sample = issues.orderBy("code", "entity_id", "field").limit(fv.SAMPLE_LIMIT + 1).collect() if any(checks.values()) else []
    manifest = {
        "version": fv.MANIFEST_VERSION, "generatedAt": datetime.now(timezone.utc).isoformat(),
        "sources": options["sources"], "types": options["types"], "limit": options["limit"],
        "sourceCounts": {"geonames": before, "wof": report["matched"]}, "mergedCountBeforeLimit": before,
        "mergedCount": summary["total"], "skipped": options["skipped"], "wofEnrichment": report,
        "coverage": summary | {"continents": continents,
                               "countries": quality.country_coverage(entities)},
        "dataQuality": {
            "policy": fv.QUALITY_POLICY, "issueCount": sum(checks.values()), "checks": checks,
            "issues": [r.asDict() for r in sample[:fv.SAMPLE_LIMIT]], "truncated": len(sample) > fv.SAMPLE_LIMIT,
        },
    }
    return entities, manifest
