"""Name enrichment by exact id: alternate names, then concordance candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex import fixed_values as fv
from terralex.functions.text import append_aliases
from terralex.operators.normalize import gazetteer_id
from terralex.session import small_side


def eligible_names(names: DataFrame) -> DataFrame:
    """Current names in the two kept languages."""
    return names.where(F.col("language").isin(*fv.NAME_LANGUAGES) & ~F.coalesce("historic", F.lit(False)))


def distinct_names(names: DataFrame) -> DataFrame:
    """(geoname_id, language, name, seq, preference): one row per spelling.

    Combining on the spelling first spreads a hot id over many keys; only distinct spellings travel on.
    """
    preference = F.struct(
        (~F.col("preferred")).alias("not_preferred"), (~F.col("short_name")).alias("not_short"), "alternate_name_id"
    )
    return eligible_names(names).groupBy("geoname_id", "language", "name").agg(
        F.min("alternate_name_id").alias("seq"), F.min(preference).alias("preference")
    )


def best_current_names(names: DataFrame) -> DataFrame:
    """(geoname_id, language, name): preferred first, then short, then lowest id - an aggregate, no window."""
    best = F.min(F.struct("preference", "name")).alias("_best")
    return distinct_names(names).groupBy("geoname_id", "language").agg(best).select(
        "geoname_id", "language", F.col("_best.name").alias("name")
    )


def _names_per_entity(names: DataFrame) -> DataFrame:
    def per_language(language: str) -> list:
        mine = F.col("language") == language
        listed = F.array_sort(F.collect_list(F.when(mine, F.struct("seq", "name"))))
        return [
            F.min(F.when(mine, F.struct("preference", "name")))["name"].alias(f"best_{language}"),
            F.transform(listed, lambda x: x["name"]).alias(f"names_{language}"),
        ]

    return distinct_names(names).groupBy("geoname_id").agg(*per_language("en"), *per_language("vi"))


def apply_alternate_names(entities: DataFrame, names: DataFrame) -> DataFrame:
    """Replace fallback names by the best current name and append the other spellings as aliases."""
    rows = entities.withColumn("geoname_id", gazetteer_id())
    found = _names_per_entity(names)
    joined = rows.join(found, "geoname_id", "left")
    provenance, name, aliases = F.col("language_provenance"), F.col("name"), F.col("aliases")
    empty = F.array().cast("array<string>")

    def replaced(language: str):
        may = provenance[f"name_{language}"].isin(*fv.REPLACEABLE_NAME_PROVENANCE)
        return F.col(f"best_{language}").isNotNull() & F.coalesce(may, F.lit(False))

    new = {lang: F.when(replaced(lang), F.col(f"best_{lang}")).otherwise(name[lang]) for lang in fv.NAME_LANGUAGES}
    extended = {
        lang: append_aliases(aliases[lang], F.coalesce(F.col(f"names_{lang}"), empty), new[lang])
        for lang in fv.NAME_LANGUAGES
    }
    stamped = provenance
    for lang in fv.NAME_LANGUAGES:
        field = f"name_{lang}"
        stamped = stamped.withField(field, F.when(replaced(lang), "geonames_alternate").otherwise(provenance[field]))
    return joined.withColumns({
        "name": F.struct(new["en"].alias("en"), new["vi"].alias("vi")),
        "aliases": F.struct(extended["en"].alias("en"), extended["vi"].alias("vi")),
        "language_provenance": stamped,
    }).select(*entities.columns)


def candidate_degrees(candidates: DataFrame) -> DataFrame:
    """Per gazetteer id: its only candidate, or `ambiguous`.

    A one-to-one match shows as min = max on both sides, so no candidate list is ever collected however
    many features claim one id. Copies of one feature count once; the smallest copy is kept.
    """
    payload = [c for c in candidates.columns if c not in ("gn_id", "wof_id")]
    text = F.col("wof_id").cast("string")
    keyed = candidates.withColumn("_w", F.struct(F.length(text).alias("length"), text.alias("text")))
    claims = keyed.groupBy("_w").agg(F.min("gn_id").alias("_lo"), F.max("gn_id").alias("_hi"))
    contested = claims.select("_w", (F.col("_lo") != F.col("_hi")).alias("_contested"))
    per_pair = keyed.groupBy("gn_id", "wof_id", "_w").agg(F.min(F.struct(*payload)).alias("payload"))
    flagged = per_pair.join(contested, "_w")
    best = F.min_by(F.struct("wof_id", "payload"), "_w")
    return flagged.groupBy("gn_id").agg(
        F.count("*").alias("candidate_count"),
        F.max("_contested").alias("contested"), best.alias("_only"),
    ).select(
        "gn_id", "candidate_count", ((F.col("candidate_count") > 1) | F.col("contested")).alias("ambiguous"),
        F.col("_only.wof_id").alias("wof_id"), F.col("_only.payload.*"),
    )


def match_concordance(entities: DataFrame, candidates: DataFrame) -> DataFrame:
    """Entities left-joined to their candidate on exact id, with `match` = matched / ambiguous / none."""
    rows = entities.withColumn("_gid", gazetteer_id())
    targets = rows.where(F.col("_gid").isNotNull()).select(F.col("_gid").cast("string").alias("gn_id")).distinct()
    relevant = candidates.withColumn("gn_id", F.col("gn_id").cast("string")).join(small_side(targets), "gn_id", "left_semi")
    degrees = candidate_degrees(relevant)
    for column in degrees.columns:
        if column != "gn_id":
            degrees = degrees.withColumnRenamed(column, f"c_{column}")
    state = F.when(F.col("c_ambiguous"), "ambiguous").when(F.col("c_wof_id").isNotNull(), "matched").otherwise("none")
    return rows.withColumn("gn_id", F.col("_gid").cast("string")).join(degrees, "gn_id", "left").withColumn(
        "match", F.when(F.col("gn_id").isNotNull(), state)
    ).drop("_gid")


def apply_concordance(matched: DataFrame, columns: list[str]) -> DataFrame:
    """Write the names, aliases, facts and reference of matched candidates; other rows are unchanged.

    The previous name stays as an alias here. Explicit Vietnamese names are not overridden.
    """
    hit = F.coalesce(F.col("match") == "matched", F.lit(False))
    name, aliases, provenance = F.col("name"), F.col("aliases"), F.col("language_provenance")
    explicit_vi = name["vi"].isNotNull() & provenance["name_vi"].isin(*fv.EXPLICIT_VI_PROVENANCE)
    use_en = hit & F.col("c_name_en").isNotNull()
    use_vi = hit & F.col("c_name_vi").isNotNull() & ~F.coalesce(explicit_vi, F.lit(False))
    new_en = F.when(use_en, F.col("c_name_en")).otherwise(name["en"])
    new_vi = F.when(use_vi, F.col("c_name_vi")).otherwise(name["vi"])
    empty = F.array().cast("array<string>")
    more_en = F.concat(F.array(name["en"]), F.coalesce("c_aliases_en", empty))
    more_vi = F.concat(F.array(name["vi"], F.col("c_name_vi")), F.coalesce("c_aliases_vi", empty))
    ref = F.struct(F.lit("whosonfirst").alias("source"), F.col("c_wof_id").cast("string").alias("source_id"))
    facts = F.col("facts")
    updates = {
        "name": F.struct(new_en.alias("en"), new_vi.alias("vi")),
        "aliases": F.struct(
            append_aliases(aliases["en"], more_en, new_en).alias("en"),
            append_aliases(aliases["vi"], more_vi, new_vi).alias("vi"),
        ),
        "facts": facts.withField("wof_id", F.col("c_wof_id").cast("string")).withField("wof_placetype", F.col("c_placetype")),
        "source_refs": F.array_distinct(F.concat("source_refs", F.array(ref))),
        "language_provenance": provenance.withField(
            "name_en", F.when(use_en, "whosonfirst").otherwise(provenance["name_en"])
        ).withField("name_vi", F.when(use_vi, "whosonfirst").otherwise(provenance["name_vi"])),
    }
    return matched.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in updates.items()}).withColumns({
        "filled_en": use_en, "filled_vi": use_vi,
    }).select(*columns, "match", "filled_en", "filled_vi")


def _requested() -> Column:
    return F.col("match").isNotNull() & F.col("type").isin(*fv.BACKBONE_TYPES)


def concordance_counts() -> dict[str, Column]:
    """requested, matched, ambiguous, names filled of applied rows, as aggregates by name."""
    states = {"requested": F.lit(True), "matched": F.col("match") == "matched", "ambiguous": F.col("match") == "ambiguous", "name_en": F.col("filled_en"), "name_vi": F.col("filled_vi")}
    return {name: F.count_if(_requested() & state) for name, state in states.items()}


def concordance_report(applied: DataFrame) -> DataFrame:
    """Per type and in total (type null): requested, matched, ambiguous, names filled."""
    counts = [count.alias(name) for name, count in concordance_counts().items()]
    return applied.where(_requested()).groupingSets([["type"], []], "type").agg(*counts)


def scan_report(lines: DataFrame, parsed: DataFrame) -> DataFrame:
    """scanned, skipped without parsing, and invalid feature counts as one row."""
    scanned = lines.select(F.lit(1).alias("scanned"), F.lit(0).alias("parsed"), F.lit(0).alias("bad"))
    seen = parsed.select(F.lit(0).alias("scanned"), F.lit(1).alias("parsed"), (F.size("_errors") > 0).cast("int").alias("bad"))
    totals = scanned.unionByName(seen).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("scanned", "parsed", "bad")])
    return totals.select(
        "scanned", (F.col("scanned") - F.col("parsed")).alias("skipped_unmatched"), F.col("bad").alias("invalid")
    )


def enrichment_status(attempted: int, succeeded: int) -> str:
    if attempted == 0:
        return "disabled"
    if succeeded == attempted:
        return "ok"
    return "unavailable" if succeeded == 0 else "partial"


def ambiguity_samples(matched: DataFrame, candidates: DataFrame, n: int = fv.SAMPLE_LIMIT) -> DataFrame:
    """Candidates of the first n ambiguous entities, one row each (never one unbounded list)."""
    picked = matched.where(F.col("match") == "ambiguous").select("type", "gn_id", "id").orderBy("id").limit(n)
    pairs = candidates.select(F.col("gn_id").cast("string").alias("gn_id"), "wof_id").distinct()
    return picked.join(pairs, "gn_id").select("type", "gn_id", "wof_id")
