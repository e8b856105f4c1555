"""Candidate sets for text experiments: focused and stress sets of a bounded target size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralex import fixed_values as fv
from terralex.functions.text import trim_to_null
from terralex.operators.ordering import top_n
from terralex.session import collect_bounded, materialise, require, small_side


def _present(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def expected_ids(cases: DataFrame) -> DataFrame:
    """(id, seq): distinct expected ids of answerable cases in first-seen order (case id, position)."""
    rows = cases.where(F.coalesce("answerable", F.lit(True))).select("id", F.posexplode("expected_ids").alias("pos", "expected_id"))
    return rows.groupBy(F.col("expected_id").alias("id")).agg(F.min(F.struct(F.col("id").alias("a"), F.col("pos").alias("b"))).alias("seq"))


def mine_distractors(results: DataFrame, cases: DataFrame, case_ids: Sequence[str] | None = None) -> DataFrame:
    """(id, seq): results of the chosen cases that those cases do not expect, in first-seen order."""
    chosen = results if case_ids is None else results.where(F.col("case_id").isin(*case_ids))
    known = cases.select(F.col("id").alias("case_id"))
    wanted = cases.select(F.col("id").alias("case_id"), F.explode("expected_ids").alias("id")).distinct()
    wrong = chosen.join(known, "case_id", "left_semi").join(wanted, ["case_id", "id"], "left_anti")
    return wrong.groupBy("id").agg(F.min(F.struct(F.col("case_id").alias("a"), F.col("rank").alias("b"))).alias("seq"))


def _context_values(expected: DataFrame, max_size: int) -> dict[str, list[str]]:
    """Names, codes, regions and capitals of the expected entities: at most `max_size` entities' worth."""
    rows = collect_bounded(
        expected.select(
            "type", "name", "continent", "region", "country_code",
            F.col("facts.country").alias("country"), F.col("facts.capital").alias("capital"),
            F.coalesce("facts.is_capital", F.lit(False)).alias("is_capital"),
        ),
        max_size, "expected entities",
    )
    found: dict[str, set[str]] = {k: set() for k in ("own_names", "countries", "continents", "regions", "codes", "capitals")}

    def add(kind: str, *values: str | None) -> None:
        found[kind].update(v.strip() for v in values if v and v.strip())

    for row in rows:
        if row["type"] == "country":
            add("own_names", row["name"]["en"], row["name"]["vi"])
            add("capitals", row["capital"])
        if row["type"] == "city" and row["is_capital"]:
            add("capitals", row["name"]["en"], row["name"]["vi"])
        add("countries", row["country"])
        add("continents", row["continent"])
        add("regions", row["region"])
        add("codes", row["country_code"])
    return {k: sorted(v) for k, v in found.items()}


def _member(value: Column, values: Sequence[str]) -> Column:
    return F.coalesce(value.isin(*values), F.lit(False)) if values else F.lit(False)


def relation_score(context: dict[str, list[str]]) -> Column:
    """How closely an entity relates to the expected ones; -1 for anything but a country or city."""
    names = sorted({*context["own_names"], *context["countries"]})
    parts = (
        ("country", _present(F.col("facts.country")), names), ("name_en", F.col("name.en"), names),
        ("name_vi", F.col("name.vi"), names), ("country_code", F.col("country_code"), context["codes"]),
        ("region", F.col("region"), context["regions"]), ("continent", F.col("continent"), context["continents"]),
    )
    score = F.lit(0)
    for weight, value, values in parts:
        score = score + F.when(_member(value, values), F.lit(fv.RELATION_WEIGHTS[weight])).otherwise(F.lit(0))
    return F.when(F.col("type").isin(*fv.BACKBONE_TYPES), score).otherwise(F.lit(-1))


def _require_known(ids: DataFrame, entities: DataFrame, what: str) -> DataFrame:
    known = entities.select("id").join(small_side(ids.select("id")), "id", "left_semi").withColumn("_known", F.lit(True))
    message = F.concat(F.lit(f"{what} is missing from dataset: "), F.col("id"))
    return ids.join(known, "id", "left").where(require(F.col("_known"), message)).drop("_known")


def _check_sizes(target: int, maximum: int) -> None:
    if target < 1 or maximum < 1:
        raise ValueError("sizes must be positive integers")
    if target > maximum:
        raise ValueError("target size must not exceed the maximum size")


def focused_candidates(
    cases: DataFrame, results: DataFrame, entities: DataFrame, focus_case_ids: Sequence[str],
    target_size: int = 75, max_size: int = 150,
) -> DataFrame:
    """(id, position, reason): expected ids, then mined distractors, then the closest related entities."""
    _check_sizes(target_size, max_size)
    present = {r[0] for r in results.select("case_id").where(F.col("case_id").isin(*focus_case_ids)).distinct().collect()}
    if set(focus_case_ids) - present:
        raise ValueError(f"focus cases are missing from the report: {sorted(set(focus_case_ids) - present)}")
    wanted = _require_known(expected_ids(cases), entities, "expected entity").withColumn("tier", F.lit(1))
    mined = _require_known(mine_distractors(results, cases, focus_case_ids), entities, "distractor").withColumn("tier", F.lit(2))
    required = materialise(wanted.unionByName(mined).groupBy("id").agg(F.min(F.struct("tier", "seq")).alias("at")))
    ids = [r["id"] for r in collect_bounded(required.orderBy("at", "id"), max_size, "required candidates")]
    expected = required.where(F.col("at.tier") == 1).select("id")
    context = _context_values(entities.join(F.broadcast(expected), "id", "left_semi"), max_size)
    missing = max(0, target_size - len(ids))
    spark = entities.sparkSession
    chosen = spark.createDataFrame([(i, n + 1) for n, i in enumerate(ids)], "id string, position int")
    reasons = chosen.join(required, "id").select(
        "id", "position", F.when(F.col("at.tier") == 1, "expected").otherwise("distractor").alias("reason")
    )
    pool = entities.select("id", relation_score(context).alias("score")).where(F.col("score") >= 0)
    fillers = top_n(pool.join(F.broadcast(chosen.select("id")), "id", "left_anti"), [F.desc("score"), F.asc("id")], missing)
    order = Window.orderBy(F.desc("score"), F.asc("id"))  # at most target_size rows
    filled = fillers.select("id", (F.row_number().over(order) + len(ids)).alias("position"), F.lit("related").alias("reason"))
    selection = materialise(reasons.unionByName(filled))
    total = selection.count()
    if total < target_size:
        raise ValueError(f"could only build {total} focused candidates; target {target_size} is not satisfiable")
    return selection


def search_haystack() -> Column:
    """Lower-cased names, aliases, region and descriptions, one per line."""
    texts = F.concat(
        F.array("name.en", "name.vi"), F.col("aliases.en"), F.col("aliases.vi"),
        F.array("region", "description.en", "description.vi"),
    )
    lowered = F.transform(F.array_compact(texts), lambda x: F.lower(trim_to_null(x)))
    return F.array_join(F.array_compact(lowered), "\n")


def _is_plain_city() -> Column:
    return (F.col("type") == "city") & ~F.coalesce("facts.is_capital", F.lit(False))


_AUTOMATA: dict[tuple[str, ...], object] = {}


def _automaton(needles: tuple[str, ...]):
    """The automaton of a needle list, made once per worker."""
    import ahocorasick

    if needles not in _AUTOMATA:
        made = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for needle in needles:
            made.add_word(needle)
        made.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[needles] = made
    return _AUTOMATA[needles]


def mentions_any(text: Column, needles: list[str]) -> Column:
    """Whether a text holds one of the needles, in one pass over it however many there are; false for null."""
    listed = tuple(sorted({n for n in needles if n}))
    if not listed:
        return F.lit(False)

    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        automaton = _automaton(listed)
        return pd.Series([t is not None and next(automaton.iter(t), None) is not None for t in texts], dtype=bool)

    return found(text)


def is_capital_locality(context: dict[str, list[str]]) -> Column:
    """A non-capital city whose texts mention an expected capital."""
    needles = [c.strip().lower() for c in context["capitals"]]
    return F.coalesce(_is_plain_city() & mentions_any(F.when(_is_plain_city(), search_haystack()), needles), F.lit(False))


def is_related_city(context: dict[str, list[str]]) -> Column:
    countries = sorted({*context["own_names"], *context["countries"]})
    related = (
        _member(_present(F.col("facts.country")), countries) | _member(F.col("country_code"), context["codes"])
        | _member(F.col("region"), context["regions"])
    )
    return F.coalesce(_is_plain_city() & related, F.lit(False))


def _tier_flags(context: dict[str, list[str]]) -> dict[str, Column]:
    is_capital = (F.col("type") == "city") & F.coalesce("facts.is_capital", F.lit(False))
    return {
        "all-country": F.col("type") == "country", "all-capital-city": is_capital,
        "capital-locality": is_capital_locality(context), "related-major-city": is_related_city(context),
        "global-major-city": _is_plain_city(),
    }


def stress_candidates(
    cases: DataFrame, results: DataFrame, entities: DataFrame, target_size: int = 750, max_size: int = 1000
) -> tuple[DataFrame, DataFrame]:
    """(selection, pool sizes). Selection: id, position, tier, reasons.

    Four mandatory tiers are taken whole (too many is an error), four optional ones fill up to the target.
    The entities are read once into a narrow table of tier flags. A tier can contribute at most target +
    maximum rows, so each is cut to that many by its own order, and only those few rows are ranked together.
    """
    _check_sizes(target_size, max_size)
    wanted = materialise(_require_known(expected_ids(cases), entities, "expected entity"))
    mined = materialise(_require_known(mine_distractors(results, cases), entities, "distractor"))
    context = _context_values(entities.join(small_side(wanted.select("id")), "id", "left_semi"), max_size)
    flags = {name: f"_{i}" for i, name in enumerate(_tier_flags(context))}
    narrow = materialise(entities.select(
        "id", "population", *[F.coalesce(flag, F.lit(False)).alias(flags[name]) for name, flag in _tier_flags(context).items()]
    ))
    cut = target_size + max_size + 1
    none, by_id = F.lit(None).cast("bigint"), F.col("id")
    by_population = -F.coalesce("population", F.lit(-1))

    def tier(name: str, rows: DataFrame, number: Column, text: Column) -> DataFrame:
        index = fv.STRESS_TIERS.index(name)
        rows = rows.select("id", F.lit(index).alias("tier"), number.cast("bigint").alias("o1"), text.alias("o2"))
        return top_n(rows, [F.asc("o1"), F.asc("o2"), F.asc("id")], cut)

    def listed(rows: DataFrame, name: str) -> DataFrame:
        number = F.col("seq.b").cast("string")  # of equal length, numbers order as texts
        return tier(name, rows, none, F.concat_ws("\u0001", F.col("seq.a"), F.lpad(F.length(number).cast("string"), 2, "0"), number))

    tiers = [tier(name, narrow.where(flags[name]), none, by_id) for name in ("all-country", "all-capital-city")]
    tiers += [listed(wanted, "expected"), listed(mined, "hard-report-distractor")]
    tiers += [tier(name, narrow.where(flags[name]), by_population, by_id) for name in ("capital-locality", "related-major-city", "global-major-city")]
    tiers += [tier("deterministic-filler", narrow, none, by_id)]
    pool = reduce(DataFrame.unionByName, tiers)
    first = pool.groupBy("id").agg(F.min(F.struct("tier", "o1", "o2", "id")).alias("at"))
    order = Window.orderBy("at")  # at most eight cut tiers
    mandatory = F.col("at.tier") < fv.STRESS_MANDATORY_TIERS
    kept = materialise(first.withColumn("position", F.row_number().over(order)).where(mandatory | (F.col("position") <= target_size)))
    sizes = kept.agg(F.count("*").alias("n"), F.count_if(mandatory).alias("m")).first()
    if sizes["m"] > max_size:
        raise ValueError(f"mandatory stress candidates ({sizes['m']}) exceed the maximum size ({max_size})")
    if sizes["n"] < target_size:
        raise ValueError(f"could only build {sizes['n']} stress candidates; target {target_size} is not satisfiable")
    names = F.array(*[F.lit(t) for t in fv.STRESS_TIERS])
    chosen = kept.select("id", "position", names[F.col("at.tier")].alias("tier"))
    return _with_reasons(chosen, narrow, wanted, mined, flags), _pool_sizes(narrow, wanted, mined, flags)


def _with_reasons(chosen: DataFrame, narrow: DataFrame, wanted: DataFrame, mined: DataFrame, flags: dict[str, str]) -> DataFrame:
    """Every pool a chosen id belonged to."""
    def marked(ids: DataFrame, name: str) -> DataFrame:
        return ids.select("id", F.lit(True).alias(name))

    rows = narrow.join(F.broadcast(chosen), "id")  # at most the maximum size
    rows = rows.join(marked(wanted, "_w"), "id", "left").join(marked(mined, "_m"), "id", "left")
    columns = {"expected": "_w", "hard-report-distractor": "_m", **flags}
    reasons = F.array_compact(F.array(*[F.when(F.col(column), F.lit(name)) for name, column in columns.items()]))
    filler = F.array(F.lit("deterministic-filler"))
    return rows.select("id", "position", "tier", F.when(F.size(reasons) > 0, reasons).otherwise(filler).alias("reasons"))


def _pool_sizes(narrow: DataFrame, wanted: DataFrame, mined: DataFrame, flags: dict[str, str]) -> DataFrame:
    """(tier, candidates): how many entities each pool offered."""
    counts = narrow.agg(*[F.count_if(column).alias(column) for column in flags.values()])
    pairs = F.array(*[F.struct(F.lit(name).alias("tier"), F.col(column).alias("candidates")) for name, column in flags.items()])
    wide = counts.select(F.explode(pairs).alias("p")).select("p.*")
    listed = [df.agg(F.count("*").alias("candidates")).select(F.lit(n).alias("tier"), "candidates") for n, df in (("expected", wanted), ("hard-report-distractor", mined))]
    return reduce(DataFrame.unionByName, listed, wide)


def tier_counts(selection: DataFrame) -> DataFrame:
    return selection.groupBy("tier").agg(F.count("*").alias("selected"))
