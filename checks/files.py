"""Files and stores read back whole: every record of a file, every column and one row per point of a store; the
full build-translate-load plan; option, pairing and coverage guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs
from checks.collections import IDENTITY, META, Prefixing, _cache, _documents, _points, _streamed, make_grams, scratch
from checks.dataset import feature_lines
from checks.registry import Tables, register
from terralex.operators import audit, enrich, quality, ranking
from terralex.operators.filters import dataset_options
from terralex.plans import load_collection
from terralex.session import materialise
from terralex.sources import concordance
from terralex.sources.collection_store import CollectionStore
from terralex.sources.entities import read_cases, read_entities
from terralex.streaming import jobs


def _write_arrays(rows, path: str, target: int = 8 << 20) -> None:
    """JSON arrays of about `target` bytes of rows each, dealt by a hash; one file each, as an array is read whole."""
    lines = rows.select(F.to_json(F.struct("*")).alias("j"))
    size = lines.agg(F.coalesce(F.sum(F.octet_length("j")), F.lit(0))).first()[0]
    arrays = lines.groupBy(F.pmod(F.xxhash64("j"), F.lit(size // target + 1)).alias("bucket")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list("j"), ",\n"), F.lit("]")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)


def _forms(t: Tables, rows, reader):
    """The same records as lines and as JSON arrays, each read by its form."""
    lines, array = scratch(t), scratch(t)
    rows.write.json(lines)
    _write_arrays(rows, array)
    return reader(t.spark, lines).withColumn("form", F.lit("lines")).unionByName(reader(t.spark, array, array=True).withColumn("form", F.lit("array")))


@register("S7_case_source", "SELECT f.form, CAST(item_id AS STRING) AS id, md5(text) AS query, 'no-answer' AS category FROM benchmark, (SELECT 'lines' AS form UNION ALL SELECT 'array') f")
def case_source(t: Tables):
    rows = t.table("benchmark").select(
        F.col("item_id").cast("string").alias("id"), F.lit("en").alias("language"), F.col("text").alias("query"), F.array().cast("array<string>").alias("expected_ids"),
        F.lit("no-answer").alias("category"), F.lit(False).alias("answerable"))
    return _forms(t, rows, read_cases).select("form", "id", F.md5("query").alias("query"), "category")


@register("S1_entity_file", "SELECT f.form, 'Q' || CAST(c_custkey + 1 AS STRING) AS id, c_name AS name_en FROM customer, (SELECT 'lines' AS form UNION ALL SELECT 'array') f")
def entity_file(t: Tables):
    rows = t.table("customer").select(
        F.concat(F.lit("Q"), (F.col("c_custkey") + 1).cast("string")).alias("id"), F.lit("city").alias("type"), F.struct(F.col("c_name").alias("en")).alias("name"))
    return _forms(t, rows, read_entities).select("form", "id", F.col("name.en").alias("name_en"))


@register("S11_upsert_repeated_ids", "SELECT vec_id AS entity_key, label + 200 AS label FROM embeddings")
def upsert_repeated_ids(t: Tables):
    """Every point comes three times in one batch; the last by `turn` is stored, once."""
    store = CollectionStore(t.spark, scratch(t), buckets=8)
    points = _points(t).drop("embedding")
    store.insert(points.withColumn("turn", F.lit(-1)).unionByName(points.withColumn("turn", F.lit(-1))))
    turns = points.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("label", F.col("label") + 100 * F.col("turn"))
    store.upsert(turns, order="turn")
    return store.read().select("entity_key", "label")


@register("S11_added_column", "SELECT vec_id AS entity_key, label, CASE WHEN vec_id % 3 = 0 THEN 'new' END AS note FROM embeddings")
def added_column(t: Tables):
    store = CollectionStore(t.spark, scratch(t), buckets=8)
    points = _points(t).drop("embedding")
    store.insert(points)
    store.upsert(points.where("entity_key % 3 = 0").withColumn("note", F.lit("new")))
    return store.read().select("entity_key", "label", "note")


@register(
    "S6_repeated_lines",
    "SELECT 2 * count(*) AS scanned, 2 * count(CASE WHEN gn_id NOT IN (SELECT CAST(geoname_id AS STRING) FROM city_src WHERE population > 300000) THEN 1 END) AS skipped_unmatched, "
    "0 AS invalid FROM wof_src", "wof_src", "city_src")
def repeated_lines(t: Tables):
    """Every line twice, and with a second key so that it names its id twice over."""
    lines = feature_lines(t).select(F.replace("value", F.lit('"wof:concordances":{'), F.lit('"wof:concordances":{"gn:geonameid":"x",')).alias("value"))
    features = concordance.feature_properties(lines.unionAll(lines))
    kept = concordance.worth_parsing(features, t.view("city_src").where("population > 300000").select("geoname_id"))
    return enrich.scan_report(features, concordance.parse_features(kept, "city"))


@register("P7_dataset_options", "SELECT o_orderpriority AS type, 'unsupported_type' AS reason FROM orders GROUP BY 1")
def options_report(t: Tables):
    """Types that the source does not carry are reported, one row each; the kinds asked for come from the data."""
    from unittest import mock

    kinds = [r[0] for r in t.table("orders").select("o_orderpriority").distinct().collect()]  # five values
    from terralex import fixed_values as fv

    with mock.patch.object(fv, "ENTITY_TYPES", (*fv.ENTITY_TYPES, *kinds)):
        skipped = dataset_options(types=["city", *kinds])["skipped"]
    return t.spark.createDataFrame([(s["type"], s["reason"]) for s in skipped], "type string, reason string")


@register(
    "P18_pairing_guard",
    """SELECT o_orderpriority AS collection, v.version, CASE WHEN (v.version = 'v2.1') <> (o_orderpriority = '1-URGENT') THEN 1 ELSE 0 END AS refused
       FROM (SELECT DISTINCT o_orderpriority FROM orders) o, (SELECT 'v1' AS version UNION ALL SELECT 'v2.1') v""")
def pairing_guard(t: Tables):
    names = [r[0] for r in t.table("orders").select("o_orderpriority").distinct().collect()]  # five values
    rows = []
    for name in names:
        for version in ("v1", "v2.1"):
            try:
                audit.check_pairing(version, name, {"v2.1": "1-URGENT"})
                rows.append((name, version, 0))
            except ValueError:
                rows.append((name, version, 1))
    return t.spark.createDataFrame(rows, "collection string, version string, refused int")


@register(
    "A2_coverage_gate",
    """SELECT r.continent, CASE WHEN n.cities >= 5000 AND r.continent IN ('North America', 'South America') THEN 1 ELSE 0 END AS failures
       FROM (SELECT DISTINCT continent FROM country_src) r, (SELECT count(*) * 100 AS cities FROM ent WHERE type = 'city') n""", "ent", "country_src")
def coverage_gate(t: Tables):
    """One continent removed at a time, as if there were a hundred times the cities."""
    rows = materialise(inputs.entities(t))
    summary = quality.coverage(rows).first().asDict()
    counts = {r["continent"]: r["entities"] for r in quality.continent_coverage(rows).collect()}
    found = [(gone, len(quality.coverage_failures(summary["city_count"] * 100, counts | {gone: 0}))) for gone, n in counts.items() if n]
    return t.spark.createDataFrame(found, "continent string, failures int")


@register(
    "T3_wide_overfetch",
    "SELECT case_id, id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, id) AS r FROM top WHERE id % 8 = 3) x WHERE r <= 10",
    then=inputs.sql_ranked(100))
def wide_overfetch(t: Tables):
    """One candidate in eight is accepted, so ten results need far more than twenty candidates."""
    kept = inputs.ranked(t, 100).where("id % 8 = 3").withColumnRenamed("query_id", "case_id")
    limits = t.view("cases").select(F.col("id").alias("case_id"), F.lit(10).alias("limit"))
    return ranking.trim_results(kept, limits).select("case_id", "id", F.col("rank").cast("bigint").alias("rank"))


@register(
    "C8_build_translate_load",
    """SELECT 'ns:doc' || CAST(doc_id AS STRING) AS entity_id, CASE WHEN native THEN 'native' WHEN cached THEN md5('CACHED ' || t) ELSE md5('VI ' || t) END AS vi,
              (SELECT count(*) FROM d WHERE NOT native) AS translated, (SELECT count(*) FROM d) AS upserted FROM w""",
    then={"d": "SELECT doc_id, trim(text, chr(9) || chr(10) || chr(13) || ' ') AS t, doc_id % 4 = 0 AS native FROM documents",
          "c": "SELECT DISTINCT t FROM d WHERE doc_id % 2 = 0", "w": "SELECT d.*, c.t IS NOT NULL AS cached FROM d LEFT JOIN c USING (t)"})
def build_translate_load(t: Tables):
    store = CollectionStore(t.spark, scratch(t))
    outcome = load_collection.build_translate_load(
        lambda: (_documents(t), {}), load=lambda rows: load_collection.load_collection(rows, store, make_grams, META, "v2.1"),
        make_translator=Prefixing, cache=_cache(t), identity=IDENTITY)
    done = outcome["entities"].select(F.col("id").alias("entity_id"), F.when(F.col("language_provenance.description_vi") == "machine_translation", F.md5("description.vi")).otherwise(F.col("description.vi")).alias("vi"))
    return store.read().select("entity_id").join(done, "entity_id").select(
        "entity_id", "vi", F.lit(outcome["translation"]["translatedCandidates"]).cast("bigint").alias("translated"), F.lit(outcome["seed"]["upserted"]).cast("bigint").alias("upserted"))


@register(
    "R1_load_stream", "SELECT 'geonames:' || type || ':' || geoname_id AS entity_id, 64 AS size, (SELECT count(*) FROM ent) AS recorded FROM ent", "ent")
def load_stream(t: Tables):
    """Entities loaded from a stream, twice from the start; the progress table counts every point once."""
    folder, progress = scratch(t), scratch(t)
    inputs.entities(t).write.parquet(folder)
    store = CollectionStore(t.spark, scratch(t), buckets=8)
    stream = t.spark.readStream.schema(t.spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 4).parquet(folder)
    for _ in range(2):
        jobs.load_stream(stream, store, make_grams, META | {"index_fingerprint": "agreed"}, scratch(t), "v2.1", progress_path=progress).awaitTermination()
    jobs.verify_stream(store, "agreed", t.spark.read.parquet(folder).count())
    recorded = jobs.read_progress(t.spark, progress).agg(F.sum("upserted")).first()[0]
    return store.read().select("entity_id", F.size("embedding").cast("bigint").alias("size"), F.lit(recorded).cast("bigint").alias("recorded"))
