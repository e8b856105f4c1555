"""Translation, collection, streaming, candidate-set and experiment queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import dataset, inputs
from checks.registry import Tables, register, rounded
from terralex import fixed_values as fv
from terralex import schema
from terralex.functions.ids import uuid_v5
from terralex.operators import audit, candidates, fingerprint, stats, translate
from terralex.operators.embed import CharacterGrams, embed_distinct, embed_texts
from terralex.operators.knn import top_k
from terralex.operators.normalize import gazetteer_id
from terralex.operators.validate import normalise_entities
from terralex.plans import evaluate, load_collection
from terralex.plans.build_dataset import Dumps, build_dataset
from terralex.session import ensure_checkpoint_dir, fail_on_errors, materialise
from terralex.sources import logs
from terralex.sources.collection_store import CollectionStore
from terralex.sources.entities import read_json_document, write_dataset, write_report
from terralex.streaming import jobs


def scratch(t: Tables) -> str:
    """A fresh folder under the session's shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(t.spark)}/{uuid.uuid4().hex}"


# ---------------------------------------------------------------- translation

IDENTITY = translate.TranslationIdentity("prov", "m", "p1")


class Prefixing:
    """A stand-in translator: marks the text it was given."""

    def translate(self, texts):
        return [f"VI {text}" for text in texts]


_T = "trim(text, chr(9) || chr(10) || chr(13) || ' ')"
_DOCS = {
    "d": f"SELECT doc_id, {_T} AS t, doc_id % 4 = 0 AS native FROM documents",
    "c": "SELECT DISTINCT t FROM d WHERE doc_id % 2 = 0",
    "w": "SELECT d.*, c.t IS NOT NULL AS cached FROM d LEFT JOIN c USING (t)",
}


def _documents(t: Tables):
    key = F.col("doc_id")
    none = F.lit(None).cast("string")
    rows = t.table("documents").select(
        F.concat(F.lit("ns:doc"), key.cast("string")).alias("id"), F.lit("landmark").alias("type"),
        F.struct(F.concat(F.lit("d"), key.cast("string")).alias("en"), none.alias("vi")).alias("name"),
        F.struct(F.col("text").alias("en"), F.when(key % 4 == 0, "native").alias("vi")).alias("description"))
    return fail_on_errors(normalise_entities(rows))


def _cache(t: Tables):
    """Cached translations of the texts of even documents, with an older record per key that must lose."""
    even = _documents(t).where(F.substring("id", 7, 20).cast("bigint") % 2 == 0)
    keyed = translate.keyed_texts(even.select("id", F.lit("description").alias("field"), F.col("description.en").alias("text")), IDENTITY)
    metadata = F.struct(*[F.lit(f).alias(f) for f in schema.TRANSLATION.names])
    both = keyed.select("key", F.explode(F.array(F.struct(F.lit(1).alias("n"), F.lit("old").alias("text")),
                                                 F.struct(F.lit(2).alias("n"), F.concat(F.lit("CACHED "), F.col("text")).alias("text")))).alias("r"), metadata.alias("metadata"))
    return translate.latest_records(both.select("key", "r.text", "metadata", F.col("r.n").alias("n")), "n")


@register("S9_latest_cache_record", "SELECT CAST(o_custkey AS STRING) AS key, arg_max(o_orderpriority, o_orderkey) AS text FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def latest_cache_record(t: Tables):
    metadata = F.struct(*[F.lit("x").alias(f) for f in schema.TRANSLATION.names])
    rows = t.table("orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderpriority").alias("text"),
                                    F.when(F.col("o_orderstatus") != "P", metadata).alias("metadata"), "o_orderkey")
    return translate.latest_records(rows, "o_orderkey").select("key", "text")


@register(
    "S9_cache_append_read",
    "SELECT c_mktsegment || CAST(c_custkey % 50 AS STRING) AS key, max(c_custkey % 50) || ' second' AS text FROM customer GROUP BY 1")
def cache_append_read(t: Tables):
    path = scratch(t)
    metadata = F.struct(*[F.lit("x").alias(f) for f in schema.TRANSLATION.names])
    rows = t.table("customer").select(F.concat("c_mktsegment", (F.col("c_custkey") % 50).cast("string")).alias("key"), (F.col("c_custkey") % 50).cast("string").alias("n")).distinct()
    for word in ("first", "second"):
        logs.append_cache(rows.select("key", F.concat("n", F.lit(f" {word}")).alias("text"), metadata.alias("metadata")), path)
    return logs.read_cache(t.spark, path).select("key", "text")


@register("P14_translation_candidates", "SELECT 'ns:doc' || CAST(doc_id AS STRING) AS id FROM d WHERE NOT native AND t <> ''", then=_DOCS)
def translation_candidates(t: Tables):
    return translate.translation_candidates(_documents(t), ["description"]).select("id")


@register("J10_cache_misses", "SELECT md5(t) AS text FROM w WHERE NOT native AND NOT cached GROUP BY t", then=_DOCS)
def cache_misses(t: Tables):
    keyed = translate.keyed_texts(translate.translation_candidates(_documents(t)), IDENTITY)
    return translate.cache_misses(keyed, _cache(t)).select(F.md5("text").alias("text"))


@register(
    "C6_X3_translate_missing",
    """SELECT 'ns:doc' || CAST(doc_id AS STRING) AS id, md5(CASE WHEN native THEN 'native' WHEN cached THEN 'CACHED ' || t ELSE 'VI ' || t END) AS vi,
              CASE WHEN native THEN 'wikidata' ELSE 'machine_translation' END AS provenance, CASE WHEN native THEN 0 ELSE 1 END AS entries FROM w""", then=_DOCS)
def translate_missing(t: Tables):
    done, _ = translate.translate_missing(_documents(t), _cache(t), Prefixing, IDENTITY)
    return done.select("id", F.md5("description.vi").alias("vi"), F.col("language_provenance.description_vi").alias("provenance"),
                       F.size("translation_metadata").cast("bigint").alias("entries"))


@register("A22_translation_report", "SELECT count(*) AS candidates, count(*) AS translated, 0 AS remaining FROM d WHERE NOT native", then=_DOCS)
def translation_report(t: Tables):
    before = _documents(t)
    after, _ = translate.translate_missing(before, _cache(t), Prefixing, IDENTITY)
    return translate.translation_report(before, after, ["description"])


# ---------------------------------------------------------------- collection state

def _points(t: Tables):
    fp = F.when(F.col("vec_id") % 7 == 0, "other").otherwise("fp")
    return t.table("embeddings").select(
        uuid_v5(F.col("vec_id").cast("string")).alias("point_id"), F.col("vec_id").alias("entity_key"), "label", "embedding", fp.alias("index_fingerprint"))


@register(
    "S11_upsert",
    "SELECT vec_id AS entity_key, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings")
def upsert(t: Tables):
    """Two thirds are stored first, then all multiples of three arrive or change."""
    store = CollectionStore(t.spark, scratch(t), buckets=8)
    points = _points(t).drop("embedding")
    store.insert(points.where("entity_key % 3 <> 0 OR entity_key % 2 = 0"))
    store.upsert(points.where("entity_key % 3 = 0").withColumn("label", F.col("label") + 100))
    return store.read().select("entity_key", "label")


@register("J13_resume_missing", "SELECT vec_id AS entity_key FROM embeddings WHERE label >= 5")
def resume_missing(t: Tables):
    points = _points(t)
    return load_collection.missing_points(points, points.where("label < 5")).select("entity_key")


@register(
    "A16_collection_counts",
    "SELECT count(*) AS points, count(CASE WHEN vec_id % 7 <> 0 THEN 1 END) AS matching FROM embeddings")
def collection_counts(t: Tables):
    return audit.collection_counts(_points(t), "fp")


RUNTIME = {"backend": "torch", "implementation": "tf", "semantic": True, "profile": "q3", "dtype": "fp16"}


def _provenance(t: Tables):
    key = F.col("event_id")
    fields = {"backend": "torch", "implementation": "tf", "profile": "q3", "dtype": "fp16"}
    return t.table("events").select(
        *[(F.when(key % 11 != i, v).otherwise("x") if f != "dtype" else F.when(key % 2 == 0, v).otherwise("fp32")).alias(f"embedding_{f}") for i, (f, v) in enumerate(fields.items())],
        (key % 5 != 0).alias("embedding_semantic"), F.lit("m").alias("embedding_model"), F.lit("v2.1").alias("embedding_text_version"),
        *[F.lit(None).cast("string").alias(f"embedding_{f}") for f in ("accelerator", "device", "runtime", "query_strategy", "query_instruction_id", "document_strategy")])


@register(
    "A17_C9_provenance_audit",
    """SELECT 'strict' AS comparison, count(*) AS points, count(CASE WHEN event_id % 5 <> 0 AND event_id % 11 NOT IN (0, 1, 2) AND event_id % 2 = 0 THEN 1 END) AS matching
       FROM events UNION ALL SELECT 'semantic', count(*), count(CASE WHEN event_id % 5 <> 0 AND event_id % 11 <> 2 THEN 1 END) FROM events""")
def provenance_audit(t: Tables):
    rows = _provenance(t)
    strict = audit.provenance_counts(rows, RUNTIME, "m", "v2.1").withColumn("comparison", F.lit("strict"))
    return strict.unionByName(audit.provenance_counts(rows, RUNTIME, "m", "v2.1", semantic_only=True).withColumn("comparison", F.lit("semantic")))


@register("A18_digest_sums", "SELECT count(*) AS entities, " + ", ".join(
    f"CAST(sum(CAST('0x' || substr(sha256(text), {8 * i + 1}, 8) AS BIGINT)) AS DOUBLE) AS w{i}" for i in range(8)) + " FROM documents")
def digest_sums(t: Tables):
    sums = fingerprint.digest_sums(t.table("documents"), F.sha2("text", 256))
    return sums.select("entities", *[F.col(f"w{i}").cast("double").alias(f"w{i}") for i in range(8)])


@register("A18_fingerprint_properties", "SELECT TRUE AS order_free, TRUE AS content_sensitive, TRUE AS version_sensitive, TRUE AS identity_sensitive, count(*) AS entities FROM ent", "ent")
def fingerprint_properties(t: Tables):
    rows = inputs.stored_entities(t)
    meta = {"embedding_model": "m", "embedding_version": "1", "dataset_version": "d"}
    base = fingerprint.index_fingerprint(rows, meta)
    shuffled = fingerprint.index_fingerprint(rows.repartition(5, "region").select(*reversed(rows.columns)), meta)
    edited = fingerprint.index_fingerprint(rows.withColumn("population", F.coalesce("population", F.lit(0)) + 1), meta)
    version = fingerprint.index_fingerprint(rows, meta, "v2.1")
    identity = fingerprint.index_fingerprint(rows, meta | {"embedding_model": "other"})
    values = [base["value"] == shuffled["value"]] + [base["value"] != o["value"] for o in (edited, version, identity)]
    # The outcome row is built from the table so that it has the table's size in it.
    names = ("order_free", "content_sensitive", "version_sensitive", "identity_sensitive")
    return rows.agg(F.count("*").alias("entities")).select(*[F.lit(v).alias(n) for n, v in zip(names, values)], "entities")


@register("A26_collection_stats", "SELECT count(*) AS points, min(len(embedding)) AS min_dimension, max(len(embedding)) AS max_dimension FROM embeddings")
def collection_stats(t: Tables):
    return audit.collection_stats(t.table("embeddings"))


@register("C26_compatibility", "SELECT 'fingerprint mismatch: ' || count(CASE WHEN vec_id % 7 <> 0 THEN 1 END) || ' of ' || count(*) || ' points match' AS problem FROM embeddings")
def compatibility(t: Tables):
    points = _points(t)
    total = points.count()
    found = audit.compatibility(points, 64, total, "fp")
    return t.spark.createDataFrame([(p,) for p in found], "problem string")


# ---------------------------------------------------------------- embedding and loading

def make_grams() -> CharacterGrams:
    return CharacterGrams(64)


@register("X1_embed_documents", "SELECT doc_id, 64 AS size, CAST(1 AS DOUBLE) AS norm FROM documents")
def embed_documents(t: Tables):
    rows = embed_texts(t.table("documents").select("doc_id", "text"), "text", make_grams, parallelism=t.spark.sparkContext.defaultParallelism)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return rows.select("doc_id", F.size("embedding").cast("bigint").alias("size"), F.round(norm, 4).alias("norm"))


@register("X2_embed_distinct_queries", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) AS vector_of FROM orders")
def embed_distinct_queries(t: Tables):
    """Equal texts share one vector: the vector's identity is the text's."""
    rows = embed_distinct(t.table("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", make_grams)
    texts = F.array_sort(F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]))
    known = t.table("orders").select("o_orderpriority").distinct().select(F.array_position(texts, F.col("o_orderpriority")).alias("vector_of"), F.col("o_orderpriority").alias("text"))
    vectors = embed_texts(known, "text", make_grams, output="v").select("vector_of", F.hash("v").alias("h"))
    return rows.select("o_orderkey", F.hash("embedding").alias("h")).join(vectors, "h").select("o_orderkey", "vector_of")


META = {"embedding_model": "grams", "embedding_version": "1", "dataset_version": "d", "embedding_runtime": {"backend": "local", "implementation": "grams", "semantic": True}}


@register("C7_load_collection", "SELECT 'geonames:' || type || ':' || geoname_id AS entity_id, 'fresh|idempotent' AS modes, 64 AS size FROM ent", "ent")
def load(t: Tables):
    """Load, then load again: the second run changes nothing."""
    store = CollectionStore(t.spark, scratch(t), buckets=8)
    rows = inputs.stored_entities(t)
    modes = [load_collection.load_collection(rows, store, make_grams, META, "v2.1")["mode"] for _ in range(2)]
    return store.read().select("entity_id", F.lit("|".join(modes)).alias("modes"), F.size("embedding").cast("bigint").alias("size"))


@register("C7_resume_load", "SELECT count(*) AS points, 'resume' AS mode, count(CASE WHEN type = 'country' THEN 1 END) AS upserted FROM ent", "ent")
def resume_load(t: Tables):
    """A load interrupted after the cities writes only the countries."""
    store = CollectionStore(t.spark, scratch(t), buckets=8)
    rows = inputs.stored_entities(t)
    value = fingerprint.index_fingerprint(rows, META, "v2.1")["value"]
    cities = load_collection.to_points(rows.where("type = 'city'"), META | {"index_fingerprint": value}, "v2.1")
    store.insert(embed_texts(cities, "document", make_grams))
    report = load_collection.load_collection(rows, store, make_grams, META, "v2.1")
    return store.read().agg(F.count("*").alias("points")).select("points", F.lit(report["mode"]).alias("mode"), F.lit(report["upserted"]).cast("bigint").alias("upserted"))


@register(
    "C8_plan_dry_run", "SELECT count(*) AS entities, count(CASE WHEN NOT native THEN 1 END) AS candidates FROM d", then=_DOCS)
def plan_dry_run(t: Tables):
    outcome = load_collection.build_translate_load(
        lambda: (_documents(t), {}), load=lambda rows: {}, make_translator=Prefixing, cache=_cache(t), identity=IDENTITY, dry_run=True)
    plan = outcome["plan"]
    return t.spark.createDataFrame([(plan["entities"], plan["translationCandidates"])], "entities bigint, candidates bigint")


@register("C7_search_loaded", "SELECT id AS query_id, CAST(1 AS DOUBLE) AS score FROM ent", "ent")
def search_loaded(t: Tables):
    """Every entity's document text finds a document with the same vector in the loaded collection."""
    store = CollectionStore(t.spark, scratch(t), buckets=8)
    load_collection.load_collection(inputs.stored_entities(t), store, make_grams, META, "v2.1")
    points = store.read()
    documents = points.select(F.col("entity_id").alias("query_id"), "document")
    embedded = embed_distinct(documents, "document", make_grams, parallelism=4 * t.spark.sparkContext.defaultParallelism)
    queries = materialise(embedded.select("query_id", "embedding"))  # the search reads them several times
    found = top_k(queries, load_collection.resolve_vectors(points), 1)
    return found.select("query_id", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- whole dataset build

_BUILD = {
    "base": f"SELECT * FROM ent",
    "nm": """SELECT geoname_id, language, name FROM (SELECT *, row_number() OVER (PARTITION BY geoname_id, language ORDER BY preferred DESC, short_name DESC, alternate_name_id) AS rn
             FROM (SELECT * REPLACE (CASE WHEN language = 'vi' THEN 'Đảo ' || name ELSE name END AS name) FROM alt_src WHERE language IN ('en', 'vi') AND NOT historic) e) x WHERE rn = 1""",
    "cand": "SELECT * FROM wof_src WHERE placetype = 'locality' AND is_current AND gn_id <> '0'",
    "per": "SELECT gn_id, count(DISTINCT wof_id) AS n, min(wof_id) AS wof_id FROM cand GROUP BY gn_id",
    "built": """SELECT b.id, coalesce(w.name_en, en.name, b.name_en) AS name_en, coalesce(vi.name, w.name_vi) AS name_vi, w.wof_id FROM base b
                LEFT JOIN nm en ON en.geoname_id = b.geoname_id AND en.language = 'en' LEFT JOIN nm vi ON vi.geoname_id = b.geoname_id AND vi.language = 'vi'
                LEFT JOIN per ON per.gn_id = CAST(b.geoname_id AS STRING) AND b.type = 'city' AND per.n = 1 LEFT JOIN cand w ON w.wof_id = per.wof_id""",
}


@register("C4_build_dataset", "SELECT id, name_en, name_vi, wof_id FROM built", "ent", "alt_src", "wof_src", then=_BUILD)
def build(t: Tables):
    """All stages from raw lines; the country source of the concordance is missing, which only affects countries."""
    entities, _ = build_dataset(_dumps(t))
    return entities.select("id", F.col("name.en").alias("name_en"), F.col("name.vi").alias("name_vi"), F.col("facts.wof_id").alias("wof_id"))


def _dumps(t: Tables) -> Dumps:
    return Dumps(dataset.city_lines(t, broken=False), dataset.country_lines(t), dataset.admin1_lines(t), dataset.alternate_lines(t),
                 {"city": lambda: dataset.feature_lines(t)})


@register(
    "C4_S10_manifest",
    "SELECT (SELECT count(*) FROM ent) AS before_limit, (SELECT count(*) FROM built) AS total, (SELECT count(wof_id) FROM built) AS matched, 'partial' AS status, "
    "(SELECT count(*) FROM wof_src) AS scanned", "ent", "alt_src", "wof_src", then=_BUILD)
def manifest(t: Tables):
    """Dataset and manifest written and read back."""
    path = scratch(t)
    write_dataset(*build_dataset(_dumps(t)), path)
    m = read_json_document(t.spark, f"{path}/manifest")
    stored = t.spark.read.parquet(f"{path}/entities")
    w = m["wofEnrichment"]
    return stored.agg(F.count("*").alias("total")).select(
        F.lit(m["mergedCountBeforeLimit"]).cast("bigint").alias("before_limit"), "total", F.lit(w["matched"]).cast("bigint").alias("matched"),
        F.lit(w["status"]).alias("status"), F.lit(w["scanned"]).cast("bigint").alias("scanned"))


@register("S8_S13_report_roundtrip", "SELECT case_id, hit_at_5::BIGINT AS hit_at_5 FROM evidence", "cases", then=inputs.sql_evidence(clamp=True))
def report_roundtrip(t: Tables):
    path = scratch(t)
    evidence = inputs.evidence(t, clamp=True)
    write_report({"evidence": evidence}, {"experiment": "check"}, path)
    return t.spark.read.parquet(f"{path}/evidence").select("case_id", F.col("hit_at_5").cast("bigint").alias("hit_at_5"))


# ---------------------------------------------------------------- candidate sets

_CAND = {
    "ents": """SELECT *, CASE WHEN type = 'city' AND geoname_id % 10 = 3 THEN 'near ' || (SELECT k.capital FROM country_src k WHERE k.iso2 = ent.country_code) END AS descr FROM ent""",
    "exp": "SELECT id, 'c' || lpad(CAST(geoname_id AS STRING), 2, '0') AS case_id, country_code, name_en, capital, continent, population FROM ents WHERE type = 'country' AND continent IN ('Africa', 'Asia')",
    "res": """SELECT 'c' || lpad(CAST(k.geoname_id AS STRING), 2, '0') AS case_id, e.id, row_number() OVER (PARTITION BY k.geoname_id ORDER BY e.geoname_id) AS rank
              FROM ents e JOIN country_src k ON k.iso2 = e.country_code WHERE e.type = 'city' AND k.continent IN ('Africa', 'Asia')""",
    "res5": "SELECT * FROM res WHERE rank <= 5",
}


def _candidate_inputs(t: Tables, continents: str = "continent IN ('Africa', 'Asia')", results_per_case: int | None = 5):
    """(cases, the first results of each as in a report, entities); the SQL above keeps the cases of two continents."""
    near = F.when((F.col("type") == "city") & (gazetteer_id() % 10 == 3), F.concat(F.lit("near "), F.col("_cap")))
    caps = t.view("country_src").select(F.col("iso2").alias("country_code"), F.col("capital").alias("_cap"))
    rows = materialise(inputs.entities(t).join(caps, "country_code").withColumn("description", F.col("description").withField("en", near)).drop("_cap"))
    cases = t.view("country_src").where(continents).select(
        F.concat(F.lit("c"), F.lpad(F.col("geoname_id").cast("string"), 2, "0")).alias("id"), F.lit("en").alias("language"),
        F.concat(F.lit("Which country is "), F.col("country_name")).alias("query"),
        F.array(F.concat(F.lit("geonames:country:"), F.col("geoname_id").cast("string"))).alias("expected_ids"),
        F.lit("country-factual").alias("category"), F.when(F.col("geoname_id") % 2 == 0, "no-diacritics").alias("challenge"), F.lit(True).alias("answerable"))
    from pyspark.sql import Window

    order = Window.partitionBy("case_id").orderBy("n")
    results = t.view("ent").where("type = 'city'").where(continents).join(
        t.view("country_src").select(F.col("iso2").alias("country_code"), F.col("geoname_id").alias("k")), "country_code"
    ).select(F.concat(F.lit("c"), F.lpad(F.col("k").cast("string"), 2, "0")).alias("case_id"), "id", F.col("geoname_id").alias("n")).withColumn(
        "rank", F.row_number().over(order)).select("case_id", "rank", "id")
    return cases, results if results_per_case is None else results.where(F.col("rank") <= results_per_case), rows


@register("J14_distractors", "SELECT id, min(case_id) AS first_case FROM res5 GROUP BY id", "ent", then=_CAND)
def distractors(t: Tables):
    cases, results, _ = _candidate_inputs(t)
    return candidates.mine_distractors(results, cases).select("id", F.col("seq.a").alias("first_case"))


_FOCUS = ("c00", "c02")
_FOCUSED = _CAND | {
    "need": "SELECT id, 'expected' AS reason FROM exp UNION ALL SELECT DISTINCT id, 'distractor' FROM res5 WHERE case_id IN ('c00', 'c02')",
    "fill": """SELECT id, 'related' AS reason FROM (SELECT id, CASE WHEN name_en IN (SELECT name_en FROM exp) THEN 8 ELSE 0 END + CASE WHEN country IN (SELECT name_en FROM exp) THEN 8 ELSE 0 END
               + CASE WHEN country_code IN (SELECT country_code FROM exp) THEN 4 ELSE 0 END + CASE WHEN continent IN (SELECT continent FROM exp) THEN 1 ELSE 0 END AS score FROM ents
               WHERE id NOT IN (SELECT id FROM need)) x ORDER BY score DESC, id LIMIT (SELECT 75 - count(*) FROM need)""",
}


@register("T4_F20_U2_focused_candidates", "SELECT id, reason FROM need UNION ALL SELECT id, reason FROM fill", "ent", then=_FOCUSED)
def focused_candidates(t: Tables):
    return candidates.focused_candidates(*_candidate_inputs(t), focus_case_ids=_FOCUS).select("id", "reason")


_STRESS = _CAND | {
    "flags": """SELECT e.*, type = 'country' AS f0, coalesce(is_capital, FALSE) AS f1, id IN (SELECT id FROM exp) AS f2, id IN (SELECT id FROM res5) AS f3,
                type = 'city' AND NOT is_capital AND EXISTS (SELECT 1 FROM exp WHERE contains(lower(concat_ws(chr(10), e.name_en, e.region, e.descr)), lower(exp.capital))) AS f4,
                type = 'city' AND NOT is_capital AND country_code IN (SELECT country_code FROM exp) AS f5, type = 'city' AND NOT is_capital AS f6 FROM ents e""",
    "tiered": """SELECT *, CASE WHEN f0 THEN 0 WHEN f1 THEN 1 WHEN f2 THEN 2 WHEN f3 THEN 3 WHEN f4 THEN 4 WHEN f5 THEN 5 WHEN f6 THEN 6 ELSE 7 END AS tier FROM flags""",
    "placed": """SELECT *, row_number() OVER (ORDER BY tier, CASE WHEN tier >= 4 THEN -coalesce(population, -1) END, id) AS pos FROM tiered""",
    "kept": """SELECT *, concat_ws('|', CASE WHEN f2 THEN 'expected' END, CASE WHEN f3 THEN 'hard-report-distractor' END, CASE WHEN f0 THEN 'all-country' END,
               CASE WHEN f1 THEN 'all-capital-city' END, CASE WHEN f4 THEN 'capital-locality' END, CASE WHEN f5 THEN 'related-major-city' END, CASE WHEN f6 THEN 'global-major-city' END) AS reasons
               FROM placed WHERE tier < 4 OR pos <= 140""",
}


@register("T5_W8_A19_stress_candidates", "SELECT id, reasons, tier FROM kept", "ent", then=_STRESS)
def stress_candidates(t: Tables):
    selection, _ = candidates.stress_candidates(*_candidate_inputs(t), target_size=140, max_size=400)
    tiers = F.array(*[F.lit(x) for x in fv.STRESS_TIERS])
    return selection.select("id", F.array_join("reasons", "|").alias("reasons"), (F.array_position(tiers, F.col("tier")) - 1).alias("tier"))


@register("A19_tier_counts", "SELECT tier, count(*) AS selected FROM kept GROUP BY tier", "ent", then=_STRESS)
def tier_counts(t: Tables):
    selection, _ = candidates.stress_candidates(*_candidate_inputs(t), target_size=140, max_size=400)
    tiers = F.array(*[F.lit(x) for x in fv.STRESS_TIERS])
    return candidates.tier_counts(selection).select((F.array_position(tiers, F.col("tier")) - 1).alias("tier"), "selected")


@register(
    "A19_F21_pool_sizes",
    "SELECT x.tier, x.candidates FROM (SELECT 'all-country' AS tier, count(CASE WHEN f0 THEN 1 END) AS candidates FROM flags UNION ALL SELECT 'all-capital-city', count(CASE WHEN f1 THEN 1 END) FROM flags "
    "UNION ALL SELECT 'expected', count(CASE WHEN f2 THEN 1 END) FROM flags UNION ALL SELECT 'hard-report-distractor', count(CASE WHEN f3 THEN 1 END) FROM flags "
    "UNION ALL SELECT 'capital-locality', count(CASE WHEN f4 THEN 1 END) FROM flags UNION ALL SELECT 'related-major-city', count(CASE WHEN f5 THEN 1 END) FROM flags "
    "UNION ALL SELECT 'global-major-city', count(CASE WHEN f6 THEN 1 END) FROM flags) x", "ent", then=_STRESS)
def pool_sizes(t: Tables):
    _, sizes = candidates.stress_candidates(*_candidate_inputs(t), target_size=140, max_size=400)
    return sizes


@register("C14_C11_text_experiment")
def text_experiment(t: Tables):
    """Two document texts over one candidate set, for the cases of all countries; the embedder is outside SQL."""
    cases, results, rows = _candidate_inputs(t, continents="true")
    selection = candidates.focused_candidates(cases, results, rows, _FOCUS)
    outcome = evaluate.text_experiment(cases, rows, selection, make_grams)
    return rounded(outcome["deltas"].select("scope", "language", "category", "challenge", "delta_mrr", "delta_recall_at_1"), "delta_mrr", "delta_recall_at_1")


# ---------------------------------------------------------------- progress, statistics, streams

_BATCHES = {
    "b": "SELECT o_orderstatus AS run_id, o_orderkey + 1 AS batch, 1000000 AS total, o_orderkey % 64 AS embedded, o_orderkey % 60 AS upserted, o_orderkey % 4 AS skipped, "
         "o_totalprice / 100 AS ms FROM orders",
    "steps": """SELECT run_id, CASE WHEN batch = 1 THEN 0 ELSE CAST(ceil(batch / 500.0) AS BIGINT) END AS step, max(batch) AS batch, max(total) AS total, sum(embedded)::BIGINT AS embedded,
                sum(upserted)::BIGINT AS upserted, sum(skipped)::BIGINT AS skipped, sum(ms) AS ms FROM b GROUP BY 1, 2""",
    "cum": """SELECT run_id, batch, total, sum(embedded) OVER w AS embedded, sum(upserted) OVER w AS upserted, sum(skipped) OVER w AS skipped, sum(ms) OVER w AS ms FROM steps
              WINDOW w AS (PARTITION BY run_id ORDER BY batch ROWS UNBOUNDED PRECEDING)""",
    "one": "SELECT run_id, max(batch) AS batch, max(total) AS total, sum(embedded)::BIGINT AS embedded, sum(upserted)::BIGINT AS upserted, sum(skipped)::BIGINT AS skipped, sum(ms) AS ms FROM b GROUP BY 1",
}


def _progress_sql(source: str) -> str:
    return f"""SELECT run_id, batch, embedded::BIGINT AS embedded, upserted::BIGINT AS upserted, round(least(100, (upserted + skipped) * 100.0 / total), 3) AS percent, round(upserted / (ms / 1000), 3) AS rate_per_second,
               round(CASE WHEN upserted > 0 AND total - upserted - skipped > 0 THEN (total - upserted - skipped) / (upserted / (ms / 1000)) * 1000 ELSE 0 END, 3) AS eta_ms FROM {source}"""


def _batches(df):
    key = F.col("o_orderkey")
    ms = F.col("o_totalprice") / 100
    return df.select(
        F.col("o_orderstatus").alias("run_id"), (key + 1).alias("batch"), F.lit(1_000_000).cast("bigint").alias("total"), (key % 64).alias("embedded"),
        (key % 60).alias("upserted"), (key % 4).alias("skipped_existing"), ms.alias("elapsed_ms"), (ms / 2).alias("embedding_ms"), (ms / 4).alias("upsert_ms"))


_PROGRESS = ("run_id", "batch", "embedded", "upserted", "percent", "rate_per_second", "eta_ms")


@register("A20_load_progress", _progress_sql("cum"), then=_BATCHES)
def load_progress(t: Tables):
    return stats.progress_snapshots(_batches(t.table("orders")), 500).select(*_PROGRESS)


@register("S12_progress_log", _progress_sql("one"), then=_BATCHES)
def progress_log(t: Tables):
    path = scratch(t)
    logs.append_progress(stats.progress_snapshots(_batches(t.table("orders")), 500), path)
    return logs.latest_progress(t.spark, path).select(*_PROGRESS)


_REQUESTS = """SELECT event_type AS kind, count(*) AS requests, sum(event_id % 7)::BIGINT AS items, round(sum(value), 3) AS inference_ms,
               arg_max(event_id % 7, struct_pack(ts := ts, e := event_id)) AS last_batch_size FROM events GROUP BY 1"""


def _requests(df):
    return df.select(F.col("event_type").alias("kind"), (F.col("event_id") % 7).alias("items"), F.col("value").alias("inference_ms"), "ts", F.col("event_id").alias("request_id"))


@register("A21_request_statistics", _REQUESTS)
def request_statistics(t: Tables):
    return stats.request_statistics(_requests(t.table("events")))


def _streamed(t: Tables, table: str, files: int = 4):
    """The table as a stream of several files, one per batch."""
    path = scratch(t)
    source = t.table(table)
    source.repartition(files).write.parquet(path)
    return t.spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run_to_table(t: Tables, stream):
    """Run an aggregation stream to the end; each batch rewrites the full result."""
    folder = scratch(t)
    latest = {}

    def each(batch, batch_id):
        latest["path"] = f"{folder}/out/{batch_id}"
        batch.write.mode("overwrite").parquet(latest["path"])

    query = stream.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return t.spark.read.parquet(latest["path"])


@register("R3_streaming_request_statistics", _REQUESTS)
def streaming_request_statistics(t: Tables):
    return _run_to_table(t, jobs.request_statistics_stream(_requests(_streamed(t, "events"))))


@register("R2_streaming_progress", _progress_sql("one"), then=_BATCHES)
def streaming_progress(t: Tables):
    return _run_to_table(t, jobs.progress_stream(_batches(_streamed(t, "orders")))).select(*_PROGRESS)


@register("R1_streaming_load", "SELECT vec_id AS entity_key, label FROM embeddings")
def streaming_load(t: Tables):
    """The stream is run twice from the start: the second run finds everything present."""
    store = CollectionStore(t.spark, scratch(t), buckets=8)
    stream = _streamed(t, "embeddings").select(
        uuid_v5(F.col("vec_id").cast("string")).alias("point_id"), F.col("vec_id").alias("entity_key"), "label", "embedding")
    for _ in range(2):
        jobs.load_vectors_stream(stream, store, scratch(t)).awaitTermination()
    return store.read().select("entity_key", "label")


@register("R4_streaming_search", "SELECT case_id AS query_id, id, rank FROM top WHERE score >= 0", then=inputs.sql_ranked())
def streaming_search(t: Tables):
    from terralex.plans.search import SearchOptions

    path = scratch(t)
    stream = _streamed(t, "embeddings", 2).select(F.col("vec_id").alias("query_id"), F.reverse("embedding").alias("embedding"), F.lit("plain words").alias("query"))
    facts = F.lit(None).cast(schema.FACTS)
    rows = inputs.collection(t).select("id", "embedding", F.lit("city").alias("type"), F.lit("Asia").alias("continent"), facts.alias("facts"))
    jobs.search_stream(stream, rows, path, scratch(t), SearchOptions(default_limit=5, default_threshold=0.0, digits=inputs.DIGITS)).awaitTermination()
    return t.spark.read.parquet(f"{path}/results").select("query_id", "id", F.col("rank").cast("bigint").alias("rank"))
