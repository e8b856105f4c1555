"""Text, intent, document-text, id and search-pipeline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs
from checks.inputs import sql_fold
from checks.registry import Tables, register, rounded
from terralex import fixed_values as fv
from terralex.functions import query_intent as qi
from terralex.functions.document_text import document_input, document_text, instruction_id, query_input
from terralex.functions.ids import canonical_json, point_id, text_sha256, translation_key, uuid_v5
from terralex.functions.text import display_name, fold, natural_sort_key, same_name
from terralex.operators import metrics, payload
from terralex.operators.filters import verified_runtime_rows
from terralex.operators.ranking import case_evidence
from terralex.operators.validate import validate_cases, validate_requests
from terralex.plans import gates
from terralex.session import materialise
from terralex.plans.search import SearchOptions, accepted_rows, gate_results, prepare_requests, search, search_candidates, verify_results

_CONTINENT_SQL = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(p, ' {a} ')" for a in aliases) + f" THEN '{name}'" for name, aliases in fv.CONTINENT_ALIASES) + " END"
_ANY_COUNTRY = " OR ".join(f"regexp_matches(f, '{p}')" for p in fv.COUNTRY_INTENT_PATTERNS)
_ANY_GEO = " OR ".join(f"regexp_matches(f, '{p}')" for p in fv.GEOGRAPHIC_QUESTION_PATTERNS)


def _re2(template: str) -> str:
    """The same pattern for an engine without look-around: ASCII word boundaries and \\s."""
    text = template.replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b")
    return text.replace("{S}", r"\s")


def _clean(x: str) -> str:
    for pattern in (fv.CAPITAL_TRAILING_PUNCTUATION, fv.CAPITAL_CONJUNCTION_TAIL, fv.CAPITAL_PHRASE_TAIL):
        x = f"regexp_replace({x}, '{_re2(pattern)}', '')"
    return f"trim({x})"


def _capital_sql() -> str:
    whens = []
    for index, (target, template) in enumerate(fv.CAPITAL_PATTERNS):
        subject, pattern = ("query" if target == "original" else "f"), _re2(template)
        value = _clean(f"regexp_extract({subject}, '{pattern}', 1)")
        if index == 2:
            value = f"trim(regexp_replace({value}, '{fv.CAPITAL_FOLDED_TAIL}', ''))"
        whens.append(f"WHEN regexp_matches({subject}, '{pattern}') THEN {value}")
    return f"CASE WHEN ci THEN nullif(CASE {' '.join(whens)} END, '') END"


INTENT_CTES = {
    "folded": f"SELECT query_id, query, {sql_fold('query')} AS f FROM query_text",
    "intents": f"""SELECT *, ({_ANY_COUNTRY}) AS ci, ' ' || f || ' ' AS p, f <> '' AND NOT ({_ANY_GEO}) AS eligible,
                  regexp_matches(f, '{fv.MEDIA_MARKER}') AND regexp_matches(f, '{fv.MEDIA_CONTENT}') AS media,
                  regexp_matches(f, '{fv.CLUB_MARKER}') AND regexp_matches(f, '{fv.CLUB_ACHIEVEMENT}') AS club FROM folded""",
    "wanted": f"""SELECT query_id, query, CASE WHEN ci THEN 'country' END AS entity_type, {_CONTINENT_SQL} AS continent, {_capital_sql()} AS capital,
                 CASE WHEN eligible AND media THEN 'media-work' WHEN eligible AND club THEN 'sports-club' END AS domain FROM intents""",
}


def _queries(t: Tables):
    return t.view("query_text").withColumn("folded", fold(F.col("query")))


@register("F1_fold_conversations", f"SELECT conv_id, turn, md5({sql_fold('text')}) AS folded FROM conversations")
def fold_conversations(t: Tables):
    return t.table("conversations").select("conv_id", "turn", F.md5(fold(F.col("text"))).alias("folded"))


@register("F1_fold_documents", f"SELECT doc_id, md5({sql_fold('text')}) AS folded FROM documents")
def fold_documents(t: Tables):
    return t.table("documents").select("doc_id", F.md5(fold(F.col("text"))).alias("folded"))


@register("F2_country_intent", "SELECT query_id, ci AS country_intent FROM intents", "query_text", then=INTENT_CTES)
def country_intent(t: Tables):
    return _queries(t).select("query_id", qi.country_intent(F.col("folded")).alias("country_intent"))


@register("F3_requested_continent", "SELECT query_id, continent FROM wanted", "query_text", then=INTENT_CTES)
def requested_continent(t: Tables):
    return _queries(t).select("query_id", qi.requested_continent(F.col("folded")).alias("continent"))


@register("F4_F5_constraints", "SELECT query_id, entity_type, continent, capital FROM wanted", "query_text", then=INTENT_CTES)
def constraints(t: Tables):
    wanted = qi.constraints(F.col("query"), F.col("folded"))
    return _queries(t).select("query_id", wanted.alias("c")).select("query_id", "c.*")


@register("F9_non_geographic_intent", "SELECT query_id, domain FROM wanted", "query_text", then=INTENT_CTES)
def non_geographic_intent(t: Tables):
    return _queries(t).select("query_id", qi.non_geographic_intent(F.col("folded"))["domain"].alias("domain"))


_EQUIV = "(fa <> '' AND fb <> '' AND (contains(fa, fb) OR contains(fb, fa)))"
_SIMILAR = ("CASE WHEN replace(fa, ' ', '') = '' OR replace(fb, ' ', '') = '' THEN 0 ELSE 1 - levenshtein(replace(fa, ' ', ''), replace(fb, ' ', '')) "
            "/ greatest(length(replace(fa, ' ', '')), length(replace(fb, ' ', ''))) END")
_TEXT_PAIRS = {
    "tp": "SELECT p.p_partkey, p.p_name AS a, s.s_name AS b0, CASE p.p_partkey % 4 WHEN 0 THEN upper(p.p_name) WHEN 1 THEN p.p_name || ' x' WHEN 2 THEN reverse(p.p_name) "
          "ELSE p.p_brand END AS b FROM part p LEFT JOIN supplier s ON s.s_suppkey = p.p_partkey",
    "tf": f"SELECT p_partkey, {sql_fold('a')} AS fa, {sql_fold('b')} AS fb FROM tp",
}


@register("F6_F7_text_equivalence", f"SELECT p_partkey, {_EQUIV} AS same, round({_SIMILAR}, 6) AS similarity FROM tf", then=_TEXT_PAIRS)
def text_equivalence(t: Tables):
    mod, name = F.col("p_partkey") % 4, F.col("p_name")
    other = F.when(mod == 0, F.upper(name)).when(mod == 1, F.concat(name, F.lit(" x"))).when(mod == 2, F.reverse(name)).otherwise(F.col("p_brand"))
    return t.table("part").select("p_partkey", qi.equivalent_text(name, other).alias("same"), F.round(qi.edit_similarity(name, other), 6).alias("similarity"))


# Every query judged against three entities of the table: the pairing is by key, not all against all.
_JUDGED = {
    "ranks": "SELECT id, type, continent, capital, name_en, row_number() OVER (ORDER BY geoname_id, id) - 1 AS n FROM ent WHERE type = 'country'",
    "pairs": """SELECT w.*, r.id AS rid, r.type AS rtype, r.continent AS rcont, r.capital AS rcap FROM wanted w, (VALUES (0), (1), (2)) k(k)
                JOIN ranks r ON r.n = (w.query_id + k.k * 7) % 25""",
    "fp": f"SELECT *, {sql_fold('rcont')} AS fc, {sql_fold('continent')} AS fwc, {sql_fold('rcap')} AS fa, {sql_fold('capital')} AS fb FROM pairs",
    "verdict": f"""SELECT query_id, rid, domain, rtype, (continent IS NOT NULL AND NOT (fc <> '' AND (contains(fc, fwc) OR contains(fwc, fc)))) AS bad_continent,
                   (capital IS NOT NULL AND NOT ({_EQUIV} OR {_SIMILAR} >= 0.70)) AS bad_capital FROM fp""",
}


def _judged(t: Tables):
    ranks = inputs.country_rows(t).select(
        F.col("id").alias("rid"), "type", "continent", F.col("facts.capital").alias("capital"),
        F.col("source_id").cast("bigint").alias("n"))
    queries = _queries(t).select("query_id", "query", qi.constraints(F.col("query"), F.col("folded")).alias("constraints"),
                                 qi.non_geographic_intent(F.col("folded")).alias("intent"),
                                 F.explode(F.array(*[F.lit(i * 7) for i in range(3)])).alias("shift"))
    return verify_results(queries.withColumn("n", (F.col("query_id") + F.col("shift")) % 25).join(ranks, "n"))


@register(
    "F8_C2_consistency_verdicts",
    """SELECT query_id, rid, concat_ws('|', CASE WHEN bad_continent THEN 'continent-mismatch' END, CASE WHEN bad_capital THEN 'capital-mismatch' END) AS reasons
       FROM verdict""", "ent", "query_text", then=INTENT_CTES | _JUDGED)
def consistency_verdicts(t: Tables):
    return _judged(t).select("query_id", "rid", F.array_join("consistency_reasons", "|").alias("reasons"))


@register(
    "C3_intent_gate",
    """SELECT domain, count(*) AS judged, count(CASE WHEN NOT bad_continent AND NOT bad_capital THEN 1 END) AS rejected FROM verdict
       WHERE domain IS NOT NULL GROUP BY domain""", "ent", "query_text", then=INTENT_CTES | _JUDGED)
def intent_gate(t: Tables):
    gated = gate_results(_judged(t)).where(F.col("intent").isNotNull())
    return gated.groupBy(F.col("intent.domain").alias("domain")).agg(F.count("*").alias("judged"), F.count_if(F.size("intent_reasons") > 0).alias("rejected"))


@register(
    "A15_rejection_reasons",
    """SELECT reason, count(*) AS rejections FROM (SELECT 'continent-mismatch' AS reason FROM verdict WHERE bad_continent
       UNION ALL SELECT 'capital-mismatch' FROM verdict WHERE bad_capital) x GROUP BY reason""", "ent", "query_text", then=INTENT_CTES | _JUDGED)
def rejection_reasons(t: Tables):
    return metrics.reason_counts(_judged(t), "consistency_reasons")


# ---------------------------------------------------------------- document text

_TEXTS = {
    "named": """SELECT e.*, CASE WHEN geoname_id % 2 = 0 THEN 'Vi ' || name_en END AS name_vi,
                CASE WHEN type = 'country' THEN 'en, ' || lower('NT' || chr(65 + CAST(geoname_id AS INT))) END AS languages FROM ent e""",
    "head": """SELECT *, name_en || CASE WHEN name_vi IS NULL THEN '' ELSE '. ' || name_vi END || '.' AS names,
               CASE WHEN region IS NOT NULL THEN 'Region: ' || region || '.' END AS l_region, CASE WHEN continent IS NOT NULL THEN 'Continent: ' || continent || '.' END AS l_cont,
               'Country code: ' || country_code || '.' AS l_code, CASE WHEN languages IS NOT NULL THEN 'Languages: ' || languages || '.' END AS l_lang FROM named""",
}


def _with_vi(t: Tables):
    even = F.col("source_id").cast("bigint") % 2 == 0
    return inputs.entities(t).withColumn("name", F.col("name").withField("vi", F.when(even, F.concat(F.lit("Vi "), F.col("name.en")))))


@register(
    "F10_document_text_v1",
    """SELECT id, concat_ws(chr(10), names, l_region, l_cont, l_code, CASE WHEN country IS NOT NULL THEN 'Country: ' || country || '.' END,
              CASE WHEN capital IS NOT NULL THEN 'Capital: ' || capital || '.' WHEN is_capital THEN 'Capital: true.' END,
              CASE WHEN currency IS NOT NULL THEN 'Currency: ' || currency || '.' END, l_lang) AS text FROM head""", "ent", then=_TEXTS)
def document_text_v1(t: Tables):
    return _with_vi(t).select("id", document_text("v1").alias("text"))


def _v2_sql(en_capital: str, vi_capital: str) -> str:
    return f"""SELECT id, CASE WHEN type = 'country' THEN concat_ws(chr(10), names, name_en || ' is a country.', name_vi || ' là một quốc gia.', l_region, l_cont, l_code,
              {en_capital}, {vi_capital}, name_en || ' uses ' || currency || ' as its currency.', name_vi || ' sử dụng ' || currency || ' làm tiền tệ.', l_lang)
              ELSE concat_ws(chr(10), names, name_en || ' is a city in ' || country || '.', name_vi || ' là một thành phố ở ' || country || '.',
              CASE WHEN is_capital THEN name_en || ' is the capital city of ' || country || '.' END, CASE WHEN is_capital THEN name_vi || ' là thủ đô của ' || country || '.' END,
              l_region, l_cont, l_code) END AS text FROM head"""


@register("F10_document_text_v2", _v2_sql("'The capital city of ' || name_en || ' is ' || capital || '.'", "'Thủ đô của ' || name_vi || ' là ' || capital || '.'"), "ent", then=_TEXTS)
def document_text_v2(t: Tables):
    return _with_vi(t).select("id", document_text("v2").alias("text"))


@register("F10_document_text_v21", _v2_sql("name_en || ' has ' || capital || ' as its capital.'", "name_vi || ' có thủ đô là ' || capital || '.'"), "ent", then=_TEXTS)
def document_text_v21(t: Tables):
    return _with_vi(t).select("id", document_text("v2.1").alias("text"))


# ---------------------------------------------------------------- ids, hashes, formats

_UUID = ("substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') "
         "|| substr(h, 18, 3) || '-' || substr(h, 21, 12)")
_NS = "'\\x" + "\\x".join(fv.UUID_NAMESPACE_URL.replace("-", "")[i:i + 2] for i in range(0, 32, 2)) + "'::BLOB"


@register("F11_uuid5_point_id", f"SELECT id, {_UUID} AS point_id FROM (SELECT id, sha1({_NS} || encode('entity:' || id)) AS h FROM ent) x", "ent")
def uuid5_point_id(t: Tables):
    return inputs.entities(t).select("id", point_id(F.col("id")).alias("point_id"))


@register(
    "F11_uuid5_urls", f"SELECT page_id, {_UUID} AS u FROM (SELECT page_id, sha1({_NS} || encode(url)) AS h FROM pages) x")
def uuid5_urls(t: Tables):
    return t.table("pages").select("page_id", uuid_v5(F.col("url"), fv.UUID_NAMESPACE_URL).alias("u"))


_KEY = """sha256('{"provider":"p","model":"m","promptVersion":"v1","from":"en","to":"vi","sourceSha256":"' || sha256(trim(text, chr(9) || chr(10) || chr(13) || ' ')) || '"}')"""


@register("F12_translation_keys", f"SELECT doc_id, sha256(trim(text, chr(9) || chr(10) || chr(13) || ' ')) AS source_hash, {_KEY} AS key FROM documents")
def translation_keys(t: Tables):
    return t.table("documents").select("doc_id", text_sha256(F.col("text")).alias("source_hash"), translation_key(F.col("text"), "p", "m", "v1").alias("key"))


@register(
    "F13_canonical_json",
    """SELECT p_partkey, '{"a":{"x":"' || p_brand || '","y":null},"m":{"a":"1","b":"2"},"z":' || CAST(p_size AS STRING) || '}' AS json FROM part""")
def canonical(t: Tables):
    rows = t.table("part").select("p_partkey", F.col("p_size").alias("z"), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")).alias("m"),
                                  F.struct(F.lit(None).cast("string").alias("y"), F.col("p_brand").alias("x")).alias("a"))
    return rows.select("p_partkey", canonical_json(rows.drop("p_partkey").schema).alias("json"))


@register(
    "F24_embedding_inputs",
    """SELECT item_id, md5('query: ' || t) AS q_prefix, md5('Instruct: Retrieve the geographic entity that best answers the query' || chr(10) || 'Query:' || t) AS q_prompt,
              md5('passage: ' || t) AS d_prefix, md5(t) AS d_raw, 'geo-retrieval-v1:' || substr(sha256(t), 1, 16) AS instruction
       FROM (SELECT item_id, trim(text, chr(9) || chr(10) || chr(13) || ' ') AS t FROM benchmark) x""")
def embedding_inputs(t: Tables):
    text = F.col("text")
    return t.table("benchmark").select(
        "item_id", F.md5(query_input(text, "prefix")).alias("q_prefix"), F.md5(query_input(text, "prompt")).alias("q_prompt"),
        F.md5(document_input(text, "prefix")).alias("d_prefix"), F.md5(document_input(text, "raw")).alias("d_raw"),
        instruction_id(F.trim(text)).alias("instruction"))


@register(
    "F25_display_names",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN c_name ELSE '' END AS shown, c_custkey % 3 = 1 AS matches FROM customer")
def display_names(t: Tables):
    mod = F.col("c_custkey") % 3
    shown = display_name(F.when(mod == 1, F.col("c_name")), F.when(mod == 0, F.col("c_mktsegment")))
    return t.table("customer").select("c_custkey", shown.alias("shown"), same_name(shown, F.upper("c_name")).alias("matches"))


@register("T7_natural_order", "SELECT id, row_number() OVER (ORDER BY type, geoname_id) AS n FROM ent", "ent")
def natural_order(t: Tables):
    from terralex.operators.ordering import number_rows

    return number_rows(inputs.entities(t).select("id"), [F.asc(natural_sort_key(F.col("id")))], "n")


# ---------------------------------------------------------------- requests and cases

@register(
    "P16_request_validation",
    """SELECT query_id, CASE WHEN query_id % 10 = 0 THEN 'query is required' WHEN length(q) > 1000 THEN 'query must be at most 1000 characters'
            WHEN query_id % 10 = 1 THEN 'language must be auto, en or vi' WHEN query_id % 10 = 2 THEN 'limit must be between 1 and 100'
            WHEN query_id % 10 = 3 THEN 'score_threshold must be between 0 and 1' WHEN query_id % 10 = 4 THEN 'continent must be a non-empty string' END AS error
       FROM (SELECT query_id, trim(query, chr(9) || chr(10) || chr(13) || ' ') AS q FROM query_text) x""", "query_text")
def request_validation(t: Tables):
    mod = F.col("query_id") % 10
    requests = t.view("query_text").select(
        "query_id", F.when(mod == 0, " \n").otherwise(F.col("query")).alias("query"), F.when(mod == 1, "fr").alias("language"),
        F.when(mod == 2, 101).alias("limit"), F.when(mod == 3, 1.5).alias("score_threshold"), F.when(mod == 4, "  ").alias("filter_continent"))
    return validate_requests(requests).select("query_id", F.col("_error").alias("error"))


@register(
    "P17_J12_case_validation",
    """SELECT geoname_id AS id, CASE WHEN geoname_id % 6 IN (0, 4) THEN 0 WHEN geoname_id % 6 = 5 THEN 2 ELSE 1 END AS errors FROM city_src""", "city_src")
def case_validation(t: Tables):
    key = F.col("geoname_id")
    mod = key % 6
    city = F.concat(F.lit("geonames:city:"), key.cast("string"))
    cases = t.view("city_src").select(
        key.cast("string").alias("id"), F.when(mod == 1, "fr").otherwise("en").alias("language"), F.lit("q").alias("query"),
        F.when(mod == 4, F.array().cast("array<string>")).when(mod == 5, F.array(F.lit("Q12"))).when(mod == 2, F.array(F.concat(city, F.lit("x")))).otherwise(F.array(city)).alias("expected_ids"),
        F.when(mod == 4, "no-answer").when(mod == 3, "country-factual").otherwise("city-capital").alias("category"), (mod != 4).alias("answerable"))
    checked = validate_cases(cases, inputs.entities(t))
    return checked.select(F.col("id").cast("bigint").alias("id"), F.size("_errors").cast("bigint").alias("errors"))


@register(
    "P15_runtime_predicate",
    "SELECT e_id AS event_id, e_id % 4 = 0 AS verified FROM (SELECT event_id AS e_id FROM events) x")
def runtime_predicate(t: Tables):
    mod = F.col("event_id") % 4
    rows = t.table("events").select(
        "event_id", F.when(mod == 1, "Mock-http").when(mod == 3, "unknown").otherwise("torch").alias("embedding_backend"),
        F.lit("transformers").alias("embedding_implementation"), (mod != 2).alias("embedding_semantic"))
    return rows.select("event_id", verified_runtime_rows().alias("verified"))


@register(
    "P11_P12_payload",
    """SELECT 'geonames:' || type || ':' || CAST(geoname_id AS STRING) AS entity_id, type, name_en, continent, population, 'english_only' AS bilingual_state,
              'model-a' AS embedding_model, TRUE AS embedding_semantic, 'v2.1' AS embedding_text_version, 'fp' AS index_fingerprint FROM ent""", "ent")
def payload_columns(t: Tables):
    metadata = {"embedding_model": "model-a", "embedding_version": "1", "dataset_version": "d", "index_fingerprint": "fp",
                "embedding_runtime": {"backend": "b", "implementation": "i", "semantic": True}}
    return payload.to_points(inputs.entities(t), metadata, "v2.1").select(
        "entity_id", "type", "name_en", "continent", "population", "bilingual_state", "embedding_model", "embedding_semantic", "embedding_text_version", "index_fingerprint")


@register("J11_point_lookup", "SELECT id, type, name_en FROM ent WHERE population > 500000", "ent")
def point_lookup(t: Tables):
    points = payload.to_points(inputs.entities(t), {"embedding_model": "m"})
    wanted = t.sql("SELECT id FROM ent WHERE population > 500000 UNION ALL SELECT 'geonames:city:none' FROM region", "ent")
    return payload.lookup(points, wanted).select("id", "type", F.col("name.en").alias("name_en"))


# ---------------------------------------------------------------- full search: each vector carries one of the query texts

_SEARCH = INTENT_CTES | {
    "keyed": "SELECT w.*, row_number() OVER (ORDER BY query_id) - 1 AS n FROM wanted w",
    "total": "SELECT count(*) AS c FROM keyed",
    "req": """SELECT e.vec_id AS case_id, k.entity_type, k.continent, k.capital, k.domain, 3 AS lim,
              CASE WHEN k.entity_type IS NOT NULL OR k.continent IS NOT NULL OR k.capital IS NOT NULL THEN 15 ELSE 3 END AS cand FROM embeddings e
              JOIN keyed k ON k.n = e.vec_id % (SELECT c FROM total) WHERE length(k.query) <= 1000""",
    "coll": """SELECT vec_id AS id, CASE WHEN label % 2 = 0 THEN 'country' ELSE 'city' END AS type, CASE label % 5 WHEN 0 THEN 'Africa' WHEN 1 THEN 'North America'
               WHEN 2 THEN 'Asia' WHEN 3 THEN 'Europe' ELSE 'South America' END AS rcont, CASE WHEN label % 2 = 0 THEN 'Customer#' || lpad(CAST(vec_id % 50 AS STRING), 9, '0') END AS rcap
               FROM embeddings""",
    "prs": """SELECT q.vec_id AS case_id, d.vec_id AS id,
              floor(list_cosine_similarity(list_reverse(CAST(q.embedding AS DOUBLE[])), CAST(d.embedding AS DOUBLE[])) * 1e9 + 0.5) / 1e9 AS score FROM embeddings q, embeddings d""",
    "cnd": """SELECT * FROM (SELECT p.*, r.cand, row_number() OVER (PARTITION BY p.case_id ORDER BY score DESC, id) AS cr FROM prs p JOIN req r USING (case_id)
              WHERE score >= 0.1) x WHERE cr <= cand""",
    "jf": f"""SELECT c.case_id, c.id, c.score, r.lim, r.domain, r.entity_type, r.continent, r.capital, o.type, {sql_fold('o.rcont')} AS fc, {sql_fold('r.continent')} AS fwc,
              {sql_fold('o.rcap')} AS fa, {sql_fold('r.capital')} AS fb FROM cnd c JOIN req r USING (case_id) JOIN coll o USING (id)""",
    "jd": f"""SELECT *, (entity_type IS NOT NULL AND type <> entity_type) OR (continent IS NOT NULL AND NOT (fc <> '' AND (contains(fc, fwc) OR contains(fwc, fc))))
              OR (capital IS NOT NULL AND NOT ({_EQUIV} OR {_SIMILAR} >= 0.70)) AS inconsistent FROM jf""",
    "fin": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, id) AS rank FROM jd WHERE NOT inconsistent AND domain IS NULL) x WHERE rank <= lim""",
}
OPTIONS = SearchOptions(default_limit=3, default_threshold=0.1, digits=inputs.DIGITS)


def _requests(t: Tables):
    """One request per vector, with a query text assigned by position."""
    from terralex.operators.ordering import number_rows

    numbered = number_rows(t.view("query_text"), [F.asc("query_id")], "n").select((F.col("n") - 1).alias("n"), "query")
    total = numbered.count()
    vectors = inputs.query_vectors(t).select("query_id", "embedding").withColumn("n", F.col("query_id") % total)
    return vectors.join(numbered, "n").drop("n")


def _payload(t: Tables):
    from terralex import schema

    label, key = F.col("label"), F.col("id")
    name = F.concat(F.lit("Customer#"), F.lpad((key % 50).cast("string"), 9, "0"))
    facts = F.struct(*[(F.when(label % 2 == 0, name) if f.name == "capital" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.FACTS.fields])
    continent = F.element_at(F.array(*[F.lit(c) for c in ("Africa", "North America", "Asia", "Europe", "South America")]), (label % 5 + 1).cast("int"))
    return inputs.collection(t).select(
        "id", "embedding", F.when(label % 2 == 0, "country").otherwise("city").alias("type"), continent.alias("continent"), facts.alias("facts"),
        name.alias("name_en"), F.lit(None).cast("string").alias("name_vi"))


@register("C1_search_results", "SELECT case_id AS query_id, id, rank, round(score, 6) AS score FROM fin", "query_text", then=_SEARCH)
def search_results(t: Tables):
    results, _ = search(_requests(t), _payload(t), OPTIONS)
    return rounded(results, "score").select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), "score")


@register(
    "C1_A15_search_meta",
    """SELECT r.case_id AS query_id, r.cand AS candidate_limit, r.domain IS NOT NULL AS intent_applied, count(j.id) AS candidate_count,
              count(CASE WHEN inconsistent THEN 1 END) AS consistency_rejected, count(CASE WHEN NOT inconsistent AND j.domain IS NOT NULL THEN 1 END) AS intent_rejected,
              least(3, count(CASE WHEN NOT inconsistent AND j.domain IS NULL THEN 1 END)) AS count
       FROM req r LEFT JOIN jd j USING (case_id) GROUP BY 1, 2, 3""", "query_text", then=_SEARCH)
def search_meta(t: Tables):
    _, meta = search(_requests(t), _payload(t), OPTIONS)
    return meta.select("query_id", F.col("candidate_limit").cast("bigint").alias("candidate_limit"), "intent_applied", "candidate_count", "consistency_rejected", "intent_rejected", "count")


_EXPECT = {
    "exp": "SELECT id, vec_id % 3 <> 0 AS answerable, CASE WHEN vec_id % 2 = 0 THEN 'contradictory-geography' ELSE 'plausible-absent-entity' END AS challenge FROM (SELECT vec_id AS id, vec_id FROM embeddings) x",
    "raw": "SELECT c.case_id, c.score, cr AS rank, e.answerable AND q.label = d.label AS hit FROM cnd c JOIN exp e ON e.id = c.case_id JOIN embeddings q ON q.vec_id = c.case_id JOIN embeddings d ON d.vec_id = c.id",
    "ver": "SELECT c.case_id, c.score, row_number() OVER (PARTITION BY c.case_id ORDER BY c.score DESC, c.id) AS rank, e.answerable AND q.label = d.label AS hit FROM jd c JOIN exp e ON e.id = c.case_id JOIN embeddings q ON q.vec_id = c.case_id JOIN embeddings d ON d.vec_id = c.id WHERE NOT inconsistent",
    "ra": "SELECT case_id, min(CASE WHEN hit THEN rank END) AS r, count(CASE WHEN score >= 0.3 THEN 1 END) AS alive, count(CASE WHEN score >= 0.3 AND hit THEN 1 END) AS hits FROM raw GROUP BY 1",
    "va": "SELECT case_id, min(CASE WHEN hit THEN rank END) AS r, count(CASE WHEN score >= 0.3 THEN 1 END) AS alive, count(CASE WHEN score >= 0.3 AND hit THEN 1 END) AS hits FROM ver GROUP BY 1",
    "xp": "SELECT exp.*, ra.r AS rr, va.r AS vr, coalesce(ra.alive, 0) AS ral, coalesce(va.alive, 0) AS val, coalesce(va.hits, 0) AS vh FROM exp LEFT JOIN ra ON ra.case_id = exp.id LEFT JOIN va ON va.case_id = exp.id",
}


def _marked(t: Tables, rows):
    labels = inputs.collection(t)
    want = labels.select(F.col("id").alias("case_id"), F.col("label").alias("_w"))
    have = labels.select("id", F.col("label").alias("_h"))
    return rows.withColumnRenamed("query_id", "case_id").join(want, "case_id").join(have, "id").withColumn(
        "is_expected", (F.col("_w") == F.col("_h")) & (F.col("case_id") % 3 != 0)).drop("_w", "_h")


def _experiment_cases(t: Tables):
    challenge = F.when(F.col("id") % 2 == 0, "contradictory-geography").otherwise("plausible-absent-entity")
    return inputs.collection(t).select("id", (F.col("id") % 3 != 0).alias("answerable"), challenge.alias("challenge"))


@register(
    "C23_verification_experiment",
    """SELECT x."check", x.observed, x.bound, CASE x.rule WHEN 'below' THEN x.observed < x.bound ELSE x.observed <= x.bound END AS passed FROM (
       SELECT 'answerable_rank_regressions' AS "check", CAST(count(CASE WHEN answerable AND rr IS NOT NULL AND (vr IS NULL OR vr > rr) THEN 1 END) AS DOUBLE) AS observed, CAST(0 AS DOUBLE) AS bound, 'most' AS rule FROM xp
       UNION ALL SELECT 'answerable_threshold_misses', CAST(count(CASE WHEN answerable AND vh = 0 THEN 1 END) AS DOUBLE), 0, 'most' FROM xp
       UNION ALL SELECT 'false_positives_reduced', CAST(count(CASE WHEN NOT answerable AND val > 0 THEN 1 END) AS DOUBLE), count(CASE WHEN NOT answerable AND ral > 0 THEN 1 END), 'below' FROM xp
       UNION ALL SELECT 'contradictory_geography_improved', CAST(count(CASE WHEN NOT answerable AND val > 0 THEN 1 END) AS DOUBLE), count(CASE WHEN NOT answerable AND ral > 0 THEN 1 END), 'below' FROM xp WHERE challenge = 'contradictory-geography'
       UNION ALL SELECT 'plausible_absent_not_worse', CAST(count(CASE WHEN NOT answerable AND val > 0 THEN 1 END) AS DOUBLE), count(CASE WHEN NOT answerable AND ral > 0 THEN 1 END), 'most' FROM xp WHERE challenge = 'plausible-absent-entity') x""",
    "query_text", then=_SEARCH | _EXPECT)
def verification_experiment(t: Tables):
    from pyspark.sql import Window

    valid = materialise(prepare_requests(_requests(t), OPTIONS)[0])  # the search and the checks read it again and again
    judged = materialise(search_candidates(valid, _payload(t), OPTIONS))
    raw = _marked(t, judged.withColumnRenamed("candidate_rank", "rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    verified = _marked(t, judged.where(F.size("consistency_reasons") == 0).withColumn("rank", F.row_number().over(order)))
    return gates.verification_experiment(raw, verified, _experiment_cases(t), 0.3).select("check", "observed", "bound", "passed")


@register(
    "C24_intent_experiment",
    """SELECT x."check", round(x.observed, 6) AS observed, CAST(x.bound AS DOUBLE) AS bound, CASE x.rule WHEN 'below' THEN x.observed < x.bound WHEN 'least' THEN x.observed >= x.bound ELSE x.observed = x.bound END AS passed FROM (
       SELECT 'zero_answerable_applications' AS "check", CAST(count(CASE WHEN r.case_id % 3 <> 0 AND domain IS NOT NULL THEN 1 END) AS DOUBLE) AS observed, 0 AS bound, 'equal' AS rule FROM req r
       UNION ALL SELECT 'false_positives_reduced', CAST(count(DISTINCT CASE WHEN case_id % 3 = 0 AND domain IS NULL THEN case_id END) AS DOUBLE), count(DISTINCT CASE WHEN case_id % 3 = 0 THEN case_id END), 'below' FROM jd WHERE NOT inconsistent
       UNION ALL SELECT 'zero_gated_false_positives', CAST(count(DISTINCT CASE WHEN case_id % 3 = 0 AND domain IS NULL THEN case_id END) AS DOUBLE), 0, 'equal' FROM jd WHERE NOT inconsistent
       UNION ALL SELECT 'zero_answerable_regressions', CAST(count(CASE WHEN NOT coalesce(g <= r, FALSE) THEN 1 END) AS DOUBLE), 0, 'equal' FROM gains
       UNION ALL SELECT 'answerable_quality_kept', least(avg(coalesce(1.0 / g, 0) - coalesce(1.0 / r, 0)), avg(CAST(coalesce(g = 1, FALSE) AS INT) - CAST(coalesce(r = 1, FALSE) AS INT)),
                 avg(CAST(g IS NOT NULL AS INT) - CAST(r IS NOT NULL AS INT))), 0, 'least' FROM gains) x""",
    "query_text", then=_SEARCH | {
        "trimmed": """SELECT case_id, domain, id, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, id) AS n FROM jd WHERE NOT inconsistent""",
        "found": """SELECT case_id, domain, min(CASE WHEN q.label = d.label THEN n END) AS r FROM trimmed JOIN embeddings q ON q.vec_id = case_id JOIN embeddings d ON d.vec_id = id
                    WHERE n <= 3 GROUP BY 1, 2""",
        "gains": """SELECT r.case_id, f.r, CASE WHEN r.domain IS NULL THEN f.r END AS g FROM req r LEFT JOIN found f USING (case_id) WHERE r.case_id % 3 <> 0""",
    })
def intent_experiment(t: Tables):
    from terralex.operators.ranking import trim_results

    valid = materialise(prepare_requests(_requests(t), OPTIONS)[0])  # the search and the checks read it again and again
    judged = materialise(search_candidates(valid, _payload(t), OPTIONS))
    run = valid.select(F.col("query_id").alias("id"))  # a case whose request is rejected was not run
    cases = _experiment_cases(t).join(run, "id", "left_semi").withColumns({c: F.lit("x") for c in ("language", "category", "query")})

    def evidence(rows):
        return case_evidence(cases, _marked(t, trim_results(rows, valid, "query_id")), 3)

    before = evidence(judged.where(F.size("consistency_reasons") == 0))
    after = evidence(accepted_rows(judged))
    intents = valid.select(F.col("query_id").alias("case_id"), F.col("intent").isNotNull().alias("intent_applied"))
    checks = gates.intent_experiment(before, after, intents)
    return rounded(checks, "observed").select("check", "observed", "bound", "passed")


@register(
    "C22_intent_gate_acceptance",
    """SELECT x."check", x.observed, CAST(x.bound AS DOUBLE) AS bound, x.observed = x.bound AS passed FROM (
       SELECT 'application_matches_rule' AS "check", CAST(0 AS DOUBLE) AS observed, 0 AS bound
       UNION ALL SELECT 'zero_false_positives', CAST(count(DISTINCT CASE WHEN case_id % 3 = 0 THEN case_id END) AS DOUBLE), 0 FROM fin
       UNION ALL SELECT 'never_applied_to_answerable', CAST(count(CASE WHEN case_id % 3 <> 0 AND domain IS NOT NULL THEN 1 END) AS DOUBLE), 0 FROM req
       UNION ALL SELECT 'targets_fixed', CAST(count(DISTINCT CASE WHEN case_id IN (3, 6, 9, 12) AND domain IS NOT NULL AND NOT inconsistent THEN case_id END) AS DOUBLE), 4 FROM jd
       UNION ALL SELECT 'intent_cases', CAST(count(domain) AS DOUBLE), 100 FROM req) x""", "query_text", then=_SEARCH)
def intent_gate_acceptance(t: Tables):
    requests = _requests(t)
    results, meta = search(requests, _payload(t), OPTIONS)
    cases = _experiment_cases(t).join(requests.select(F.col("query_id").alias("id"), "query"), "id").withColumns({c: F.lit("x") for c in ("language", "category")})
    evidence = case_evidence(cases, _marked(t, results), 3)
    checks = gates.intent_gate_acceptance(evidence, meta.withColumnRenamed("query_id", "case_id"), [3, 6, 9, 12], 100)
    return checks.select("check", "observed", "bound", "passed")


@register(
    "C25_sentinel_checks",
    """SELECT r.case_id AS query_id, coalesce(max(CASE WHEN rank = 1 AND id % 50 = r.case_id % 50 THEN 1 ELSE 0 END), 0) = 1 AS found,
              coalesce(max(CASE WHEN id % 50 = r.case_id % 50 THEN 1 ELSE 0 END), 0) = 0 AS absent FROM req r LEFT JOIN fin f USING (case_id) GROUP BY 1""", "query_text", then=_SEARCH)
def sentinel_checks(t: Tables):
    results, _ = search(_requests(t), _payload(t), OPTIONS)
    full = results.join(_payload(t).select("id", F.col("name_en").alias("_n")), "id").drop("name_en", "name_vi").withColumnRenamed("_n", "name_en").withColumn("name_vi", F.lit(None).cast("string"))
    key = F.col("query_id")
    name = F.lower(F.concat(F.lit("Customer#"), F.lpad((key % 50).cast("string"), 9, "0")))
    sentinels = inputs.query_vectors(t).select("query_id", name.alias("expected"), F.explode(F.array(F.lit(False), F.lit(True))).alias("negative"))
    checks = gates.sentinel_checks(full, sentinels)
    return checks.groupBy("query_id").agg(F.max(F.when(~F.col("negative"), F.col("passed"))).alias("found"), F.max(F.when(F.col("negative"), F.col("passed"))).alias("absent"))
