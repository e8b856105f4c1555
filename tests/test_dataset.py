"""Sources, enrichment, merging, options and the whole build on small raw files."""

import json

import pytest
from pyspark.sql import functions as F

from terralex import fixed_values as fv
from terralex import schema
from terralex.operators import enrich, merge, quality
from terralex.operators.filters import compatible_runtime, compile_filter, dataset_options, normalise_runtime, require_semantic_runtime
from terralex.operators.validate import normalise_entities, validate_cases, validate_requests
from terralex.plans.build_dataset import Dumps, build_dataset
from terralex.session import fail_on_errors, quarantine
from terralex.sources import concordance, gazetteer
from terralex.sources.entities import read_cases, read_entities


def lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def city(gid, name="Hanoi", code="VN", admin="44", population="100", feature="PPLC", latitude="21.0"):
    return "\t".join([gid, name, name, "", latitude, "105.8", "P", feature, code, "", admin, "", "", "", population, "", "12", "Asia/Ho_Chi_Minh", "2024-01-01"])


def country(iso="VN", name="Vietnam", capital="Hanoi", continent="AS", gid="1562822"):
    cells = dict.fromkeys(fv.COUNTRY_COLUMNS[:17], "")
    cells.update(iso2=iso, iso3=iso + "M", country_name=name, capital=capital, population="95540395", continent_code=continent,
                 currency_name="Dong", languages="vi,en, ,fr", geoname_id=gid)
    return "\t".join(cells[c] for c in fv.COUNTRY_COLUMNS[:17])


def alternate(aid, gid, lang, name, preferred="", short="", historic=""):
    return "\t".join([aid, gid, lang, name, preferred, short, "", historic, "", ""])


def feature(wof, gn, placetype="locality", current=1, **names):
    properties = {"wof:id": wof, "wof:placetype": placetype, "mz:is_current": current, "wof:concordances": {"gn:id": gn}, **names}
    return json.dumps({"type": "Feature", "geometry": {"coordinates": [1, 2]}, "properties": properties}, ensure_ascii=False)


def test_city_errors(spark):
    good, bad = quarantine(gazetteer.parse_cities(lines(spark, [
        city("1") + "\r", "", city("x2"), city("3", name=" "), city("4", code="vn"), city("5", latitude="91"), city("6", population="1.5"), city("7") + "\tmore", city("8", name="a�"),
    ])))
    assert [r["geoname_id"] for r in good.collect()] == [1]
    assert bad.count() == 7
    with pytest.raises(Exception, match="19 tab-delimited"):
        fail_on_errors(gazetteer.parse_cities(lines(spark, ["1\t2"]))).collect()


def test_country_and_division_files(spark):
    rows = fail_on_errors(gazetteer.parse_countries(lines(spark, ["# head", "", country()]))).collect()
    assert rows[0]["languages"] == ["vi", "en", "fr"] and rows[0]["population"] == 95540395
    for parser, text in ((gazetteer.parse_countries, "VN\tx"), (gazetteer.parse_admin1, "VN.44\tHanoi\tHanoi"), (gazetteer.parse_admin1, "VN.44\tHanoi\tHanoi\tx")):
        with pytest.raises(Exception, match="malformed|identity|columns"):
            fail_on_errors(parser(lines(spark, [text]))).collect()


def test_alternate_names_are_checked_only_for_selected_rows(spark):
    selected = spark.createDataFrame([(1,)], "geoname_id bigint")
    rows = lines(spark, [alternate("10", "1", "vi", "Ðà Nẵng"), alternate("x", "2", "vi", "ignored"), alternate("11", "1", "fr", "x", preferred="9")])
    found = fail_on_errors(gazetteer.parse_alternate_names(rows, selected)).collect()
    assert [(r["alternate_name_id"], r["name"]) for r in found] == [(10, "Đà Nẵng")]
    with pytest.raises(Exception, match="flags"):
        fail_on_errors(gazetteer.parse_alternate_names(lines(spark, [alternate("1", "1", "en", "a", preferred="2")]), selected)).collect()


def test_concordance_features(spark):
    rows = [
        feature(1, 10, **{"name:eng_x_preferred": ["A", "B"], "name:eng_x_variant": ["B", "C", 5], "name:vie_x_preferred": ["Ðx", "Đx"]}),
        feature(2, [10, "10"]), feature(3, [10, 11]), feature(0, 12), feature(4, 13, placetype="county"), feature(5, 14, current=0), feature(6, 15, current=False), "{broken",
    ]
    parsed = concordance.parse_features(concordance.feature_properties(lines(spark, rows)), "city").collect()
    by_id = {r["wof_id"]: r for r in parsed}
    assert (by_id["1"]["name_en"], by_id["1"]["aliases_en"], by_id["1"]["name_vi"]) == ("A", ["B", "C"], "Đx")
    assert {r["wof_id"] for r in parsed if r["_admissible"]} == {"1", "2"}
    assert sum(bool(r["_errors"]) for r in parsed) == 2  # no positive id; unreadable line


def test_skipping_unmentioned_features(spark):
    rows = [feature(1, 10), feature(2, 99), feature(3, [10, 99]), feature(4, None), "{}"]
    targets = spark.createDataFrame([(10,)], "geoname_id bigint")
    kept = concordance.worth_parsing(concordance.feature_properties(lines(spark, rows)), targets)
    assert kept.count() == 4


def entities(spark, rows):
    shaped = [(i, t, (n, None), s, sid) for i, t, n, s, sid in rows]
    return fail_on_errors(normalise_entities(spark.createDataFrame(shaped, "id string, type string, name struct<en:string,vi:string>, source string, source_id string")))


def test_two_way_ambiguity(spark):
    rows = entities(spark, [(f"geonames:city:{i}", "city", f"c{i}", "geonames", str(i)) for i in (1, 2, 3, 4)])
    candidates = spark.createDataFrame(
        [("1", "a"), ("1", "a"), ("2", "b"), ("2", "c"), ("3", "d"), ("4", "d"), ("9", "a")], "gn_id string, wof_id string"
    ).withColumns({"placetype": F.lit("locality"), "name_en": F.lit("N"), "name_vi": F.lit(None).cast("string"),
                   "aliases_en": F.array().cast("array<string>"), "aliases_vi": F.array().cast("array<string>")})
    state = {r["gn_id"]: r["match"] for r in enrich.match_concordance(rows, candidates).collect()}
    assert state == {"1": "matched", "2": "ambiguous", "3": "ambiguous", "4": "ambiguous"}


def test_merge_rules(spark):
    first = entities(spark, [("Q1", "city", "W", "wikidata", "w")])
    second = entities(spark, [("Q1", "city", "G", "geonames", "g"), ("Q2", "city", "Only", "geonames", "g2")])
    merged = {r["id"]: r for r in merge.merge_entities([second, first]).collect()}
    assert merged["Q1"]["name"]["en"] == "W" and merged["Q1"]["source"] == "wikidata"
    assert [r["source"] for r in merged["Q1"]["source_refs"]] == ["wikidata", "geonames"]
    with pytest.raises(Exception, match="type conflict"):
        merge.merge_entities([first, entities(spark, [("Q1", "country", "X", "geonames", "g")])]).collect()


def test_entity_files(spark, tmp_path):
    path = tmp_path / "entities.json"
    row = {"id": "q1", "type": "city", "name": {"en": " Tokyo "}, "facts": {"capital": True, "x": 1}}
    path.write_text(json.dumps([row]))
    found = read_entities(spark, str(path)).first()
    assert (found["id"], found["name"]["en"], found["facts"]["is_capital"], found["facts"]["extra"]) == ("Q1", "Tokyo", True, {"x": "1"})
    path.write_text(json.dumps([row, row]))
    with pytest.raises(ValueError, match="duplicate"):
        read_entities(spark, str(path))
    path.write_text(json.dumps([{**row, "type": "river"}]))
    with pytest.raises(Exception, match="unsupported entity type"):
        read_entities(spark, str(path)).collect()
    cases = tmp_path / "cases.json"
    cases.write_text(json.dumps([{"id": "a", "language": "en", "query": "q", "expected_ids": ["Q1"], "category": "city-capital"}]))
    assert read_cases(spark, str(cases)).first()["expected_ids"] == ["Q1"]


def test_case_and_request_validation(spark):
    known = entities(spark, [("ns:c", "city", "x", "geonames", "1")])
    rows = [("a", "en", "q", ["ns:c"], "city-capital", None, None), ("b", "en", "q", [], "no-answer", None, None), ("c", "xx", " ", ["ns:none"], "other", None, True), ("d", "en", "q", ["ns:c"], "country-factual", None, True),
            ("e", "en", "q", ["Q5"], "city-alias", None, False), ("f", "en", "q", ["ns:c"], "city-alias", None, None), ("f", "en", "q", ["ns:c"], "city-alias", None, None)]
    checked = validate_cases(spark.createDataFrame(rows, schema.CASE.simpleString().removeprefix("struct<").removesuffix(">")), known)
    errors = sorted((r["id"], len(r["_errors"])) for r in checked.collect())
    assert errors == [("a", 0), ("b", 1), ("c", 4), ("d", 1), ("e", 3), ("f", 1), ("f", 1)]
    requests = spark.createDataFrame([(1, " ", 5.0), (2, "x" * 1001, 5.0), (3, "ok", 0.0), (4, "ok", 2.5), (5, "ok", 20.0)], "query_id int, query string, `limit` double")
    assert [r["_error"] is None for r in validate_requests(requests).orderBy("query_id").collect()] == [False, False, False, False, True]


def test_options_and_filters():
    assert dataset_options("geonames", "city,landmark,city")["skipped"] == [{"source": "geonames", "type": "landmark", "reason": "unsupported_type"}]
    for bad in ({"sources": "wof"}, {"sources": "other"}, {"types": ["river"]}, {"limit": 0}):
        with pytest.raises(ValueError):
            dataset_options(**bad)


@pytest.mark.parametrize("bad", [{"type": " "}, {"population": {}}, {"population": {"gte": -1}}, {"color": "x"}, {"population": 3}])
def test_bad_filters(spark, bad):
    with pytest.raises(ValueError):
        compile_filter(bad)


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select(F.lit("city").alias("type"), F.col("id").alias("population")).write.parquet(path)
    plan = spark.read.parquet(path).where(compile_filter({"type": "city", "population": {"lt": 10}}))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count() == 10 and "LessThan(population,10)" in text and "EqualTo(type,city)" in text


def test_runtime_rules():
    assert normalise_runtime({}) is None
    good = {"backend": "b", "implementation": "i", "semantic": True, "profile": "p", "device": "cpu"}
    assert compatible_runtime(good) == {"backend": "b", "implementation": "i", "semantic": True, "profile": "p"}
    for bad in ({**good, "backend": "Mock"}, {**good, "semantic": "yes"}, {**good, "implementation": ""}):
        with pytest.raises(ValueError):
            require_semantic_runtime(bad)


def dumps(spark, feature_sources):
    return Dumps(
        lines(spark, [city("1", "Hà Nội", population="8000000"), city("2", "Hue", feature="PPL", population=""), city("3", "Vinh", feature="PPL", population="500")]),
        lines(spark, ["# c", country()]), lines(spark, ["VN.44\tHa Noi\tHa Noi\t9"]),
        lines(spark, [alternate("5", "1", "en", "Hanoi", preferred="1"), alternate("4", "1", "en", "Ha Noi"), alternate("6", "1", "vi", "Kẻ Chợ", historic="1"), alternate("7", "1", "vi", "Hà Nội")]),
        feature_sources)


def test_build_with_one_concordance_source_missing(spark):
    sources = {"city": lambda: lines(spark, [feature(7, 1, **{"name:eng_x_preferred": ["Hanoi City"], "name:vie_x_preferred": ["Thủ đô"]}), feature(8, 555)])}
    built, manifest = build_dataset(dumps(spark, sources))
    rows = {r["id"]: r for r in built.collect()}
    hanoi = rows["geonames:city:1"]
    assert (hanoi["name"]["en"], hanoi["name"]["vi"]) == ("Hanoi City", "Hà Nội")  # explicit Vietnamese stays
    assert hanoi["aliases"]["en"] == ["Ha Noi", "Hanoi"] and hanoi["aliases"]["vi"] == ["Thủ đô"]
    assert hanoi["language_provenance"]["name_en"] == "whosonfirst" and hanoi["facts"]["wof_id"] == "7"
    report = manifest["wofEnrichment"]
    assert report["status"] == "partial" and report["byType"]["country"]["status"] == "unavailable"
    assert (report["byType"]["city"]["scanned"], report["byType"]["city"]["skippedUnmatched"], report["matched"]) == (2, 1, 1)
    assert manifest["coverage"]["continents"]["Asia"] == 4 and manifest["mergedCount"] == 4


def test_build_selects_before_enriching(spark):
    built, manifest = build_dataset(dumps(spark, {}), sources="geonames", types="city", limit=2)
    assert {r["id"] for r in built.collect()} == {"geonames:city:1", "geonames:city:3"}
    assert manifest["mergedCountBeforeLimit"] == 3 and manifest["wofEnrichment"]["status"] == "disabled"


def test_coverage_gate():
    counts = {"North America": 3, "South America": 0}
    assert len(quality.coverage_failures(5000, counts)) == 1
    assert quality.coverage_failures(4999, counts) == []


def test_selection_ignores_input_order(spark):
    rows = [city(str(i), f"n{i}", feature="PPL", population=str(i % 7)) for i in range(40)]
    pick = []
    for source in (rows, rows[::-1]):
        d = Dumps(lines(spark, source), lines(spark, [country()]), lines(spark, ["VN.44\tHa Noi\tHa Noi\t9"]), lines(spark, []), {})
        pick.append({r["id"] for r in build_dataset(d, sources="geonames", types="city", limit=9)[0].collect()})
    assert pick[0] == pick[1] and len(pick[0]) == 9
