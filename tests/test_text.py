"""Folding, query understanding, document text and ids on literal cases."""

import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from terralex import fixed_values as fv
from terralex import schema
from terralex.functions import query_intent as qi
from terralex.functions.document_text import document_text, selected_document_text
from terralex.functions.ids import canonical_entity_id, point_id, uuid_v5
from terralex.functions.text import fold, natural_sort_key, utf16_length
from terralex.sources.entities import parse_entity_json


def values(spark, texts, expression):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", expression(F.col("t")).alias("v"))
    return [r["v"] for r in sorted(rows.collect(), key=lambda r: r["i"])]


def reference_fold(text):
    plain = unicodedata.normalize("NFD", text.replace("đ", "d").replace("Đ", "D"))
    plain = "".join(c for c in plain if not 0x300 <= ord(c) <= 0x36F).lower()
    plain = "".join(c for c in plain if c not in fv.QUOTE_CHARACTERS)
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in plain).split())


def test_fold_equals_decomposition_over_every_letter(spark):
    letters = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["x" + "y".join(letters[i:i + 64]) for i in range(0, len(letters), 64)]
    texts += ["Đà Nẵng — “Hải Châu”", "ạ́b", "O'Neil`s", "", "KÅngström"]
    assert values(spark, texts, fold) == [reference_fold(t) for t in texts]


CONSTRAINTS = [
    ("Which European country has Tokyo as its capital and uses the yen?", ("country", "Europe", "Tokyo")),
    ("Quốc gia châu Âu nào có thủ đô Tokyo và sử dụng đồng yên?", ("country", "Europe", "Tokyo")),
    ("Nước nào có Gotham City làm thủ đô quốc gia?", ("country", None, "Gotham City")),
    ("Not the country Thailand; which city is the capital of Thailand?", (None, None, None)),
    ("Which country is associated with Bangkok as its national capital and the baht as its money?", ("country", None, None)),
    ("Which South American country has Bangkok as its capital and uses the baht?", ("country", "South America", "Bangkok")),
    ("Which North American country has Hanoi as its capital and uses the dong?", ("country", "North America", "Hanoi")),
    ("quốc gia Đông Nam Á có thủ đô Bangkok", ("country", None, "Bangkok")),
    ("Asian country famous for Mount Fuji", (None, "Asia", None)),
    ("chau a va chau au", (None, "Europe", None)),
    ("", (None, None, None)),
]


def test_constraints(spark):
    found = values(spark, [q for q, _ in CONSTRAINTS], qi.constraints)
    assert [(r["entity_type"], r["continent"], r["capital"]) for r in found] == [want for _, want in CONSTRAINTS]


INTENTS = {
    "What is the plot of the movie Casablanca?": "media-work",
    "Nội dung phim Casablanca nói về điều gì?": "media-work",
    "What trophies has Chelsea Football Club won?": "sports-club",
    "Chelsea Football Club đã giành những danh hiệu nào?": "sports-club",
    "Where is Casablanca located?": None,
    "Which city is home to Chelsea Football Club?": None,
    "Which country hosted the movie festival?": None,
    "football cities in Europe": None,
    "Casablanca city population": None,
}


def test_non_geographic_intent(spark):
    found = values(spark, list(INTENTS), lambda c: qi.non_geographic_intent(fold(c))["domain"])
    assert found == list(INTENTS.values())


def verdict(spark, kind, continent, capital, wanted):
    row = spark.createDataFrame([(kind, continent, capital, wanted)], "t string, c string, k string, w struct<entity_type:string,continent:string,capital:string>")
    return row.select(qi.rejection_reasons(F.col("t"), F.col("c"), F.col("k"), F.col("w")).alias("r")).first()["r"]


def test_verdicts(spark):
    assert verdict(spark, "country", "Asia", "Tokyo", ("country", "Europe", "Tokyo")) == [fv.REASON_CONTINENT]
    assert verdict(spark, "country", "Europe", "Tokyo", ("country", "Europe", "Tokyo")) == []
    assert verdict(spark, "city", "Asia", None, ("country", None, "Wakanda City")) == [fv.REASON_TYPE, fv.REASON_CAPITAL]
    assert verdict(spark, "country", None, "London", ("country", None, "Luân Đôn")) == []
    assert verdict(spark, "country", None, "Washington", ("country", None, "Hà Nội")) == [fv.REASON_CAPITAL]
    assert verdict(spark, "country", None, None, (None, "Asia", None)) == [fv.REASON_CONTINENT]
    assert verdict(spark, None, None, None, ("country", None, None)) == [fv.REASON_TYPE]


def entity(spark, **fields):
    base = {"id": "Q869", "type": "country", "name": ("Thailand", "Thái Lan"), "description": ("country in Southeast Asia", "quốc gia tại Đông Nam Á"),
            "aliases": (["Kingdom of Thailand"], ["Vương quốc Thái Lan"]), "continent": "Asia", "region": "Southeast Asia", "countryCode": "TH",
            "population": 65889213.0, "facts": {"capital": "Bangkok", "currency": "Thai baht", "languages": '["Thai"]'}, **fields}
    row = tuple(base.get(name) for name in schema.ENTITY_JSON.names)
    return parse_entity_json(spark.createDataFrame([row], schema.ENTITY_JSON))


def text(df, version):
    return df.select(document_text(version).alias("t")).first()["t"].split("\n")


def test_document_text_versions(spark):
    country = entity(spark)
    opening = ["Thailand. Thái Lan.", "country in Southeast Asia", "quốc gia tại Đông Nam Á", "English aliases: Kingdom of Thailand.", "Vietnamese aliases: Vương quốc Thái Lan."]
    place = ["Region: Southeast Asia.", "Continent: Asia.", "Country code: TH."]
    money = ["Thailand uses Thai baht as its currency.", "Thái Lan sử dụng Thai baht làm tiền tệ.", "Languages: Thai."]
    kind = ["Thailand is a country.", "Thái Lan là một quốc gia."]
    assert text(country, "v1") == opening + place + ["Capital: Bangkok.", "Currency: Thai baht.", "Languages: Thai."]
    assert text(country, "v2") == opening + kind + place + ["The capital city of Thailand is Bangkok.", "Thủ đô của Thái Lan là Bangkok."] + money
    assert text(country, "v2.1") == opening + kind + place + ["Thailand has Bangkok as its capital.", "Thái Lan có thủ đô là Bangkok."] + money


def test_capital_city_text(spark):
    city = entity(spark, id="Q1490", type="city", name=("Tokyo", None), description=None, aliases=None, facts={"capital": "true", "country": "Japan"})
    assert "Capital: true." in text(city, "v1")
    assert text(city, "v2.1")[:3] == ["Tokyo.", "Tokyo is a city in Japan.", "Tokyo is the capital city of Japan."]
    landmark = entity(spark, id="Q243", type="landmark", name=("Eiffel Tower", None), description=None, aliases=None, facts={})
    assert text(landmark, "v2")[1] == "Eiffel Tower is a landmark."


def test_only_released_text_versions_may_be_loaded(spark):
    with pytest.raises(ValueError):
        selected_document_text("v2")
    with pytest.raises(ValueError):
        document_text("v3")


def test_uuid5(spark):
    names = ["www.widgets.com", "Hà Nội", "x" * 200]
    assert values(spark, names, uuid_v5) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]
    assert values(spark, ["q42", "bad id"], point_id) == [str(uuid.uuid5(uuid.NAMESPACE_URL, "entity:Q42")), None]


def test_canonical_ids(spark):
    ids = [" q42 ", "Q0", "geonames:city:1", "a:b", "ns:a..b", "Ns:x", "ns:", "ns:é"]
    assert values(spark, ids, canonical_entity_id) == ["Q42", None, "geonames:city:1", None, None, None, None, None]


def test_lengths_and_natural_order(spark):
    assert values(spark, ["abc", "a😀b"], utf16_length) == [3, 4]
    rows = spark.createDataFrame([("n:city:10",), ("n:city:9",), ("n:city:100",)], "id string").orderBy(natural_sort_key(F.col("id")))
    assert [r["id"] for r in rows.collect()] == ["n:city:9", "n:city:10", "n:city:100"]
