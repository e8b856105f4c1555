"""Vectors and text experiments by the embedder that SQL can compute: compared on values."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.collections import _FOCUS, _candidate_inputs
from checks.registry import Tables, register, rounded
from checks.text import _TEXTS, _v2_sql
from checks.whole import _ALL_FOCUSED
from terralex.functions.letter_groups import letter_group_counts, letter_group_vector
from terralex.operators import candidates
from terralex.operators.embed import embed_by_columns
from terralex.plans import evaluate

_DIGITS = 9


def _sql_slots(source: str, key: str, text: str) -> dict[str, str]:
    """CTEs ending in `slots`: (key, slot, n) of every text."""
    trim = f"trim({text}, chr(9) || chr(10) || chr(13) || ' ')"
    return {
        "points": f"""SELECT {key}, list_transform(regexp_extract_all('  ' || translate({trim}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || ' ', '(?s).'),
                      lambda c: unicode(c)::BIGINT) AS p FROM {source}""",
        "groups": f"SELECT {key}, unnest(list_transform(range(1, len(p) - 1), lambda i: (p[i] * 31337 + p[i + 1] * 7919 + p[i + 2] * 104729) % 1000003 % 64)) AS slot FROM points",
        "slots": f"SELECT {key}, slot, count(*) AS n FROM groups GROUP BY {key}, slot",
    }


@register(
    "X1_letter_group_vectors",
    """SELECT doc_id, sum(n)::BIGINT AS letter_groups, count(*) AS used_slots, md5(string_agg(slot || ':' || n, ',' ORDER BY slot)) AS slot_counts_md5,
              round(sqrt(sum(n * n)), 4) AS length, round(max(n) / sqrt(sum(n * n)), 4) AS largest FROM slots GROUP BY doc_id""",
    then=_sql_slots("documents", "doc_id", "text"))
def letter_group_vectors(t: Tables):
    """The vectors of all documents by value: every slot's count, their length, and the largest share."""
    rows = embed_by_columns(t.table("documents").select("doc_id", "text"), "text", lambda c: F.struct(letter_group_counts(c).alias("n"), letter_group_vector(c).alias("v")), "e")
    numbered = F.transform("e.n", lambda n, k: F.concat_ws(":", k.cast("string"), n.cast("string")))
    used = F.filter(numbered, lambda x: ~x.endswith(":0"))
    square = F.aggregate("e.n", F.lit(0).cast("bigint"), lambda total, x: total + x.cast("bigint") * x)
    return rows.select(
        "doc_id", F.aggregate("e.n", F.lit(0).cast("bigint"), lambda total, x: total + x).alias("letter_groups"), F.size(used).cast("bigint").alias("used_slots"),
        F.md5(F.array_join(used, ",")).alias("slot_counts_md5"), F.round(F.sqrt(square), 4).alias("length"), F.round(F.array_max("e.v").cast("double"), 4).alias("largest"))


def _described(sql: str) -> str:
    return sql.replace("names,", "names, descr,")


_V1 = """SELECT id, concat_ws(chr(10), names, descr, l_region, l_cont, l_code, CASE WHEN country IS NOT NULL THEN 'Country: ' || country || '.' END,
         CASE WHEN capital IS NOT NULL THEN 'Capital: ' || capital || '.' WHEN is_capital THEN 'Capital: true.' END,
         CASE WHEN currency IS NOT NULL THEN 'Currency: ' || currency || '.' END, l_lang) AS text FROM head"""
_V21 = _described(_v2_sql("name_en || ' has ' || capital || ' as its capital.'", "name_vi || ' có thủ đô là ' || capital || '.'"))
_EXPERIMENT = _ALL_FOCUSED | {
    "chosen": "SELECT id FROM need UNION SELECT id FROM fill",
    "named": """SELECT e.*, CAST(NULL AS VARCHAR) AS name_vi, CASE WHEN type = 'country' THEN 'en, ' || lower('NT' || chr(65 + CAST(geoname_id AS INT))) END AS languages
                FROM ents e JOIN chosen USING (id)""",
    "head": _TEXTS["head"],
    "wanted": "SELECT case_id, id AS expected, 'Which country is ' || name_en AS query FROM exp",
    "sides": f"""SELECT 'q' AS side, case_id AS id, query AS text FROM wanted UNION ALL SELECT 'before', id, text FROM ({_V1}) UNION ALL SELECT 'after', id, text FROM ({_V21})""",
    **_sql_slots("sides", "side, id", "text"),
    "vec": """SELECT side, id, list_transform(range(64), lambda k: CAST(CAST(coalesce(m[k], 0) / z AS FLOAT) AS DOUBLE)) AS v
              FROM (SELECT side, id, map(list(slot), list(n)) AS m, sqrt(sum(n * n)) AS z FROM slots GROUP BY side, id)""",
    "scored": """SELECT d.side, q.id AS case_id, d.id, d.id = w.expected AS hit, floor(list_cosine_similarity(q.v, d.v) * 1e9 + 0.5) / 1e9 AS score
                 FROM vec q JOIN wanted w ON w.case_id = q.id JOIN vec d ON d.side <> 'q' WHERE q.side = 'q'""",
    "placed_at": "SELECT *, row_number() OVER (PARTITION BY side, case_id ORDER BY score DESC, id) AS r FROM scored",
    "found": """SELECT side, case_id, min(CASE WHEN hit THEN r END) AS expected_rank, max(CASE WHEN r = 1 THEN id END) AS top1_id, max(CASE WHEN r = 1 THEN score END) AS top1_score,
                max(CASE WHEN hit THEN score END) - max(CASE WHEN NOT hit THEN score END) AS target_margin FROM placed_at GROUP BY side, case_id""",
}


def _experiment(t: Tables):
    cases, results, rows = _candidate_inputs(t, "true")
    selection = candidates.focused_candidates(cases, results, rows, _FOCUS, target_size=120)
    return evaluate.text_experiment(cases, rows, selection, digits=_DIGITS, embedding=letter_group_vector)


_SIDES = ", ".join(
    f"{s[0]}.expected_rank AS {s}_rank, {s[0]}.top1_id AS {s}_top1_id, round({s[0]}.top1_score, 6) AS {s}_top1_score, round({s[0]}.target_margin, 6) AS {s}_target_margin" for s in ("before", "after"))


@register(
    "C14_experiment_cases",
    f"""SELECT case_id, {_SIDES}, b.expected_rank - a.expected_rank AS rank_gain FROM (SELECT * FROM found WHERE side = 'before') b
        JOIN (SELECT * FROM found WHERE side = 'after') a USING (case_id)""", "ent", then=_EXPERIMENT)
def experiment_cases(t: Tables):
    """Two document texts over one candidate set: every case's rank, winner and margin under both."""
    paired = _experiment(t)["paired"]
    columns = [F.col(f"{s}_{c}").alias(f"{s}_{n}") for s in ("before", "after") for c, n in (("expected_rank", "rank"), ("top1_id", "top1_id"), ("top1_score", "top1_score"), ("target_margin", "target_margin"))]
    kept = paired.select("case_id", *columns, "rank_gain")
    long = {c: F.col(c).cast("bigint") for c in ("before_rank", "after_rank", "rank_gain")}
    return rounded(kept.withColumns(long), *[f"{s}_{c}" for s in ("before", "after") for c in ("top1_score", "target_margin")])


_MEANS = "avg(CASE WHEN expected_rank <= 5 THEN 1.0 / expected_rank ELSE 0 END) AS mrr, " + ", ".join(f"avg(CASE WHEN expected_rank <= {k} THEN 1.0 ELSE 0 END) AS recall_at_{k}" for k in (1, 3, 5))
_METRICS = ("mrr", "recall_at_1", "recall_at_3", "recall_at_5")


@register(
    "C14_C11_experiment_deltas",
    f"SELECT 'overall' AS scope, {', '.join(f'round(a.{m}, 6) AS after_{m}, round(a.{m} - b.{m}, 6) AS delta_{m}' for m in _METRICS)} "
    f"FROM (SELECT {_MEANS} FROM found WHERE side = 'before') b, (SELECT {_MEANS} FROM found WHERE side = 'after') a", "ent", then=_EXPERIMENT)
def experiment_deltas(t: Tables):
    found = _experiment(t)["deltas"].where("scope = 'overall'")
    columns = [f"{side}_{m}" for m in _METRICS for side in ("after", "delta")]
    return rounded(found.select("scope", *columns), *columns)
