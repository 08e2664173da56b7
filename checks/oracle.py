"""The SQL each query is compared with."""

from __future__ import annotations

from checks.standin import EXPRESSIONS, LOOKUP_CODE
from eventloom.schemas import FEATURES, GEO_LATITUDES, GEO_TYPES, MODEL_COLUMNS, NUM_CLASSES, RAW

_TYPES = {"string": "varchar", "int": "integer", "double": "double"}

RAW_SQL = "SELECT o_orderkey AS rid, " + ", ".join(
    f"CAST({EXPRESSIONS[f.name]} AS {_TYPES[f.dataType.simpleString()]}) AS {f.name}" for f in RAW.fields
) + " FROM orders JOIN customer ON o_custkey = c_custkey"

RECODED = (
    "CASE CAMEOCode WHEN '042' THEN '20' WHEN '043' THEN '21' WHEN '046' THEN '22' WHEN '044' THEN '51' "
    "WHEN '041' THEN '52' WHEN '045' THEN '53' WHEN '020' THEN '54' ELSE CAMEOCode END"
)
ROOT = f"substr({RECODED}, 1, 2)"
CLASS = f"coalesce(CAST(TRY_CAST({ROOT} AS DOUBLE) AS INTEGER), 0)"


def _rank(column: str) -> str:
    return f"CAST(dense_rank() OVER (ORDER BY {column} NULLS LAST) - 1 AS INTEGER)"


def _geo_type(column: str) -> str:
    return f"coalesce(CAST({column} AS INTEGER), 0)"


def _lat_int(column: str) -> str:
    return f"coalesce(CAST(trunc({column}) AS INTEGER), 0)"


_MONTH = "CAST(substr(Date, 5, 2) AS INTEGER)"
_YEAR = "CAST(substr(Date, 1, 4) AS INTEGER)"
_QUAD = "CAST(TRY_CAST(QuadClass AS DOUBLE) AS INTEGER)"
_GOLDSTEIN = "TRY_CAST(Goldstein AS DOUBLE)"
_ENCODED_COLUMNS = ", ".join(
    [
        "rid",
        "Date",
        f"{_rank('Source')} AS Source",
        f"{_rank('Target')} AS Target",
        f"{CLASS} AS CAMEOCode",
        "NumEvents",
        "NumArts",
        f"{_QUAD} AS QuadClass",
        f"{_GOLDSTEIN} AS Goldstein",
        *[f"{_geo_type(c)} AS {c}" for c in GEO_TYPES],
        *[c for c in RAW.names if c.endswith(("Lat", "Long"))],
        *[f"{_lat_int(c)} AS {c}Int" for c in GEO_LATITUDES],
        f"{_MONTH} AS Month",
        f"{_YEAR} AS Year",
    ]
)
WITH_RAW = f"WITH raw AS ({RAW_SQL})"
WITH_ENCODED = f"{WITH_RAW}, encoded AS (SELECT {_ENCODED_COLUMNS} FROM raw)"
WITH_VALID = f"{WITH_ENCODED}, valid AS (SELECT * FROM encoded WHERE CAMEOCode <= 22)"
_MODEL = ", ".join(MODEL_COLUMNS)

WITH_ACTIVITY = """WITH activity AS (
  SELECT user_id, ts, event_id, value, hour(ts) AS hour, minute(ts) AS minute,
         CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS kind
  FROM events),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM activity)"""
_STEPS = """SELECT w.user_id, w.event_id, w.seq, CAST(p.seq - w.seq + 30 AS INTEGER) AS step, w.kind AS label,
  p.value AS value, CAST(p.hour AS DOUBLE) AS hour, CAST(p.minute AS DOUBLE) AS minute, CAST(p.kind AS DOUBLE) AS kind
  FROM numbered w JOIN numbered p ON p.user_id = w.user_id AND p.seq BETWEEN w.seq - 30 AND w.seq - 1
  WHERE w.seq >= 30"""


def _digest(seed: int, key: str = "rid") -> str:
    return f"md5(concat('{seed}:', CAST({key} AS VARCHAR)))"


def _digest_number(seed: int, key: str = "rid") -> str:
    return f"CAST(concat('0x', substr({_digest(seed, key)}, 1, 8)) AS BIGINT)"


def _digamma(x: str) -> str:
    """The recurrence up to x + 8, then the asymptotic series."""
    far = f"({x} + 8.0::DOUBLE)"
    steps = " - ".join(f"1.0::DOUBLE / ({x} + {i})" for i in range(8))
    return f"(ln{far} - 0.5 / {far} - 1.0::DOUBLE / (12 * {far}^2) + 1.0::DOUBLE / (120 * {far}^4) - 1.0::DOUBLE / (252 * {far}^6) + 1.0::DOUBLE / (240 * {far}^8) - 1.0::DOUBLE / (132 * {far}^10) - {steps})"


def _neighbours(feature: str) -> str:
    """Of each row the third distance in its class, and the rows nearer than that; values are multiples of 2^-33."""
    near = [f"{f}(x, {i}) OVER c" for f in ("lag", "lead") for i in (1, 2, 3)]
    distances = ", ".join(f"abs(x - {n})" for n in near)
    return f"""SELECT '{feature}' AS feature, round(greatest({_digamma("count(*)::DOUBLE")} + avg({_digamma("k::DOUBLE")} - {_digamma("n::DOUBLE")} - {_digamma("near::DOUBLE")}), 0), 9) AS mi FROM (
  SELECT n, k, count(*) OVER (ORDER BY x RANGE BETWEEN r PRECEDING AND r FOLLOWING) AS near FROM (
    SELECT x, n, k, greatest(list_sort(list_filter([{distances}], lambda v: v IS NOT NULL))[k::BIGINT] - pow(2::DOUBLE, -33), 0) AS r FROM (
      SELECT *, count(*) OVER (PARTITION BY CAMEOCode) AS n, least(3, count(*) OVER (PARTITION BY CAMEOCode) - 1) AS k FROM (
        SELECT rid, CAMEOCode, {feature}::DOUBLE + floor({_digest_number(0)} / 4096::DOUBLE) / 1048576 / 8192 AS x FROM valid))
    WHERE n > 1 WINDOW c AS (PARTITION BY CAMEOCode ORDER BY x, rid)))"""


def _mi(feature: str, value: str, source: str) -> str:
    return f"""SELECT '{feature}' AS feature, round(sum(c / t * ln(c * t / (cv * cl))), 9) + 0.0 AS mi FROM (
  SELECT c, sum(c) OVER () AS t, sum(c) OVER (PARTITION BY v) AS cv, sum(c) OVER (PARTITION BY l) AS cl FROM (
    SELECT {value} AS v, CAMEOCode AS l, CAST(count(*) AS DOUBLE) AS c
    FROM {source} WHERE {value} IS NOT NULL GROUP BY 1, 2))"""


def _scaled(column: str, table: str) -> str:
    low, high = f"(SELECT min({column}) FROM {table})", f"(SELECT max({column}) FROM {table})"
    return (
        f"CASE WHEN {column} IS NULL THEN NULL WHEN {low} = {high} THEN 0.0 "
        f"ELSE (CAST({column} AS DOUBLE) - {low}) / ({high} - {low}) END"
    )


_BINNED = ["SourceGeoLat", "TargetGeoLat", "ActionGeoLat"]


def _bin(column: str) -> str:
    return f"least(CAST(floor({_scaled(column, 'valid')} * 10) AS INTEGER), 9)"


_CORRELATED = [*MODEL_COLUMNS, "Goldstein", "SourceGeoLat", "Constant", "Late"]


def _correlation() -> str:
    cells = []
    for a in _CORRELATED:
        for b in _CORRELATED:
            x = f"CASE WHEN {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END"
            y = f"CASE WHEN {a} IS NOT NULL THEN CAST({b} AS DOUBLE) END"
            cells.append(
                f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({x}, {y}) / "
                f"nullif(stddev_pop({x}) * stddev_pop({y}), 0), 9) + 0.0 AS r FROM wide"
            )
    return (
        f"{WITH_VALID}, wide AS (SELECT *, 1 AS Constant, CASE WHEN rid > 4000 THEN NumEvents * NumArts + 1e7::DOUBLE END AS Late FROM valid) " + " UNION ALL ".join(cells)
    )


# Stand-in predictions: right for about seven rows in ten, off by one class otherwise.
_GUESS = "CASE WHEN rid % 10 < 7 THEN CAMEOCode ELSE (CAMEOCode + 1) % 23 END + (rid % 5 - 2) * 0.2"
WITH_GUESSES = (
    f"{WITH_VALID}, guesses AS (SELECT rid, CAST(CAMEOCode AS DOUBLE) AS label, "
    f"round_even(CAST({_GUESS} AS DOUBLE), 0) AS prediction, CAST({_digest_number(7)} % 3 AS INTEGER) AS fold FROM valid)"
)
_EQUAL = "CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END"

_NUMBERED_FOLDS = (
    f"{WITH_VALID} SELECT rid, CAMEOCode, CAST((row_number() OVER (PARTITION BY CAMEOCode "
    f"ORDER BY {_digest(9)}, rid) - 1) % 3 AS INTEGER) AS fold FROM valid"
)


def _weighted_steps() -> str:
    """Order-sensitive sum of each feature over each window of the dominant actor."""
    sums = ", ".join(
        f"sum(CAST(p.{c} AS DOUBLE) * (p.seq - w.seq + 31)) AS sum_{c}" for c in MODEL_COLUMNS
    )
    return f"""{WITH_VALID}, hot AS (
  SELECT *, row_number() OVER (ORDER BY Date, rid) - 1 AS seq FROM valid
  WHERE Source = (SELECT min(e.Source) FROM encoded e JOIN raw r ON e.rid = r.rid WHERE r.Source = 'USA'))
SELECT w.rid, w.seq, w.CAMEOCode AS label, u.* EXCLUDE (wid) FROM hot w JOIN (
  SELECT w.rid AS wid, {sums}
  FROM hot w JOIN hot p ON p.seq BETWEEN w.seq - 30 AND w.seq - 1 WHERE w.seq >= 30 GROUP BY w.rid) u ON u.wid = w.rid"""


_INDEX = (
    "labels AS (SELECT CAMEOCode, row_number() OVER (ORDER BY count(*) DESC, CAST(CAMEOCode AS VARCHAR)) - 1 AS i "
    "FROM valid GROUP BY CAMEOCode)"
)
_CANDIDATES = (
    "SELECT * FROM (VALUES (0::INTEGER, '3', '0.0'), (1::INTEGER, '4', '0.0'), (2::INTEGER, '3', '5.0'), (3::INTEGER, '4', '5.0')) "
    'v(candidate, "param_maxDepth", "param_minSplitGain"), (SELECT true AS is_mean, true AS is_normalized, true AS is_ranked)'
)


def _held_out(seed: int) -> str:
    return f"substr({_digest(seed)}, 1, 8) < '33333333'"


def _predicted(which: str) -> str:
    return f"{WITH_VALID} SELECT rid, CAST(CAMEOCode AS DOUBLE) AS label, true AS in_range FROM valid WHERE {which}"


def _growing_dictionary() -> str:
    """Codes of the early values in order, missing last; those of the others after them, in order."""
    renamed = "SELECT * REPLACE (CASE WHEN Date >= '19950101' THEN concat(Target, '_late') ELSE Target END AS Target) FROM raw"
    codes = ", ".join(
        f"{c}_codes AS (SELECT value, CAST(row_number() OVER (ORDER BY first >= '19950101', value NULLS LAST) - 1 AS INTEGER) AS code "
        f"FROM (SELECT {c} AS value, min(Date) AS first FROM renamed GROUP BY {c}))"
        for c in ("Source", "Target")
    )
    return (
        f"{WITH_RAW}, renamed AS ({renamed}), {codes} SELECT Date, s.code AS Source, t.code AS Target, {CLASS} AS CAMEOCode "
        "FROM renamed r JOIN Source_codes s ON s.value IS NOT DISTINCT FROM r.Source JOIN Target_codes t ON t.value IS NOT DISTINCT FROM r.Target"
    )


def oracle_sql() -> dict[str, str]:
    raw_columns = ", ".join(RAW.names)
    encoded_names = (
        "Date, Source, Target, CAMEOCode, NumEvents, NumArts, QuadClass, Goldstein, SourceGeoType, SourceGeoLat, "
        "SourceGeoLong, TargetGeoType, TargetGeoLat, TargetGeoLong, ActionGeoType, ActionGeoLat, ActionGeoLong, "
        "SourceGeoLatInt, TargetGeoLatInt, ActionGeoLatInt, Month, Year"
    )
    class_names = ", ".join(f"CASE WHEN CAMEOCode = {i} THEN 1.0 ELSE 0.0 END::DOUBLE AS class_{i}" for i in range(NUM_CLASSES))
    return {
        # sources and sinks
        "raw_scan": f"{WITH_RAW} SELECT {raw_columns} FROM raw",
        "encoded_scan": f"{WITH_VALID} SELECT {_MODEL} FROM valid",
        "encoded_csv_scan": f"{WITH_ENCODED} SELECT {_MODEL} FROM encoded",
        "chunked_ingest": f"{WITH_ENCODED} SELECT {encoded_names} FROM encoded",
        "growing_dictionary": _growing_dictionary(),
        "code_lookup_scan": f"SELECT {LOOKUP_CODE.replace('string', 'varchar')} AS code, p_name AS description FROM part",
        "sequence_table": f"{WITH_ACTIVITY} {_STEPS}",
        "sample_head": f"{WITH_RAW} SELECT rid, Date, Source, Target, CAMEOCode, NumEvents, NumArts FROM raw ORDER BY Date, rid LIMIT 100000",
        "large_head": f"{WITH_RAW} SELECT rid, Date, CAMEOCode FROM raw ORDER BY Date, rid LIMIT 12000",
        "actor_events": f"{WITH_RAW}, e AS (SELECT * FROM ({WITH_ENCODED} SELECT * FROM encoded)) SELECT e.rid, {', '.join('e.' + c for c in MODEL_COLUMNS)} FROM e JOIN raw ON raw.rid = e.rid WHERE e.CAMEOCode <= 22 AND raw.Source = 'USA'",
        "prediction_rows": f"{WITH_VALID} SELECT rid, CAST(CAMEOCode AS DOUBLE) AS label, 23 AS classes, true AS in_range, true AS sums_to_one FROM valid WHERE substr({_digest(42)}, 1, 8) < '33333333'",
        "model_reload": f"{WITH_VALID} SELECT rid, CAST(CAMEOCode AS DOUBLE) AS label, true AS same FROM valid WHERE substr({_digest(42)}, 1, 8) < '33333333'",
        # projections, filters, scalars
        "drop_leaky": f"{WITH_ENCODED} SELECT * EXCLUDE (QuadClass, Goldstein) FROM encoded",
        "label_and_features": f"{WITH_ENCODED} SELECT rid, CAMEOCode AS label, {', '.join(FEATURES)} FROM encoded",
        "model_columns": f"{WITH_ENCODED} SELECT rid, {_MODEL} FROM encoded",
        "valid_classes": f"{WITH_ENCODED} SELECT rid, CAMEOCode FROM encoded WHERE CAMEOCode <= 22",
        "actor_filter": f"{WITH_RAW} SELECT rid, Source, Target, CAMEOCode FROM raw WHERE Source = 'USA'",
        "recoded_codes": f"{WITH_RAW} SELECT rid, CAMEOCode, {RECODED} AS recoded FROM raw",
        "code_roots": f"{WITH_RAW} SELECT rid, {ROOT} AS root FROM raw",
        "event_classes": f"{WITH_RAW} SELECT rid, {CLASS} AS event_class FROM raw",
        "lenient_numbers": f"{WITH_RAW} SELECT rid, {_QUAD} AS QuadClass, {_GOLDSTEIN} AS Goldstein FROM raw",
        "geo_types": f"{WITH_RAW} SELECT rid, {', '.join(f'{_geo_type(c)} AS {c}' for c in GEO_TYPES)} FROM raw",
        "latitude_buckets": f"{WITH_RAW} SELECT rid, {', '.join(f'{_lat_int(c)} AS {c}Int' for c in GEO_LATITUDES)} FROM raw",
        "date_parts": f"{WITH_RAW} SELECT rid, {_MONTH} AS Month, {_YEAR} AS Year FROM raw",
        "rounded_predictions": f"{WITH_GUESSES} SELECT rid, label, prediction FROM guesses",
        "code_collisions": f"{WITH_RAW} SELECT {CLASS} AS event_class, CAMEOCode AS code, count(*) AS n FROM raw WHERE {ROOT} IN ('20','21','22','51','52','53','54') AND CAMEOCode NOT IN ('042','043','046','044','041','045','020') GROUP BY 1, 2",
        # encoding and scaling
        "encoded_events": f"{WITH_ENCODED} SELECT * FROM encoded",
        "actor_dictionary": f"{WITH_RAW}, named AS (SELECT 'Source' AS actor, Source AS value FROM raw UNION SELECT 'Target', Target FROM raw) SELECT actor, value, CAST(row_number() OVER (PARTITION BY actor ORDER BY value NULLS LAST) - 1 AS INTEGER) AS code FROM named",
        "large_dictionary": "SELECT text AS value, CAST(row_number() OVER (ORDER BY text NULLS LAST) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT c_name AS text FROM customer)",
        "dictionary_encoded": f"{WITH_RAW} SELECT rid, {_rank('Source')} AS Source, {_rank('Target')} AS Target FROM raw",
        "label_index": f"{WITH_VALID} SELECT CAST(CAMEOCode AS VARCHAR) AS label, CAST(row_number() OVER (ORDER BY count(*) DESC, CAST(CAMEOCode AS VARCHAR)) - 1 AS INTEGER) AS index FROM valid GROUP BY CAMEOCode",
        "assembled_features": f"{WITH_ENCODED} SELECT rid, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in FEATURES)} FROM encoded",
        "category_index": f"{WITH_RAW} SELECT rid, CAST(o_orderkey % 4 AS DOUBLE) AS quad, CAST(NumEvents AS DOUBLE) AS NumEvents FROM raw JOIN orders ON rid = o_orderkey",
        "one_hot_label": f"{WITH_VALID} SELECT rid, {class_names} FROM valid",
        "min_max_scaled": f"{WITH_ENCODED} SELECT rid, {', '.join(f'round({_scaled(c, chr(101) + "ncoded")}, 9) AS {c}' for c in [*FEATURES, 'SourceGeoLat'])}, CAST(0 AS DOUBLE) AS Constant FROM encoded",
        "column_bounds": f"{WITH_ENCODED} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high FROM encoded" for c in [*FEATURES, "ActionGeoLat"]),
        # joins
        "described_events": f"{WITH_RAW}, codes AS (SELECT {LOOKUP_CODE.replace('string', 'varchar')} AS code, p_name AS description FROM part) SELECT rid, CAMEOCode, c.description, r.description AS root_description FROM raw LEFT JOIN codes c ON c.code = CAMEOCode LEFT JOIN codes r ON r.code = substr(CAMEOCode, 1, 2)",
        "hot_value_lookup": f"{WITH_RAW} SELECT rid, Source, {_rank('Source')} AS code FROM raw",
        # aggregations
        "class_histogram": f"{WITH_VALID} SELECT CAST(c.i AS INTEGER) AS label, count(CAMEOCode) AS n FROM range(23) c(i) LEFT JOIN valid ON CAMEOCode = c.i GROUP BY c.i",
        "correlation_matrix": _correlation(),
        "feature_scores": f"{WITH_VALID} " + " UNION ALL ".join(_mi(f, f, "valid") for f in FEATURES),
        "binned_feature_scores": f"{WITH_VALID} " + " UNION ALL ".join(_mi(f, _bin(f), "valid") for f in _BINNED),
        "neighbour_scores": f"{WITH_VALID} " + " UNION ALL ".join(_neighbours(f) for f in ["Source", "NumEvents", "NumArts", "SourceGeoLatInt", "TargetGeoLatInt"]),
        "top_features": f"{WITH_VALID}, scores AS (" + " UNION ALL ".join(_mi(f, f, "valid") for f in FEATURES) + ") SELECT * FROM scores ORDER BY mi DESC, feature LIMIT 5",
        "distinct_labels": f"{WITH_ENCODED} SELECT DISTINCT CAMEOCode AS label FROM encoded",
        "accuracy": f"{WITH_GUESSES} SELECT count(*) AS n, round(avg({_EQUAL}), 9) AS accuracy, round(1 - avg({_EQUAL}), 9) AS test_error FROM guesses",
        "mean_score": f"{WITH_GUESSES}, folds AS (SELECT fold, avg({_EQUAL}) AS accuracy FROM guesses GROUP BY fold) SELECT round(avg(accuracy), 9) AS mean_score, round(stddev_pop(accuracy), 9) AS std_score FROM folds",
        # windows
        "lag_windows": f"{WITH_ACTIVITY} {_STEPS}",
        "lag_windows_blocks": f"{WITH_ACTIVITY} {_STEPS}",
        "hot_actor_windows": _weighted_steps(),
        "actor_positions": f"{WITH_RAW} SELECT rid, Source, row_number() OVER (PARTITION BY Source ORDER BY Date, rid) - 1 AS seq FROM raw",
        "tail_holdout": f"{WITH_ACTIVITY}, w AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS back FROM numbered WHERE seq >= 30) SELECT user_id, event_id, seq, kind AS label, CASE WHEN back <= 300 THEN 'test' ELSE 'train' END AS part FROM w",
        "flattened_windows": f"{WITH_ACTIVITY}, steps AS ({_STEPS}) SELECT event_id, step * 2 + f AS position, CASE f WHEN 0 THEN value ELSE hour END AS value FROM steps, (VALUES (0), (1)) x(f)",
        # limits, set operations
        "preview_predictions": f"{WITH_GUESSES} SELECT rid, label, prediction FROM guesses ORDER BY rid LIMIT 5",
        "append_chunks": f"{WITH_RAW} SELECT rid, Date, CAMEOCode FROM raw",
        # classification: what is known of models without fitting them
        "validation_scores": f"{WITH_VALID}, parts AS (SELECT CASE WHEN {_held_out(42)} THEN 'validation' ELSE 'train' END AS part FROM valid) SELECT part, count(*) AS n, true AS is_share FROM parts GROUP BY part",
        "boosted_trees": _predicted(_held_out(100)),
        "boosting_curve": f"{WITH_VALID}, parts AS (SELECT CASE WHEN {_held_out(100)} THEN 'validation' ELSE 'train' END AS part, CAMEOCode FROM valid) SELECT part, count(*) AS n, round(ln(23), 5) AS first_loss, round(avg(CASE WHEN CAMEOCode = 0 THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS first_accuracy, true AS falls, true AS complete FROM parts GROUP BY part",
        "random_forest": _predicted(_held_out(42)),
        "dense_network": _predicted(_held_out(42)),
        "dense_reload": f"{WITH_VALID} SELECT rid, CAST(CAMEOCode AS DOUBLE) AS label, true AS same FROM valid WHERE {_held_out(42)}",
        "indexed_boosting": f"{WITH_VALID}, {_INDEX} SELECT rid, CAST(i AS DOUBLE) AS label, true AS in_range FROM valid JOIN labels USING (CAMEOCode) WHERE {_digest_number(0)} >= 3006477107",
        "boosting_summary": f"{WITH_VALID}, {_INDEX} SELECT CAST(i AS INTEGER) AS class, 'GBTClassificationModel' AS kind, CAST(10 AS INTEGER) AS trees FROM labels",
        "network_curve": f"{WITH_VALID}, parts AS (SELECT CASE WHEN {_held_out(42)} THEN 'validation' ELSE 'train' END AS part FROM valid) SELECT CAST(i AS INTEGER) AS iteration, part, n, true AS is_loss, true AS is_share FROM (SELECT part, count(*) AS n FROM parts GROUP BY part), range(4, 21, 4) r(i)",
        "training_history": "SELECT CAST(0 AS INTEGER) AS first_iteration, true AS is_loss, true AS falls",
        "sequence_history": "SELECT CAST(0 AS INTEGER) AS first_iteration, true AS is_loss, true AS falls",
        "sequence_network": f"{WITH_ACTIVITY}, w AS (SELECT row_number() OVER (ORDER BY ts DESC, event_id DESC) AS back FROM numbered WHERE seq >= 30) SELECT CASE WHEN back <= 300 THEN 'validation' ELSE 'train' END AS part, count(*) AS n, true AS is_share FROM w GROUP BY 1",
        "cross_validation": f"{WITH_VALID}, folds AS (SELECT CAST((row_number() OVER (PARTITION BY CAMEOCode ORDER BY {_digest(0)}, rid) - 1) % 2 AS INTEGER) AS fold FROM valid) SELECT fold, count(*) AS n, true AS is_share FROM folds GROUP BY fold",
        "halving_rungs": "SELECT CAST(rung AS INTEGER) AS rung, CAST(rounds AS INTEGER) AS rounds, CAST(candidates AS INTEGER) AS candidates, CAST(2 * candidates AS INTEGER) AS fits FROM (VALUES (0, 1, 12), (1, 3, 4), (2, 9, 2)) r(rung, rounds, candidates)",
        "grid_search": _CANDIDATES,
        "search_results": _CANDIDATES,
        # splits
        "holdout_split": f"{WITH_VALID} SELECT rid, CASE WHEN substr({_digest(42)}, 1, 8) < '33333333' THEN 'test' ELSE 'train' END AS part FROM valid",
        "random_split": f"{WITH_VALID} SELECT rid, CASE WHEN {_digest_number(0)} < 3006477107 THEN 'train' ELSE 'test' END AS part FROM valid",
        "stratified_folds": _NUMBERED_FOLDS,
        "stratified_folds_ranged": _NUMBERED_FOLDS,
        "quantile_folds": f"{WITH_VALID} SELECT rid, CAMEOCode, CAST(ntile(3) OVER (PARTITION BY CAMEOCode ORDER BY {_digest(9)}, rid) - 1 AS INTEGER) AS fold FROM valid",
        "hashed_folds": f"{WITH_VALID} SELECT rid, CAMEOCode, CAST({_digest_number(9)} % 3 AS INTEGER) AS fold FROM valid",
    }
