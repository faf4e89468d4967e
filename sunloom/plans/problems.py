"""Queries of the data-cleaning operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.operators import clocks, nested, regular, rowcheck, spikes
from sunloom.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.found(table(spark, folder, "site_json"))


def p1_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The flat tables of all entities under one another, by ``entity``; all their attributes as JSON."""
    return nested.flat_rows(table(spark, folder, "site_json")).withColumn("attrs", F.to_json("attrs"))


def p1_rejected(spark: SparkSession, folder: str) -> DataFrame:
    """The bodies that can't be read, with the reason."""
    return nested.rejected_bodies(table(spark, folder, "site_json"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return spikes.found(table(spark, folder, "measurements"), table(spark, folder, "pvpro_results"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return regular.found(table(spark, folder, "measurements"), table(spark, folder, "system_metadata"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return rowcheck.bad_lines(table(spark, folder, "raw_lines"))


def p4_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The valid rows, one row a cell."""
    return rowcheck.loaded_cells(table(spark, folder, "raw_lines"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return clocks.found(table(spark, folder, "clock_log"), table(spark, folder, "system_metadata"), table(spark, folder, "zone_names"))


def p5_times(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the log with its time, what it was read from and the version of the zone database that was asked."""
    return clocks.utc_times(table(spark, folder, "clock_log"), table(spark, folder, "system_metadata"), table(spark, folder, "zone_names"))


QUERIES = {f.__name__: f for f in (p1_found, p1_tables, p1_rejected, p2_found, p3_found, p4_found, p4_loaded, p5_found, p5_times)}

#: Step of each source as the nearest to the middle distance of its readings within a day, then all grid points without a reading.
_P3 = """WITH raw AS (SELECT site, sensor, ts, CAST(ts AS DATE) AS day, CAST(epoch_ms(ts) - epoch_ms(CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS BIGINT) AS ms,
meas_val_f IS NOT NULL AND NOT isnan(meas_val_f) AS ok FROM measurements WHERE ts IS NOT NULL),
t AS (SELECT DISTINCT site, sensor, day, ms FROM raw WHERE ok),
g AS (SELECT site, sensor, day, ms - lag(ms) OVER (PARTITION BY site, sensor, day ORDER BY ms) AS gap FROM t),
r AS (SELECT site, sensor, day, gap, row_number() OVER (PARTITION BY site, sensor, day ORDER BY gap) AS k, count(*) OVER (PARTITION BY site, sensor, day) AS n FROM g WHERE gap IS NOT NULL),
v AS (SELECT site, sensor, n, CASE WHEN gap / 60000.0 < sqrt(50) THEN 5 WHEN gap / 60000.0 < sqrt(150) THEN 10 WHEN gap / 60000.0 < sqrt(450) THEN 15 WHEN gap / 60000.0 < sqrt(1800) THEN 30 ELSE 60 END AS s FROM r WHERE k = n // 2 + 1),
votes AS (SELECT site, sensor, s, sum(n) AS n FROM v GROUP BY 1, 2, 3),
shown AS (SELECT site, sensor, arg_max(s, n * 100 - s) AS s, sum(n) AS n FROM votes GROUP BY 1, 2),
meta AS (SELECT system, arg_max(CASE WHEN NOT isnan(data_sampling) THEN data_sampling END, revised_at) AS d FROM system_metadata GROUP BY 1),
src AS (SELECT raw.site, raw.sensor, min(day) AS a, max(day) AS b FROM raw GROUP BY 1, 2),
grid AS (SELECT src.site, src.sensor, a, b, CAST(CASE WHEN coalesce(shown.n, 0) >= 8 THEN shown.s ELSE coalesce(CASE WHEN d IN (5, 10, 15, 30, 60) THEN d WHEN d / 60 IN (5, 10, 15, 30, 60) THEN d / 60 END, shown.s, 60) END AS BIGINT) AS step
FROM src LEFT JOIN shown ON shown.site = src.site AND shown.sensor = src.sensor LEFT JOIN meta ON meta.system = src.sensor),
slots AS (SELECT site, sensor, x.x AS slot FROM grid, generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL (step) MINUTE, INTERVAL (step) MINUTE) AS x(x)),
taken AS (SELECT DISTINCT raw.site, raw.sensor, CAST(raw.day AS TIMESTAMP) + INTERVAL (CAST(floor(ms / (step * 60000.0) + 0.5) AS BIGINT) * step) MINUTE AS slot FROM raw JOIN grid ON grid.site = raw.site AND grid.sensor = raw.sensor WHERE ok)
SELECT site, sensor, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot FROM slots ANTI JOIN taken USING (site, sensor, slot)"""
#: Fields of well-quoted records by pattern; each field against the pattern of its column's kind.
_LINES = r"""WITH h AS (SELECT file_id, min(line) AS line FROM (SELECT file_id, regexp_replace(regexp_replace(coalesce(line, ''), '^\x{FEFF}+', ''), '\r$', '') AS line FROM raw_lines WHERE line_no = 1) GROUP BY 1),
d AS (SELECT file_id, line, CASE WHEN length(replace(line, ',', '')) <= least(length(replace(line, ';', '')), length(replace(line, chr(9), ''))) THEN ',' WHEN length(replace(line, ';', '')) <= length(replace(line, chr(9), '')) THEN ';' ELSE chr(9) END AS d FROM h),
b AS (SELECT r.file_id, r.line_no, regexp_replace(coalesce(r.line, ''), '\r$', '') AS text, d.d, string_split(replace(d.line, '"', ''), d.d) AS names FROM raw_lines r JOIN d USING (file_id) WHERE line_no <> 1),
q AS (SELECT *, CASE d WHEN ',' THEN regexp_full_match(text, '(?s)(?:[^",]*|[ \t]*"(?:[^"]|"")*"[ \t]*)(?:,(?:[^",]*|[ \t]*"(?:[^"]|"")*"[ \t]*))*')
WHEN ';' THEN regexp_full_match(text, '(?s)(?:[^";]*|[ \t]*"(?:[^"]|"")*"[ \t]*)(?:;(?:[^";]*|[ \t]*"(?:[^"]|"")*"[ \t]*))*')
ELSE regexp_full_match(text, '(?s)(?:[^"\t]*|[ ]*"(?:[^"]|"")*"[ ]*)(?:\t(?:[^"\t]*|[ ]*"(?:[^"]|"")*"[ ]*))*') END AS quoted_well FROM b),
c AS (SELECT *, string_split(array_to_string(list_transform(list_zip(string_split(text, '"'), range(len(string_split(text, '"')))), lambda x: CASE WHEN x[2] % 2 = 1 THEN replace(x[1], d, chr(1)) WHEN x[1] = '' AND x[2] > 0 AND x[2] < len(string_split(text, '"')) - 1 THEN chr(2) ELSE x[1] END), ''), d) AS cells FROM q),
e AS (SELECT file_id, line_no, quoted_well, len(cells) = len(names) AS fits, list_zip(names, cells) AS pairs, d FROM c),
v AS (SELECT *, CASE WHEN quoted_well AND fits THEN list_bool_and(list_transform(pairs, lambda p: CASE WHEN trim(p[1]) = 'note' THEN true
WHEN trim(p[1]) = 'ts' THEN regexp_full_match(trim(p[2], ' ' || chr(9)), '[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])[ T]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?') AND try_cast(substr(trim(p[2], ' ' || chr(9)), 1, 10) AS DATE) IS NOT NULL
WHEN trim(p[2], ' ' || chr(9)) IN ('', 'NA', 'NaN') THEN true
WHEN trim(p[1]) = 'status' THEN regexp_full_match(trim(p[2], ' ' || chr(9)), '[+-]?[0-9]+')
WHEN d = ';' THEN regexp_full_match(trim(p[2], ' ' || chr(9)), '[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)?')
ELSE regexp_full_match(trim(p[2], ' ' || chr(9)), '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') END)) END AS valid FROM e)"""
_P4 = _LINES + """ SELECT file_id, line_no, CASE WHEN NOT quoted_well THEN 'quoting' WHEN NOT fits THEN 'columns' ELSE 'value' END AS reason FROM v WHERE NOT quoted_well OR NOT fits OR NOT valid"""
_P4_LOADED = _LINES + """, good AS (SELECT file_id, line_no, d, unnest(list_zip(pairs, range(1, len(pairs) + 1))) AS p FROM v WHERE quoted_well AND fits AND valid),
cells AS (SELECT file_id, line_no, CAST(p[2] AS INTEGER) AS position, lower(trim(p[1][1])) AS "column", trim(replace(replace(p[1][2], chr(1), d), chr(2), '"'), ' ' || chr(9)) AS value FROM good)
SELECT file_id, line_no, position, "column", CASE WHEN value NOT IN ('', 'NA', 'NaN') THEN value END AS value FROM cells"""
_P1_REJECTED = """SELECT json_id, CASE WHEN body IS NULL OR trim(body, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'empty' WHEN NOT json_valid(body) THEN 'no JSON' ELSE 'no object' END AS reason
FROM site_json WHERE body IS NULL OR NOT json_valid(body) OR json_type(body) <> 'OBJECT'"""
SQL = {"p1_rejected": _P1_REJECTED, "p3_found": _P3, "p4_found": _P4, "p4_loaded": _P4_LOADED}
