"""Independent DuckDB SQL for each registered query (the correctness oracle).

The cohort is rebuilt here straight from the base tables (customer, nation,
orders) in SQL, without the wide text round trip, so the oracle checks the
Spark unpivot / parse / join logic rather than repeating it. Doubles are
rounded to 6 places, integer sums cast to BIGINT.
"""

from __future__ import annotations

from cohortflow.sources.fixture import UNLISTED_CAUSE, VA_CODES
from cohortflow.spec import (AGE_BANDS, CAUSE_VOCABULARY, DIABETES_TYPE_MAP, FIXTURE_PERIODS,
                             GROUP6_LEVELS, VASCULAR_ACCESS_MAP)

ORACLES: dict[str, str] = {}
P1, P2 = FIXTURE_PERIODS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _case_map(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in mapping.items())
    return f"CASE {col} {whens} END"


def _d(x) -> str:
    return f"DATE '{x.isoformat()}'"


# The cause vocabulary, as the SQL's own copy (code, label and group of the analysis, label and group of
# the chart), in the study's order.
VOCABULARY_SQL = """
  ('Infection Respiratory', 'Infección Respiratoria', 'Infección', 'Infección Respiratoria', 'Infección'),
  ('Cardiovascular Pulmonary Disease', 'Enfermedad Pulmonar Cardiovascular', 'Cardiovascular', 'Enfermedad Pulmonar Cardiovascular', 'Cardiovascular'),
  ('Digestive System Disorder', 'Trastorno del Sistema Digestivo', 'Otras Causas', 'Trastorno del Sistema Digestivo', 'Otras Causas'),
  ('Other', 'Otras Causas', 'Otras Causas', 'Otras Causas', 'Otras Causas'),
  ('Access Repair', 'Reparación de Acceso Vascular', 'Acceso Vascular (excl. infección)', 'Reparación de Acceso Vascular', 'Acceso Vascular (excl. infección)'),
  ('Musculoskeletal System Disorder', 'Trastorno del Sistema Musculoesquelético', 'Otras Causas', 'Trastorno del Sistema Musculoesquelético', 'Otras Causas'),
  ('Infection Blood', 'Bacteriemia', 'Infección', 'Bacteriemia', 'Infección'),
  ('Cardiovascular Vessel Disease', 'Enfermedad Cardiovascular Periférica', 'Cardiovascular', 'Enfermedad Cardiovascular Periférica', 'Cardiovascular'),
  ('Genitourinary Disorder', 'Trastorno Genitourinario', 'Otras Causas', 'Trastorno Genitourinario', 'Urológicas'),
  ('Cardiovascular Heart Disease', 'Enfermedad Cardiovascular', 'Cardiovascular', 'Enfermedad Cardiovascular', 'Cardiovascular'),
  ('Access Infection', 'Infección del Acceso Vascular', 'Infección', 'Infección de Acceso Vascular', 'Infección'),
  ('Immune Disorder Other', 'Otros Trastornos Inmunológicos', 'Otras Causas', 'Otros Trastornos Inmunológicos', 'Otras Causas'),
  ('Unknown', 'Desconocido', 'Otras Causas', 'Desconocido', 'Desconocido'),
  ('Infection Other', 'Otras Infecciones', 'Infección', 'Otras Infecciones', 'Infección'),
  ('Nervous System Disorder', 'Trastorno del Sistema Nervioso', 'Otras Causas', 'Trastorno del Sistema Nervioso', 'Otras Causas'),
  ('Access Other', 'Otras Causas - Acceso Vascular', 'Acceso Vascular (excl. infección)', 'Otras Causas - Acceso Vascular', 'Acceso Vascular (excl. infección)'),
  ('Circulatory Disease', 'Enfermedad Circulatoria', 'Cardiovascular', 'Enfermedad Circulatoria', 'Cardiovascular'),
  ('Infection Wound', 'Infección de la Herida', 'Infección', 'Infección de Herida', 'Infección'),
  ('Respiratory System Other Cause', 'Otras Causas Respiratorias', 'Otras Causas', 'Otras Causas Respiratorias', 'Otras Causas'),
  ('Infection COVID19 (SARS-CoV2 infection)', 'Infección COVID19 (Infección por SARS-CoV2)', 'Infección', 'Infección COVID19 (Infección por SARS-CoV2)', 'Infección'),
  ('Access Placement', 'Colocación de Acceso Vascular', 'Acceso Vascular (excl. infección)', 'Colocación de Acceso Vascular', 'Acceso Vascular (excl. infección)'),
  ('Blood Disorder Anemia', 'Anemia', 'Otras Causas', 'Anemia', 'Otras Causas'),
  ('Cerebrovascular Disease', 'Enfermedad Cerebrovascular', 'Cardiovascular', 'Enfermedad Cerebrovascular', 'Cardiovascular'),
  ('Injury/Accident', 'Lesión/Accidente', 'Otras Causas', 'Lesión/Accidente', 'Otras Causas'),
  ('Cardiovascular Other', 'Otros Trastornos Cardiovasculares', 'Cardiovascular', 'Otros Trastornos Cardiovasculares', 'Cardiovascular'),
  ('Blood Disorder Clotting', 'Trastorno de la Coagulación', 'Otras Causas', 'Trastorno de la Coagulación', 'Otras Causas'),
  ('Blood Disorder Other', 'Otros Trastornos Hematológicos', 'Otras Causas', 'Otros Trastornos Hematológicos', 'Otras Causas'),
  ('Endocrine Disorder Diabetes', 'Diabetes Mellitus', 'Otras Causas', 'Diabetes', 'Otras Causas'),
  ('Cancer/Neoplasms', 'Cáncer/Neoplasmas', 'Otras Causas', 'Cáncer/Neoplasmas', 'Otras Causas'),
  ('Metabolic Disorder', 'Trastorno Metabólico', 'Otras Causas', 'Trastorno Metabólico', 'Otras Causas'),
  ('Respiratory System COPD', 'Enfermedad Pulmonar Obstructiva Crónica (EPOC)', 'Otras Causas', 'Enfermedad Pulmonar Obstructiva Crónica (EPOC)', 'Otras Causas'),
  ('Mental Disorder', 'Trastorno Mental', 'Otras Causas', 'Trastorno Mental', 'Otras Causas'),
  ('Infection Peritonitis (PD Related Peritonitis Excluded)', 'Peritonitis (Excluyendo Peritonitis Relacionada con PD)', 'Infección', 'Peritonitis (Excluyendo Peritonitis Relacionada con PD)', 'Infección'),
  ('Skin Disorder', 'Trastorno de la Piel', 'Otras Causas', 'Trastorno de la Piel', 'Otras Causas'),
  ('Infection Tunnel/Cuff', 'Infección de Túnel/Cuff', 'Infección', 'Infección de Túnel/Cuff', 'Infección'),
  ('PD Catheter Replacement', 'Reemplazo de Catéter PD', 'Otras Causas', 'Reemplazo de Catéter PD', 'Otras Causas'),
  ('Other PD Related Cause', 'Otras Causas Relacionadas con PD', 'Otras Causas', 'Otras Causas Relacionadas con PD', 'Otras Causas'),
  ('PD Catheter Placement', 'Colocación de Catéter PD', 'Otras Causas', 'Colocación de Catéter PD', 'Otras Causas')"""
# End of fixed values.


def anniv(b: str, k: str) -> str:
    return f"(make_date(CAST(year({b}) + ({k}) AS BIGINT), month({b}), 1) + CAST(day({b}) - 1 AS INTEGER))"


def age_sql(b: str, ref: str) -> str:
    span = f"(year({ref}) - year({b}))"
    k = f"({span} - CASE WHEN {anniv(b, span)} > {ref} THEN 1 ELSE 0 END)"
    prev_, next_ = anniv(b, k), anniv(b, f"{k} + 1")
    return f"(CAST({k} AS DOUBLE) + ({ref} - {prev_}) / CAST(({next_} - {prev_}) AS DOUBLE))"


def band_sql(x: str) -> str:
    br, lab = AGE_BANDS.breaks, AGE_BANDS.labels
    whens = []
    for lo, hi, label in zip(br[:-1], br[1:], lab):
        hi_s = "'inf'::DOUBLE" if hi == float("inf") else repr(hi)
        whens.append(f"WHEN {x} > {lo!r} AND {x} <= {hi_s} THEN {_q(label)}")
    return "CASE " + " ".join(whens) + " END"


def period_sql(s: str, e: str) -> str:
    return (f"CASE WHEN {s} > {_d(P1.start)} AND {e} < {_d(P1.end)} THEN {_q(P1.label)} "
            f"WHEN {s} > {_d(P2.start)} AND {e} < {_d(P2.end)} THEN {_q(P2.label)} END")


BASE = f"""
vocab(code, label, group4, label6, group6) AS (VALUES {VOCABULARY_SQL}),
subj0 AS (
  SELECT c.c_custkey AS k, CAST(c.c_custkey AS VARCHAR) AS id, n.n_name, c.c_acctbal, c.c_mktsegment,
         DATE '1920-01-01' + CAST((c.c_custkey * 7919) % 25000 AS INTEGER) AS birth_date,
         CASE c.c_mktsegment WHEN 'BUILDING' THEN 'Type 1' WHEN 'MACHINERY' THEN 'Type 2'
              WHEN 'FURNITURE' THEN 'Other' END AS diabetes_type
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
),
subj AS (
  SELECT k, id, birth_date, diabetes_type,
    CASE WHEN k % 50 = 0 THEN NULL WHEN k % 2 = 0 THEN 'Mujer' ELSE 'Hombre' END AS gender,
    CASE WHEN c_acctbal < -900 THEN NULL WHEN c_acctbal >= 3000 THEN 'Si' ELSE 'No' END AS htn,
    CASE WHEN diabetes_type IS NOT NULL THEN 'Si' ELSE 'No' END AS diabetes,
    DATE '1996-01-01' + CAST(k % 300 AS INTEGER) AS status_date_p1,
    DATE '1997-01-01' + CAST(k % 300 AS INTEGER) AS status_date_p2,
    CASE WHEN k % 7 = 0 THEN NULL ELSE n_name END AS clinic_p1,
    CASE WHEN k % 11 = 0 THEN NULL ELSE n_name END AS clinic_p2,
    ['active', 'transferred', 'inactive'][k % 3 + 1] AS status_p1,
    ['active', 'transferred', 'inactive'][k % 3 + 1] AS status_p2,
    c_mktsegment AS substatus_p1, c_mktsegment AS substatus_p2,
    CAST((k * 13) % 12 AS DOUBLE) AS charlson_p1,
    CAST((k * 13) % 12 + k % 3 AS DOUBLE) AS charlson_p2,
    CAST(10 * ((k * 17) % 9 + 2) AS DOUBLE) AS karnofsky_p1,
    CAST(10 * ((k * 17) % 9 + 2) AS DOUBLE) AS karnofsky_p2,
    CASE WHEN diabetes_type IS NOT NULL THEN birth_date + 15000 END AS diabetes_date,
    CASE WHEN k % 31 = 0 THEN NULL ELSE {_list(VA_CODES)}[k % 4 + 1] END AS va_p1,
    CASE WHEN k % 31 = 0 THEN NULL ELSE {_list(VA_CODES)}[k % 4 + 1] END AS va_p2,
    CASE WHEN k % 13 = 0 THEN DATE '1998-06-01' + CAST(k % 100 AS INTEGER) END AS death_date,
    CASE WHEN k % 13 = 0 THEN CASE WHEN k % 2 = 0 THEN 'cardiac' ELSE 'infection' END END AS death_cause
  FROM subj0
),
ord AS (
  SELECT o_custkey, o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS d,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS place
  FROM orders
  WHERE o_custkey IN (SELECT c_custkey FROM customer)
),
adm AS (
  SELECT CAST(o_custkey AS VARCHAR) AS id, CAST(place % 9 + 1 AS INTEGER) AS adm_number,
    place // 9 AS file_row, d AS hosp_start,
    CASE WHEN o_orderkey % 97 <> 0 THEN d + CAST(o_orderkey % 15 AS INTEGER) END AS hosp_end,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
         WHEN o_orderpriority = '1-URGENT' THEN 'Si' ELSE 'No' END AS hosp_re,
    CASE WHEN o_orderkey % 40 < {len(CAUSE_VOCABULARY)}
         THEN {_list([v[0] for v in CAUSE_VOCABULARY])}[o_orderkey % 40 + 1]
         WHEN o_orderkey % 40 = {len(CAUSE_VOCABULARY)} THEN {_q(UNLISTED_CAUSE)} END AS hosp_cause,
    o_orderkey
  FROM ord
),
pl AS (
  SELECT id, gender, birth_date, htn, diabetes, diabetes_type, {_q(P1.label)} AS period,
         status_date_p1 AS status_date, clinic_p1 AS clinic, status_p1 AS status,
         substatus_p1 AS substatus, charlson_p1 AS charlson, karnofsky_p1 AS karnofsky, va_p1 AS va
  FROM subj WHERE clinic_p1 IS NOT NULL AND va_p1 IS NOT NULL
  UNION ALL
  SELECT id, gender, birth_date, htn, diabetes, diabetes_type, {_q(P2.label)} AS period,
         status_date_p2, clinic_p2, status_p2, substatus_p2, charlson_p2, karnofsky_p2, va_p2
  FROM subj WHERE clinic_p2 IS NOT NULL AND va_p2 IS NOT NULL
),
demo AS (
  SELECT id, gender, birth_date, htn, diabetes,
         {_case_map('diabetes_type', DIABETES_TYPE_MAP)} AS diabetes_type,
         period, status_date, clinic, status, substatus, charlson, karnofsky,
         {_case_map('va', VASCULAR_ACCESS_MAP)} AS va,
         age, {band_sql('age')} AS age_group
  FROM (SELECT *, CASE period WHEN {_q(P1.label)} THEN {age_sql('birth_date', _d(P1.start))}
                              WHEN {_q(P2.label)} THEN {age_sql('birth_date', _d(P2.start))} END AS age
        FROM pl)
),
adm_full AS (
  SELECT a.id, s.gender, s.htn, s.diabetes, a.adm_number, a.hosp_start, a.hosp_end, a.hosp_re, a.hosp_cause,
         {period_sql('a.hosp_start', 'a.hosp_end')} AS period
  FROM adm a JOIN subj s ON a.id = s.id
),
classified AS (
  SELECT a.id, a.gender, a.htn, a.diabetes, a.adm_number, a.hosp_start, a.hosp_end, a.hosp_re,
         v.label AS hosp_cause, a.period, v.group4 AS hosp_cause_groups,
         CAST(a.hosp_end - a.hosp_start AS INTEGER) AS person_time,
         CASE WHEN a.hosp_end - a.hosp_start <= 0 THEN ln(0.1)
              WHEN a.hosp_end - a.hosp_start > 0 THEN ln(a.hosp_end - a.hosp_start) END AS log_person_time
  FROM adm_full a LEFT JOIN vocab v ON a.hosp_cause = v.code
  WHERE a.period IS NOT NULL
),
presence AS (
  SELECT DISTINCT id, clinic, gender, age, age_group, htn, diabetes, charlson, va, period FROM demo
),
analysis AS (
  SELECT p.id, p.gender, p.htn, p.diabetes, e.adm_number, e.hosp_start, e.hosp_end, e.hosp_re,
         e.hosp_cause, p.period, e.hosp_cause_groups, e.person_time, e.log_person_time,
         p.clinic, p.age, p.age_group, p.charlson, p.va
  FROM classified e RIGHT JOIN presence p
    ON e.id IS NOT DISTINCT FROM p.id AND e.period IS NOT DISTINCT FROM p.period
   AND e.gender IS NOT DISTINCT FROM p.gender AND e.htn IS NOT DISTINCT FROM p.htn
   AND e.diabetes IS NOT DISTINCT FROM p.diabetes
),
both_ids AS (
  SELECT id FROM analysis GROUP BY id HAVING count(DISTINCT period) = 2
),
first_demo AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY id, period
        ORDER BY clinic ASC NULLS LAST, status_date ASC NULLS LAST, charlson ASC NULLS LAST,
                 va ASC NULLS LAST, age ASC NULLS LAST) AS rn FROM demo) WHERE rn = 1
),
grid AS (
  SELECT b.id, per.period, f.gender, f.age, f.age_group, f.htn, f.diabetes, f.charlson, f.va, f.clinic
  FROM both_ids b CROSS JOIN (VALUES ({_q(P1.label)}), ({_q(P2.label)})) per(period)
  LEFT JOIN first_demo f ON f.id = b.id AND f.period = per.period
),
ev_counts AS (
  SELECT id, period, count(*) AS hosp_count,
         CAST(count(*) FILTER (WHERE hosp_cause_groups = 'Infección') > 0 AS INTEGER) AS infection_any,
         count(*) FILTER (WHERE hosp_cause_groups = 'Infección') AS infection_count,
         CAST(count(*) FILTER (WHERE hosp_cause_groups = 'Cardiovascular') > 0 AS INTEGER) AS cardio_any,
         count(*) FILTER (WHERE hosp_cause_groups = 'Cardiovascular') AS cardio_count
  FROM analysis WHERE hosp_cause_groups IS NOT NULL GROUP BY id, period
),
paired AS (
  SELECT g.*, CASE WHEN c.hosp_count IS NULL THEN 0 ELSE 1 END AS hosp_any,
         coalesce(c.hosp_count, 0) AS hosp_count, coalesce(c.infection_any, 0) AS infection_any,
         coalesce(c.infection_count, 0) AS infection_count, coalesce(c.cardio_any, 0) AS cardio_any,
         coalesce(c.cardio_count, 0) AS cardio_count
  FROM grid g LEFT JOIN ev_counts c ON g.id = c.id AND g.period = c.period
),
pw AS (
  SELECT id, gender, htn, diabetes,
    {", ".join(f"max({m}) FILTER (WHERE period = {_q(p.label)}) AS {m}_{p.label}"
               for m in ("charlson", "age_group", "hosp_any", "hosp_count", "infection_any",
                         "infection_count", "cardio_any", "cardio_count") for p in FIXTURE_PERIODS)}
  FROM paired GROUP BY id, gender, htn, diabetes
),
unpaired AS (
  SELECT o.id, o.period, f.gender, f.htn, f.diabetes, f.charlson, f.age_group,
         CASE WHEN e.hosp_count IS NULL THEN 0 ELSE 1 END AS was_hospitalized,
         coalesce(e.hosp_count, 0) AS hosp_count, coalesce(e.any_infection, 0) AS any_infection,
         coalesce(e.infection_count, 0) AS infection_count,
         o.id IN (SELECT id FROM both_ids) AS in_both_periods
  FROM (SELECT DISTINCT id, period FROM analysis) o
  LEFT JOIN first_demo f ON f.id = o.id AND f.period = o.period
  LEFT JOIN (SELECT id, period, count(*) AS hosp_count,
                    CAST(count(*) FILTER (WHERE hosp_cause_groups = 'Infección') > 0 AS INTEGER) AS any_infection,
                    count(*) FILTER (WHERE hosp_cause_groups = 'Infección') AS infection_count
             FROM analysis WHERE adm_number IS NOT NULL GROUP BY id, period) e
    ON e.id = o.id AND e.period = o.period
)
"""


def _wide_sql() -> str:
    slots = ",\n    ".join(
        f"max(CASE WHEN a.adm_number = {k} THEN a.{m} END) AS {m}_{k}"
        for k in range(1, 10) for m in ("hosp_start", "hosp_end", "hosp_re", "hosp_cause"))
    lead = ", ".join(f"CASE WHEN coalesce(p.file_row, 0) = 0 THEN s.{c}_p{i} END AS {c}_p{i}" for i in (1, 2)
                     for c in ("status_date", "clinic", "status", "substatus", "charlson", "karnofsky", "va"))
    return f"""
SELECT s.id, {lead}, s.birth_date, s.gender, s.diabetes_type, s.diabetes_date,
       s.htn, s.death_date, s.death_cause, p.* EXCLUDE (id, file_row), s.diabetes
FROM subj s LEFT JOIN (SELECT a.id, a.file_row, {slots} FROM adm a GROUP BY a.id, a.file_row) p ON p.id = s.id"""


def _wide_text_sql() -> str:
    def dmy(x):
        return f"strftime({x}, '%-d/%-m/%Y')"
    slots = ",\n    ".join(
        f"max(CASE WHEN a.adm_number = {k} THEN {expr} END) AS {m}_{k}"
        for k in range(1, 10) for m, expr in (
            ("hosp_start", dmy("a.hosp_start")),
            ("hosp_end", "strftime(a.hosp_end, '%d-%m-%Y')"),
            ("hosp_re", "CASE a.hosp_re WHEN 'Si' THEN 'Yes' WHEN 'No' THEN 'No' END"),
            ("hosp_cause", "a.hosp_cause")))

    def dc(x):
        return (f"CASE WHEN s.k % 2 = 1 THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) || ',0' "
                f"ELSE CAST(CAST({x} AS BIGINT) AS VARCHAR) END")
    cells = {"status_date_p1": dmy("s.status_date_p1"), "status_date_p2": dmy("s.status_date_p2"),
             "clinic_p1": "CASE WHEN s.k % 7 = 0 THEN 'NA' ELSE s.clinic_p1 END", "clinic_p2": "s.clinic_p2",
             **{f"{c}_p{i}": f"s.{c}_p{i}" for c in ("status", "substatus", "va") for i in (1, 2)},
             **{f"charlson_p{i}": dc(f"s.charlson_p{i}") for i in (1, 2)},
             **{f"karnofsky_p{i}": f"CAST(CAST(s.karnofsky_p{i} AS BIGINT) AS VARCHAR)" for i in (1, 2)}}
    lead = ", ".join(f"CASE WHEN coalesce(p.file_row, 0) = 0 THEN {e} END AS {c}" for c, e in cells.items())
    return f"""
SELECT s.id, {lead},
       {dmy('s.birth_date')} AS birth_date,
       CASE s.gender WHEN 'Mujer' THEN 'F' WHEN 'Hombre' THEN 'M' END AS gender,
       s.diabetes_type, {dmy('s.diabetes_date')} AS diabetes_date,
       CASE s.htn WHEN 'Si' THEN 'Y' WHEN 'No' THEN 'N' END AS htn,
       {dmy('s.death_date')} AS death_date, s.death_cause, p.* EXCLUDE (id, file_row)
FROM subj s LEFT JOIN (SELECT a.id, a.file_row, {slots} FROM adm a GROUP BY a.id, a.file_row) p ON p.id = s.id"""


def _with(body: str) -> str:
    return "WITH " + BASE.strip() + "\n" + body


def register(name: str, body: str, doubles: tuple[str, ...] = ()) -> None:
    """Wrap a final SELECT with the shared CTEs and 6-place rounding."""
    if doubles:
        rep = ", ".join(f'round("{c}", 6) AS "{c}"' for c in doubles)
        body = f"SELECT * REPLACE ({rep}) FROM ({body})"
    else:
        body = f"SELECT * FROM ({body})"
    ORACLES[name] = _with(body)


register("cohort_wide", _wide_text_sql())
register("wide_ingest", _wide_sql(), ("charlson_p1", "charlson_p2", "karnofsky_p1", "karnofsky_p2"))
ORACLES["csv_ingest"] = ORACLES["wide_ingest"]
register("csv_records", """
SELECT doc_id, sha256(text) AS text_sha256, length(text) AS n_text, lang, source, n_chars, FALSE AS corrupt
FROM documents""")
register("csv_rejects", """
SELECT priority, count(*) AS records, count(*) FILTER (WHERE bad) AS rejects, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
FROM (SELECT o_orderkey, o_orderkey % 101 = 0 OR o_orderkey % 103 = 0 AS bad,
             CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 103 = 0 THEN o_orderpriority
                  WHEN o_orderkey % 7 = 0 THEN o_orderpriority || chr(10) || '"urgent"' ELSE o_orderpriority END AS priority
      FROM orders) GROUP BY priority""")
register("period_long", "SELECT * FROM pl", ("charlson", "karnofsky"))
register("demographics", "SELECT * FROM demo", ("charlson", "karnofsky", "age"))
register("age_at_anchor", f"""
SELECT id, period, birth_date,
       CASE period WHEN {_q(P1.label)} THEN {_d(P1.start)} WHEN {_q(P2.label)} THEN {_d(P2.start)} END AS anchor_date,
       age FROM demo""", ("age",))
register("age_band", "SELECT id, period, age, age_group FROM demo", ("age",))
register("admission_long",
         "SELECT id, gender, htn, diabetes, adm_number, hosp_start, hosp_end, hosp_re, hosp_cause FROM adm_full")
register("period_classify",
         "SELECT id, gender, htn, diabetes, adm_number, hosp_start, hosp_end, hosp_re, hosp_cause, period FROM adm_full")
register("recode_vocabulary", """
SELECT a.id, a.gender, a.htn, a.diabetes, a.adm_number, a.hosp_start, a.hosp_end, a.hosp_re, a.hosp_cause,
       v.label AS hosp_cause_label, v.group4 AS hosp_cause_group4, v.group6 AS hosp_cause_group6
FROM adm_full a LEFT JOIN vocab v ON a.hosp_cause = v.code""")
_ORDER4 = "['Cardiovascular', 'Infección', 'Acceso Vascular (excl. infección)', 'Otras Causas']"
_ORDER6 = ("['Cardiovascular', 'Infección', 'Acceso Vascular (excl. infección)', 'Urológicas', 'Otras Causas', "
           "'Desconocido']")
register("recode_taxonomy", f"""
SELECT a.id, a.adm_number, a.hosp_start, a.hosp_cause, t.taxonomy,
       CASE t.taxonomy WHEN 'four' THEN v.label ELSE v.label6 END AS label,
       CASE t.taxonomy WHEN 'four' THEN v.group4 ELSE v.group6 END AS cause_group,
       CAST(CASE t.taxonomy WHEN 'four' THEN list_position({_ORDER4}, v.group4)
            ELSE list_position({_ORDER6}, v.group6) END AS INTEGER) AS group_order
FROM adm_full a CROSS JOIN (VALUES ('four'), ('six')) t(taxonomy) LEFT JOIN vocab v ON a.hosp_cause = v.code""")
register("length_of_stay", """
SELECT id, adm_number, hosp_start, hosp_end, CAST(hosp_end - hosp_start AS INTEGER) AS person_time,
       CASE WHEN hosp_end - hosp_start <= 0 THEN ln(0.1)
            WHEN hosp_end - hosp_start > 0 THEN ln(hosp_end - hosp_start) END AS log_person_time
FROM adm_full""", ("log_person_time",))
register("cause_ratio", f"""
SELECT g.period AS "Period", g.cause AS "Cause", coalesce(c.n, 0) AS "Hospitalizations",
       coalesce(CAST(c.n AS DOUBLE) / u.n, 0.0) AS "Ratio",
       coalesce(printf('%.1f%%', round(100.0 * c.n / u.n, 1)), '0.0%') AS "Ratio (%)"
FROM (SELECT * FROM (VALUES ({_q(P1.label)}), ({_q(P2.label)})) p(period),
                    unnest({_list(GROUP6_LEVELS)}) AS t(cause)) g
LEFT JOIN (
  SELECT pr.period, v.group6 AS cause, count(*) AS n
  FROM (SELECT DISTINCT id, period FROM pl) pr
  LEFT JOIN adm_full a ON a.id = pr.id AND a.period = pr.period
  LEFT JOIN vocab v ON a.hosp_cause = v.code
  GROUP BY ALL) c ON c.period = g.period AND c.cause = g.cause
LEFT JOIN (SELECT period, count(DISTINCT id) AS n FROM pl GROUP BY period) u ON u.period = g.period
""", ("Ratio",))
register("cause_period_summary", """
SELECT a.period, v.group6 AS hosp_cause_groups, count(*) AS hosp_count,
       CASE WHEN bool_and(a.hosp_end IS NOT NULL) THEN CAST(sum(a.hosp_end - a.hosp_start) AS BIGINT) END AS hosp_length,
       CASE WHEN bool_and(a.hosp_re IS NOT NULL) THEN count(*) FILTER (WHERE a.hosp_re = 'Si') END AS hosp_readmission
FROM adm_full a LEFT JOIN vocab v ON a.hosp_cause = v.code
WHERE a.period IS NOT NULL AND a.hosp_start IS NOT NULL
GROUP BY ALL""")
register("subject_periods", "SELECT * FROM presence", ("age", "charlson"))
register("first_row_per_key", "SELECT * FROM first_demo", ("charlson", "karnofsky", "age"))
register("admissions_by_presence", "SELECT * FROM analysis",
         ("log_person_time", "age", "charlson"))
register("both_period_subjects", "SELECT id FROM both_ids")
register("subject_period_grid", "SELECT * FROM grid", ("age", "charlson"))
register("paired_event_counts", "SELECT * FROM paired", ("age", "charlson"))
register("period_wide", "SELECT * FROM pw", tuple(f"charlson_{p.label}" for p in FIXTURE_PERIODS))
register("unpaired_event_flags", "SELECT * FROM unpaired", ("charlson",))
register("ungrouped_admissions", """
SELECT period, CAST(sum(n) AS BIGINT) AS admissions, CAST(sum(dropped) AS BIGINT) AS dropped_admissions,
       count(*) FILTER (WHERE n = dropped) AS emptied_subject_periods
FROM (SELECT id, period, count(*) AS n, count(*) FILTER (WHERE hosp_cause_groups IS NULL) AS dropped
      FROM analysis WHERE adm_number IS NOT NULL GROUP BY id, period) GROUP BY period""")
register("paired_event_counts_any_cause", """
SELECT g.*, CASE WHEN c.hosp_count IS NULL THEN 0 ELSE 1 END AS hosp_any, coalesce(c.hosp_count, 0) AS hosp_count,
       coalesce(CAST(c.infection_count > 0 AS INTEGER), 0) AS infection_any, coalesce(c.infection_count, 0) AS infection_count,
       coalesce(CAST(c.cardio_count > 0 AS INTEGER), 0) AS cardio_any, coalesce(c.cardio_count, 0) AS cardio_count
FROM grid g LEFT JOIN (
  SELECT id, period, count(*) AS hosp_count, count(*) FILTER (WHERE hosp_cause_groups = 'Infección') AS infection_count,
         count(*) FILTER (WHERE hosp_cause_groups = 'Cardiovascular') AS cardio_count
  FROM analysis WHERE adm_number IS NOT NULL GROUP BY id, period) c ON g.id = c.id AND g.period = c.period""",
         ("age", "charlson"))
register("unpaired_event_flags_strict", """
SELECT u.* REPLACE (CASE WHEN e.lacks THEN 0 ELSE u.any_infection END AS any_infection,
                    CASE WHEN e.lacks THEN 0 ELSE u.infection_count END AS infection_count)
FROM unpaired u LEFT JOIN (SELECT id, period, bool_or(hosp_cause_groups IS NULL) AS lacks FROM analysis
                           WHERE adm_number IS NOT NULL GROUP BY id, period) e
  ON e.id = u.id AND e.period = u.period""", ("charlson",))
register("exposure_days", f"""
SELECT id, period,
       CASE period WHEN {_q(P1.label)} THEN {float(P1.days)} WHEN {_q(P2.label)} THEN {float(P2.days)} END AS exposure_time,
       ln(CASE period WHEN {_q(P1.label)} THEN {float(P1.days)} WHEN {_q(P2.label)} THEN {float(P2.days)} END) AS log_exposure
FROM unpaired""", ("exposure_time", "log_exposure"))


# ------------------------------------------------------------ p-value tails
# Series evaluated by DuckDB itself (lgamma is built in; erf / incomplete
# gamma / beta are not): regularised lower gamma P(a, x) as a sum over n, the
# incomplete beta by its power series on the side of 1/2 where it converges.

def chi2_sf_sql(stat: str, df: str, terms: int = 4000) -> str:
    a, x = f"(({df}) / 2.0)", f"(({stat}) / 2.0)"
    p = (f"(SELECT sum(exp(-{x} + ({a} + n) * ln({x}) - lgamma({a} + n + 1))) "
         f"FROM range(0, {terms}) r(n))")
    return (f"(CASE WHEN ({stat}) IS NULL OR ({df}) IS NULL THEN NULL WHEN ({stat}) <= 0 THEN 1.0 "
            f"WHEN {x} > {a} + 1500 THEN 0.0 ELSE greatest(0.0, 1.0 - {p}) END)")


def _beta_series(a: str, b: str, x: str, terms: int) -> str:
    lead = f"({a} * ln({x}) + {b} * ln(1 - {x}) - ln({a}) - (lgamma({a}) + lgamma({b}) - lgamma({a} + {b})))"
    return (f"(SELECT sum(exp({lead} + lgamma({a} + {b} + n) - lgamma({a} + {b}) - lgamma({a} + 1 + n) "
            f"+ lgamma({a} + 1) + n * ln({x}))) FROM range(0, {terms}) r(n))")


def t_two_sided_sql(t: str, df: str, terms: int = 4000) -> str:
    z = f"(({df}) / (({df}) + ({t}) * ({t})))"
    direct = _beta_series(f"(({df}) / 2.0)", "0.5", z, terms)
    flipped = _beta_series("0.5", f"(({df}) / 2.0)", f"(1 - {z})", terms)
    return (f"(CASE WHEN ({t}) IS NULL OR ({df}) IS NULL THEN NULL WHEN ({t}) = 0 THEN 1.0 "
            f"WHEN {z} < 0.5 THEN {direct} ELSE 1.0 - {flipped} END)")


def norm_two_sided_sql(z: str) -> str:
    return chi2_sf_sql(f"(({z}) * ({z}))", "1")


# ------------------------------------------------------------------- tests

def _pairs_union(fmt: str, measures=("hosp", "infection", "cardio")) -> str:
    return " UNION ALL ".join(fmt.format(m=m, pre=P1.label, post=P2.label) for m in measures)


DIFFS = _pairs_union("SELECT '{m}' AS measure, CAST({m}_count_{post} AS DOUBLE) AS post, "
                     "CAST({m}_count_{pre} AS DOUBLE) AS pre FROM pw")
ANYS = _pairs_union("SELECT '{m}' AS measure, {m}_any_{pre} AS r, {m}_any_{post} AS c FROM pw")

register("paired_diff_t", f"""
SELECT *, {t_two_sided_sql('statistic', 'df')} AS p_value FROM (
  SELECT measure, count(post - pre) AS n_pairs, avg(post - pre) AS mean_diff,
         stddev_samp(post - pre) AS sd_diff,
         CASE WHEN stddev_samp(post - pre) > 0
              THEN avg(post - pre) / (stddev_samp(post - pre) / sqrt(count(post - pre))) END AS statistic,
         CAST(count(post - pre) - 1 AS DOUBLE) AS df
  FROM ({DIFFS}) GROUP BY measure)""", ("mean_diff", "sd_diff", "statistic", "df", "p_value"))


def _contingency_sql(src: str, measures: list[str]) -> str:
    ms = ", ".join(f"('{m}')" for m in measures)
    return f"""
SELECT g.measure, g.row_level, g.col_level, coalesce(o.n, 0) AS n
FROM (SELECT * FROM (VALUES {ms}) m(measure), (VALUES (0), (1)) a(row_level), (VALUES (0), (1)) b(col_level)) g
LEFT JOIN (SELECT measure, CAST(r AS INTEGER) AS row_level, CAST(c AS INTEGER) AS col_level, count(*) AS n
           FROM ({src}) WHERE r IN (0, 1) AND c IN (0, 1) GROUP BY ALL) o
  USING (measure, row_level, col_level)"""


def _mcnemar_sql(cont: str) -> str:
    return f"""
SELECT *, {chi2_sf_sql('statistic', 'df')} AS p_value FROM (
  SELECT *, CASE WHEN n_01 + n_10 = 0 THEN NULL WHEN n_01 = n_10 THEN 0.0
                 ELSE power(abs(n_01 - n_10) - 1, 2) / (n_01 + n_10) END AS statistic, 1.0 AS df
  FROM (SELECT measure,
          CAST(sum(n) FILTER (WHERE row_level = 0 AND col_level = 0) AS BIGINT) AS n_00,
          CAST(sum(n) FILTER (WHERE row_level = 0 AND col_level = 1) AS BIGINT) AS n_01,
          CAST(sum(n) FILTER (WHERE row_level = 1 AND col_level = 0) AS BIGINT) AS n_10,
          CAST(sum(n) FILTER (WHERE row_level = 1 AND col_level = 1) AS BIGINT) AS n_11
        FROM ({cont}) GROUP BY measure))"""


register("contingency", _contingency_sql(ANYS, ["hosp", "infection", "cardio"]))
register("mcnemar", _mcnemar_sql(_contingency_sql(ANYS, ["hosp", "infection", "cardio"])),
         ("statistic", "df", "p_value"))
register("mcnemar_labels", _mcnemar_sql(_contingency_sql(
    "SELECT 'quality_vs_toxic' AS measure, quality AS r, toxic AS c FROM labels", ["quality_vs_toxic"])),
    ("statistic", "df", "p_value"))
register("cohen_d_paired", """
SELECT measure, n_pairs, mean_diff, sd_diff, r, d,
       CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small'
            WHEN abs(d) < 0.8 THEN 'medium' WHEN abs(d) >= 0.8 THEN 'large' END AS magnitude,
       d - 1.959963984540054 * sqrt((1.0 / n_pairs + d * d / (2.0 * n_pairs)) * 2 * (1 - r)) AS ci_lower,
       d + 1.959963984540054 * sqrt((1.0 / n_pairs + d * d / (2.0 * n_pairs)) * 2 * (1 - r)) AS ci_upper
FROM (SELECT *, mean_diff / (sd_diff / sqrt(2 * (1 - r))) AS d FROM (
  SELECT measure, count(post - pre) AS n_pairs, avg(post - pre) AS mean_diff,
         stddev_samp(post - pre) AS sd_diff, corr(post, pre) AS r
  FROM (""" + DIFFS + """) WHERE post - pre IS NOT NULL GROUP BY measure))""",
         ("mean_diff", "sd_diff", "r", "d", "ci_lower", "ci_upper"))

register("paired_tests", f"""
SELECT t.measure, t.n_pairs, mm.mean_post, mm.mean_pre, t.mean_diff, t.sd_diff, m.n_00, m.n_01, m.n_10, m.n_11,
       t.statistic AS t, t.df AS t_df, t.p_value AS t_p_value, d.r, d.d, d.magnitude, d.ci_lower, d.ci_upper,
       m.statistic AS mcnemar, m.p_value AS mcnemar_p_value
FROM ({ORACLES["paired_diff_t"]}) t JOIN ({ORACLES["cohen_d_paired"]}) d USING (measure)
JOIN ({ORACLES["mcnemar"]}) m USING (measure)
JOIN (SELECT measure, avg(post) AS mean_post, avg(pre) AS mean_pre FROM ({DIFFS}) WHERE post - pre IS NOT NULL
      GROUP BY measure) mm USING (measure)""", ("mean_post", "mean_pre"))

DEMO_LONG = " UNION ALL ".join(
    f"SELECT period, '{v}' AS variable, CAST({v} AS VARCHAR) AS level FROM demo"
    for v in ["age_group", "diabetes_type", "karnofsky", "va", "gender", "htn", "diabetes"])


def _chi_sql(cells: str, key: str) -> str:
    return f"""
WITH cells AS ({cells}),
r AS (SELECT {key}, row_level, sum(n) AS rt FROM cells GROUP BY ALL),
c AS (SELECT {key}, col_level, sum(n) AS ct FROM cells GROUP BY ALL),
t AS (SELECT {key}, sum(n) AS nt FROM cells GROUP BY ALL),
f AS (SELECT r.{key}, r.row_level, c.col_level, r.rt, c.ct, t.nt, coalesce(cells.n, 0) AS o,
             r.rt * c.ct / t.nt AS e
      FROM r JOIN c USING ({key}) JOIN t USING ({key}) LEFT JOIN cells USING ({key}, row_level, col_level))
SELECT *, {chi2_sf_sql('statistic', 'df')} AS p_value FROM (
  SELECT {key}, CAST(any_value(nt) AS BIGINT) AS n_total, count(DISTINCT row_level) AS n_rows,
         count(DISTINCT col_level) AS n_cols, min(e) AS min_expected,
         CASE WHEN (count(DISTINCT row_level) - 1) * (count(DISTINCT col_level) - 1) > 0
              THEN sum((o - e) * (o - e) / e) END AS statistic,
         CASE WHEN (count(DISTINCT row_level) - 1) * (count(DISTINCT col_level) - 1) > 0
              THEN CAST((count(DISTINCT row_level) - 1) * (count(DISTINCT col_level) - 1) AS DOUBLE) END AS df
  FROM f GROUP BY {key})"""


register("chi_square", _chi_sql(
    f"SELECT variable, level AS row_level, period AS col_level, count(*) AS n FROM ({DEMO_LONG}) "
    "WHERE level IS NOT NULL AND period IS NOT NULL GROUP BY ALL", "variable"),
    ("min_expected", "statistic", "df", "p_value"))
register("chi_square_labels", _chi_sql(
    "SELECT 'quality_x_toxic' AS \"table\", CAST(quality AS VARCHAR) AS row_level, "
    "CAST(toxic AS VARCHAR) AS col_level, count(*) AS n FROM labels "
    "WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL", '"table"'),
    ("min_expected", "statistic", "df", "p_value"))


def _fisher_sql(cells: str) -> str:
    lp = ("(lgamma(r1 + 1) + lgamma(r2 + 1) + lgamma(c1 + 1) + lgamma(c2 + 1) - lgamma(nn + 1) "
          "- lgamma(x + 1) - lgamma(r1 - x + 1) - lgamma(c1 - x + 1) - lgamma(nn - r1 - c1 + x + 1))")
    return f"""
WITH cells AS ({cells}),
lv AS (SELECT variable, min(row_level) AS r0, min(col_level) AS c0,
              count(DISTINCT row_level) AS nr, count(DISTINCT col_level) AS nc FROM cells GROUP BY ALL),
tab AS (SELECT variable,
          CAST(sum(n) FILTER (WHERE row_level = r0 AND col_level = c0) AS BIGINT) AS a,
          CAST(sum(n) FILTER (WHERE row_level = r0 AND col_level <> c0) AS BIGINT) AS b,
          CAST(sum(n) FILTER (WHERE row_level <> r0 AND col_level = c0) AS BIGINT) AS c,
          CAST(sum(n) FILTER (WHERE row_level <> r0 AND col_level <> c0) AS BIGINT) AS d
        FROM cells JOIN lv USING (variable) WHERE nr = 2 AND nc = 2 GROUP BY variable),
t2 AS (SELECT variable, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c, coalesce(d, 0) AS d FROM tab),
sup AS (SELECT variable, a, b, c, d, a + b AS r1, c + d AS r2, a + c AS c1, b + d AS c2, a + b + c + d AS nn FROM t2),
pmf AS (SELECT s.*, x, exp({lp}) AS px FROM sup s,
        LATERAL (SELECT unnest(range(greatest(0, r1 + c1 - nn), least(r1, c1) + 1)) AS x))
SELECT variable, a, b, c, d,
       least(1.0, sum(px) FILTER (WHERE px <= (SELECT px FROM pmf p2 WHERE p2.variable = pmf.variable AND p2.x = pmf.a) * (1 + 1e-7))
             / sum(px)) AS p_value
FROM pmf GROUP BY variable, a, b, c, d"""


FISHER_LONG = (" UNION ALL ".join(
    f"SELECT '{v}' AS variable, CAST({v} AS VARCHAR) AS level, period FROM demo"
    for v in ["gender", "htn", "diabetes", "diabetes_type"])
    + " UNION ALL SELECT 'quality_x_toxic', CAST(quality AS VARCHAR), CAST(toxic AS VARCHAR) FROM labels")
register("fisher_2x2", _fisher_sql(
    f"SELECT variable, level AS row_level, period AS col_level, count(*) AS n FROM ({FISHER_LONG}) "
    "WHERE level IS NOT NULL AND period IS NOT NULL GROUP BY ALL"), ("p_value",))


def _rank_sql(src: str, key: str, first: str | None) -> str:
    """Midranks by window functions; W / H from rank sums."""
    r1 = (f"sum(R) FILTER (WHERE grp = {_q(first)})" if first else "arg_min(R, grp)")
    n1 = (f"sum(ng) FILTER (WHERE grp = {_q(first)})" if first else "arg_min(ng, grp)")
    return f"""
WITH s AS (SELECT {key} AS key, value, grp FROM ({src}) WHERE value IS NOT NULL AND grp IS NOT NULL),
rk AS (SELECT key, value, grp,
              rank() OVER (PARTITION BY key ORDER BY value) - 1
              + (count(*) OVER (PARTITION BY key, value) + 1) / 2.0 AS mr FROM s),
ties AS (SELECT key, sum(t * t * t - t) AS ties FROM (SELECT key, value, count(*) AS t FROM s GROUP BY ALL) GROUP BY key),
g AS (SELECT key, grp, sum(mr) AS R, count(*) AS ng FROM rk GROUP BY ALL),
a AS (SELECT key, count(*) AS k, sum(ng) AS n_total, {r1} AS R1, {n1} AS n1,
             sum(R * R / ng) AS r2n FROM g GROUP BY key)
SELECT a.*, ties.ties FROM a JOIN ties USING (key)"""


def _rank_sum_sql(src, key, first):
    w = "(R1 - n1 * (n1 + 1) / 2.0)"
    mu = "(n1 * (n_total - n1) / 2.0)"
    sig = "sqrt(n1 * (n_total - n1) / 12.0 * ((n_total + 1) - ties / (n_total * (n_total - 1.0))))"
    return f"""
SELECT *, {norm_two_sided_sql('z')} AS p_value FROM (
  SELECT key AS {key}, CAST(n_total AS BIGINT) AS n_total, CAST(n1 AS BIGINT) AS n1,
         CASE WHEN k = 2 THEN {w} END AS statistic,
         CASE WHEN k = 2 AND {sig} > 0 THEN ({w} - {mu} - 0.5 * sign({w} - {mu})) / {sig} END AS z
  FROM ({_rank_sql(src, key, first)}))"""


register("rank_sum", _rank_sum_sql(
    "SELECT 'age' AS variable, age AS value, period AS grp FROM demo "
    "UNION ALL SELECT 'charlson', charlson, period FROM demo", "variable", P1.label),
    ("statistic", "z", "p_value"))
register("kruskal_wallis", f"""
SELECT *, {chi2_sf_sql('statistic', 'df')} AS p_value FROM (
  SELECT CAST(n_total AS BIGINT) AS n_total, k,
         CASE WHEN k > 1 THEN (12.0 / (n_total * (n_total + 1.0)) * r2n - 3 * (n_total + 1))
                              / (1 - ties / (n_total * n_total * n_total - n_total)) END AS statistic,
         CASE WHEN k > 1 THEN CAST(k - 1 AS DOUBLE) END AS df
  FROM ({_rank_sql("SELECT 'all' AS variable, value, event_type AS grp FROM events", "variable", None)}))""",
    ("statistic", "df", "p_value"))


# ---------------------------------------------------------------- summaries

def _long(src: str, by: str, variables: list[str], cast: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {by} AS grp, '{v}' AS variable, CAST({v} AS {cast}) AS value FROM {src}" for v in variables)


def _continuous_sql(long: str, strata: str = "") -> str:
    s = f"{strata}, " if strata else ""
    return f"""
SELECT {s}variable, grp, count(value) AS n, count(*) FILTER (WHERE value IS NULL) AS n_missing,
       avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, 0.25) AS p25,
       quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS p75
FROM ({long}) WHERE grp IS NOT NULL GROUP BY ALL"""


def _categorical_sql(long: str, dich: dict | None = None, strata: str = "", declared: dict | None = None) -> str:
    pairs = ", ".join(f"({_q(v)}, {_q(x)})" for v, xs in (declared or {}).items() for x in xs)
    more = (f" UNION SELECT DISTINCT {strata + ', ' if strata else ''}variable, dl.level FROM den "
            f"JOIN (VALUES {pairs}) dl(variable, level) USING (variable)") if pairs else ""
    s = f"{strata}, " if strata else ""
    j = f" AND lv.{strata} IS NOT DISTINCT FROM den.{strata}" if strata else ""
    jc = f" AND cnt.{strata} IS NOT DISTINCT FROM den.{strata}" if strata else ""
    filt = ""
    if dich:
        conds = " OR ".join(f"(lv.variable = {_q(k)} AND lv.level = {_q(v)})" for k, v in dich.items())
        others = ", ".join(_q(k) for k in dich)
        filt = f"WHERE lv.variable NOT IN ({others}) OR {conds}"
    sel_s = f"den.{strata}, " if strata else ""
    return f"""
SELECT * FROM (
WITH l AS (SELECT * FROM ({long}) WHERE grp IS NOT NULL AND value IS NOT NULL),
cnt AS (SELECT {s}variable, value AS level, grp, count(*) AS n FROM l GROUP BY ALL),
den AS (SELECT {s}variable, grp, count(*) AS denom FROM l GROUP BY ALL),
lv AS (SELECT DISTINCT {s}variable, value AS level FROM l{more})
SELECT {sel_s}lv.variable, lv.level, den.grp, coalesce(cnt.n, 0) AS n, den.denom,
       coalesce(cnt.n, 0) / den.denom AS pct
FROM lv JOIN den ON lv.variable = den.variable{j}
LEFT JOIN cnt ON cnt.variable = lv.variable AND cnt.level = lv.level AND cnt.grp = den.grp{jc}
{filt})"""


DEMO_VARS = ["age", "age_group", "gender", "htn", "diabetes", "diabetes_type", "charlson", "karnofsky", "va"]
NUMERIC_DEMO = ["age", "charlson", "karnofsky"]

register("summary_continuous", _continuous_sql(_long("demo", "period", ["age", "charlson"], "DOUBLE")),
         ("mean", "sd", "p25", "median", "p75"))
register("summary_documents", _continuous_sql(_long("documents", "lang", ["n_chars"], "DOUBLE")),
         ("mean", "sd", "p25", "median", "p75"))
register("summary_categorical", _categorical_sql(
    _long("demo", "period", ["age_group", "diabetes_type", "karnofsky", "va"], "VARCHAR")), ("pct",))
register("summary_dichotomous", _categorical_sql(
    _long("demo", "period", ["gender", "htn", "diabetes"], "VARCHAR"),
    {"gender": "Mujer", "htn": "Si", "diabetes": "Si"}), ("pct",))
register("summary_missing", f"""
SELECT variable, grp, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS n_missing
FROM ({_long("demo", "period", DEMO_VARS, "VARCHAR")}) WHERE grp IS NOT NULL GROUP BY ALL""")
KIND_SQL = f"""
SELECT variable, count(DISTINCT value) AS n_distinct, count(*) FILTER (WHERE value IS NULL) AS n_missing,
       variable IN ({", ".join(_q(v) for v in NUMERIC_DEMO)}) AS is_numeric,
       CASE WHEN variable IN ({", ".join(_q(v) for v in NUMERIC_DEMO)}) AND count(DISTINCT value) >= 10
            THEN 'continuous' ELSE 'categorical' END AS kind
FROM ({_long("demo", "period", DEMO_VARS, "VARCHAR")}) GROUP BY variable"""
register("summary_kind_profile", KIND_SQL)

_STRAT_LONG_C = " UNION ALL ".join(
    f"SELECT period, hosp_cause_groups AS grp, '{v}' AS variable, CAST({v} AS DOUBLE) AS value FROM analysis"
    for v in ["charlson"])
_STRAT_LONG_K = " UNION ALL ".join(
    f"SELECT period, hosp_cause_groups AS grp, '{v}' AS variable, CAST({v} AS VARCHAR) AS value FROM analysis"
    for v in ["age_group", "gender", "htn", "diabetes"])
register("stratified_summary", f"""
SELECT period, variable, 'continuous' AS kind, CAST(NULL AS VARCHAR) AS level, grp, n,
       CAST(NULL AS BIGINT) AS denom, CAST(NULL AS DOUBLE) AS pct, mean, sd, p25, median, p75
FROM ({_continuous_sql(_STRAT_LONG_C, "period")})
UNION ALL
SELECT period, variable, CASE WHEN variable IN ('htn', 'diabetes') THEN 'dichotomous' ELSE 'categorical' END,
       level, grp, n, denom, pct, NULL, NULL, NULL, NULL, NULL
FROM ({_categorical_sql(_STRAT_LONG_K, {"htn": "Si", "diabetes": "Si"}, "period")})""",
         ("pct", "mean", "sd", "p25", "median", "p75"))

_TEST_RANK = _rank_sql(" UNION ALL ".join(
    f"SELECT '{v}' AS variable, CAST({v} AS DOUBLE) AS value, period AS grp FROM demo" for v in NUMERIC_DEMO),
    "variable", P1.label)
_TEST_CELLS = (f"SELECT variable, value AS row_level, grp AS col_level, count(*) AS n "
               f"FROM ({_long('demo', 'period', DEMO_VARS, 'VARCHAR')}) "
               f"WHERE value IS NOT NULL AND grp IS NOT NULL GROUP BY ALL")
register("summary_with_tests", f"""
WITH prof AS ({KIND_SQL}),
rk AS ({_TEST_RANK}),
w AS (SELECT key AS variable, k, (R1 - n1 * (n1 + 1) / 2.0) AS W,
             ((R1 - n1 * (n1 + 1) / 2.0) - n1 * (n_total - n1) / 2.0
              - 0.5 * sign((R1 - n1 * (n1 + 1) / 2.0) - n1 * (n_total - n1) / 2.0))
             / sqrt(n1 * (n_total - n1) / 12.0 * ((n_total + 1) - ties / (n_total * (n_total - 1.0)))) AS z,
             (12.0 / (n_total * (n_total + 1.0)) * r2n - 3 * (n_total + 1))
             / (1 - ties / (n_total * n_total * n_total - n_total)) AS H
      FROM rk),
chi AS ({_chi_sql(_TEST_CELLS, "variable")}),
fis AS ({_fisher_sql(_TEST_CELLS)})
SELECT w.variable, 'continuous' AS kind,
       CASE WHEN k = 2 THEN 'wilcox.test' WHEN k > 2 THEN 'kruskal.test' END AS test,
       CASE WHEN k = 2 THEN W WHEN k > 2 THEN H END AS statistic,
       CASE WHEN k > 2 THEN CAST(k - 1 AS DOUBLE) END AS df,
       CASE WHEN k = 2 THEN {norm_two_sided_sql('z')} WHEN k > 2 THEN {chi2_sf_sql('H', 'k - 1')} END AS p_value
FROM w JOIN prof USING (variable) WHERE prof.kind = 'continuous'
UNION ALL
SELECT chi.variable, 'categorical',
       CASE WHEN min_expected >= 5 THEN 'chisq.test.no.correct'
            WHEN n_rows = 2 AND n_cols = 2 THEN 'fisher.test' ELSE 'fisher.test (simulated)' END,
       CASE WHEN min_expected >= 5 THEN statistic END,
       CASE WHEN min_expected >= 5 THEN df END,
       CASE WHEN min_expected >= 5 THEN chi.p_value WHEN n_rows = 2 AND n_cols = 2 THEN fis.p_value END
FROM chi JOIN prof USING (variable) LEFT JOIN fis USING (variable) WHERE prof.kind = 'categorical'
""", ("statistic", "df", "p_value"))

def _tests_sql(text: str, number: str, numeric: list[str], simulate: list[str], first: str | None) -> str:
    """Tests per ``variable`` (stratum|name); simulated p values are NULL."""
    name = "string_split(variable, '|')[-1]"
    nums = ", ".join(map(_q, numeric))
    sim = f"{name} IN ({', '.join(map(_q, simulate))})"
    cells = (f"SELECT variable, value AS row_level, grp AS col_level, count(*) AS n FROM ({text}) "
             "WHERE value IS NOT NULL AND grp IS NOT NULL GROUP BY ALL")
    w = "(R1 - n1 * (n1 + 1) / 2.0)"
    mu = "(n1 * (n_total - n1) / 2.0)"
    sigma = "sqrt(n1 * (n_total - n1) / 12.0 * ((n_total + 1) - ties / (n_total * (n_total - 1.0))))"
    return f"""
SELECT * FROM (
WITH kinds AS (SELECT name, name IN ({nums}) AND n_values >= 10 AS many
               FROM (SELECT {name} AS name, count(DISTINCT value) AS n_values
                     FROM ({text}) WHERE grp IS NOT NULL GROUP BY 1)),
rk AS ({_rank_sql(number, "variable", first)}),
w AS (SELECT key AS variable, k, {w} AS W, ({w} - {mu} - 0.5 * sign({w} - {mu})) / {sigma} AS z,
             (12.0 / (n_total * (n_total + 1.0)) * r2n - 3 * (n_total + 1))
             / (1 - ties / (1.0 * n_total * n_total * n_total - n_total)) AS H FROM rk),
chi AS ({_chi_sql(cells, "variable")}),
fis AS ({_fisher_sql(cells)}),
logs AS (SELECT variable, -sum(lgamma(n + 1)) AS fisher FROM ({cells}) GROUP BY variable)
SELECT variable, CASE WHEN k = 2 THEN 'wilcox.test' WHEN k > 2 THEN 'kruskal.test' END AS test,
       CASE WHEN k = 2 THEN W WHEN k > 2 THEN H END AS statistic,
       CASE WHEN k > 2 THEN CAST(k - 1 AS DOUBLE) END AS df,
       CASE WHEN k = 2 THEN {norm_two_sided_sql('z')} WHEN k > 2 THEN {chi2_sf_sql('H', 'k - 1')} END AS p_value
FROM w JOIN kinds ON name = {name} WHERE many
UNION ALL
SELECT chi.variable, CASE WHEN {sim.replace('variable', 'chi.variable')} AND min_expected >= 5 THEN 'chisq.test (simulated)'
         WHEN {sim.replace('variable', 'chi.variable')} THEN 'fisher.test (simulated)'
         WHEN min_expected >= 5 THEN 'chisq.test.no.correct'
         WHEN n_rows = 2 AND n_cols = 2 THEN 'fisher.test' ELSE 'fisher.test (simulated)' END,
       CASE WHEN min_expected >= 5 THEN statistic
            WHEN n_rows <> 2 OR n_cols <> 2 OR {sim.replace('variable', 'chi.variable')} THEN logs.fisher END,
       CASE WHEN min_expected >= 5 THEN df END,
       CASE WHEN {sim.replace('variable', 'chi.variable')} THEN NULL WHEN min_expected >= 5 THEN chi.p_value
            WHEN n_rows = 2 AND n_cols = 2 THEN fis.p_value END
FROM chi JOIN kinds ON name = {name.replace('variable', 'chi.variable')} LEFT JOIN fis ON fis.variable = chi.variable
JOIN logs ON logs.variable = chi.variable WHERE NOT many)"""


def _described_sql(src: str, by: str, cont: list[str], cat: list[str], dich: dict, declared: dict, labels: dict,
                   means: dict, numeric: list[str], simulate: list[str], first: str | None = None,
                   strata: str = "") -> str:
    s = f"{strata}, " if strata else ""
    every = [*cont, *cat, *dich]
    declared = {**declared, **{v: [x] for v, x in dich.items()}}

    def long(variables, cast, keyed=False):
        name = (lambda v: f"coalesce({strata}, '?') || '|' || {_q(v)}" if strata and keyed else _q(v))
        head = s if strata and not keyed else ""
        return " UNION ALL ".join(f"SELECT {head}{by} AS grp, {name(v)} AS variable, CAST({v} AS {cast}) AS value "
                                  f"FROM {src}" for v in variables)

    def dec(x):
        return f"CAST(CAST(round({x}, 1) AS DECIMAL(20, 1)) AS VARCHAR)"
    same = f"AND m.{strata} IS NOT DISTINCT FROM b.{strata}" if strata else ""
    key = f"coalesce(b.{strata}, '?') || '|' || b.variable" if strata else "b.variable"
    places = " ".join(f"WHEN b.variable = {_q(v)} THEN nullif(list_position({_list(xs)}, b.level), 0)"
                      for v, xs in declared.items())
    mean_text = " ".join(f"WHEN b.variable = {_q(v)} THEN {dec('b.mean')} || ' (±' || {dec('b.sd')} || ')' || {_q(u)}"
                         for v, u in means.items())
    sel = f"b.{strata}, " if strata else ""
    return f"""
WITH base AS (
  SELECT {s}variable, 'continuous' AS kind, CAST(NULL AS VARCHAR) AS level, grp, n, CAST(NULL AS BIGINT) AS denom,
         CAST(NULL AS DOUBLE) AS pct, mean, sd, p25, median, p75
  FROM ({_continuous_sql(long(cont, 'DOUBLE'), strata)})
  UNION ALL
  SELECT {s}variable, CASE WHEN variable IN ({', '.join(map(_q, dich))}) THEN 'dichotomous' ELSE 'categorical' END,
         level, grp, n, denom, pct, NULL, NULL, NULL, NULL, NULL
  FROM ({_categorical_sql(long([*cat, *dich], 'VARCHAR'), dich, strata, declared)})),
m AS (SELECT {s}variable, grp, count(*) FILTER (WHERE value IS NULL) AS n_missing
      FROM ({long(every, 'VARCHAR')}) WHERE grp IS NOT NULL GROUP BY ALL),
t AS ({_tests_sql(long(every, 'VARCHAR', True), long(numeric, 'DOUBLE', True), numeric, simulate, first)})
SELECT {sel}b.variable, {_case_map('b.variable', labels)} AS label, b.kind, b.level,
       CAST(CASE {places} END AS INTEGER) AS level_no, b.grp, b.n, b.denom, m.n_missing, b.pct, b.mean, b.sd, b.p25,
       b.median, b.p75,
       CASE WHEN b.kind <> 'continuous' THEN b.n || ' (' || {dec('b.n * 100.0 / b.denom')} || '%)' {mean_text}
            ELSE {dec('b.median')} || ' [' || {dec('b.p25')} || ', ' || {dec('b.p75')} || ']' END AS stat_label,
       t.test, t.statistic, t.df, t.p_value
FROM base b JOIN m ON m.variable = b.variable AND m.grp = b.grp {same} LEFT JOIN t ON t.variable = {key}"""


_DESCRIBED = ("pct", "mean", "sd", "p25", "median", "p75", "statistic", "df", "p_value")
_BANDS_DECLARED = list(AGE_BANDS.labels)
register("demographics_table_exact", _described_sql(
    "demo", "period", ["age", "charlson"], ["age_group", "diabetes_type", "karnofsky", "va"],
    {"gender": "Mujer", "htn": "Si", "diabetes": "Si"},
    {"age_group": _BANDS_DECLARED, "diabetes_type": ["Tipo 1", "Tipo 2"],
     "va": ["Fistula AV Nativa", "Fistula Protésica", "Catéter Tunelizado"]},
    {"age": "Edad", "age_group": "Edad (Categórica)", "gender": "Mujeres", "htn": "Hipertensión",
     "diabetes": "Diabetes Mellitus", "diabetes_type": "Tipo de Diabetes", "charlson": "Índice de Charlson",
     "karnofsky": "Karnofsky", "va": "Acceso Vascular"},
    {"age": " años"}, NUMERIC_DEMO, ["karnofsky"], P1.label), _DESCRIBED)
register("overall_table_exact", _described_sql(
    "analysis", "hosp_cause_groups", ["charlson"], ["age_group", "gender"], {"htn": "Si", "diabetes": "Si"},
    {"age_group": _BANDS_DECLARED, "gender": ["Mujer", "Hombre"]},
    {"age_group": "Grupo Etario", "gender": "Género", "htn": "Hipertensión Arterial",
     "diabetes": "Diabetes Mellitus", "charlson": "Índice de Charlson"},
    {}, ["charlson"], ["age_group"], None, "period"), _DESCRIBED)
register("admission_table_exact", _described_sql(
    """(SELECT a.period, v.group6 AS hosp_cause_groups, a.hosp_re, CAST(a.hosp_end - a.hosp_start AS INTEGER) AS hosp_length
        FROM adm_full a LEFT JOIN vocab v ON a.hosp_cause = v.code
        WHERE a.period IS NOT NULL AND a.hosp_start IS NOT NULL)""",
    "hosp_cause_groups", ["hosp_length"], ["period"], {"hosp_re": "Si"}, {"period": [P1.label, P2.label]},
    {"period": "Periodo", "hosp_length": "Días de hospitalización", "hosp_re": "Reingreso"},
    {"hosp_length": ""}, ["hosp_length"], ["period"]), _DESCRIBED)


register("demographics_by_htn_exact", _described_sql(
    "demo", "period", ["age", "charlson"], ["age_group"], {"gender": "Mujer"}, {"age_group": _BANDS_DECLARED},
    {"age": "Edad", "age_group": "Edad (Categórica)", "gender": "Mujeres", "charlson": "Índice de Charlson"},
    {"age": " años"}, ["age", "charlson"], [""], P1.label, "htn"), _DESCRIBED)
_TESTED = ("statistic", "df", "p_value")
register("summary_with_tests_simulated_exact", _tests_sql(
    _long("demo", "period", DEMO_VARS, "VARCHAR"), _long("demo", "period", NUMERIC_DEMO, "DOUBLE"), NUMERIC_DEMO,
    ["karnofsky"], P1.label), _TESTED)
_BY_CAUSE = lambda variables, cast: " UNION ALL ".join(     # noqa: E731
    f"SELECT hosp_cause_groups AS grp, period || '|{v}' AS variable, CAST({v} AS {cast}) AS value FROM analysis"
    for v in variables)
_CAUSE_TESTS = _tests_sql(_BY_CAUSE(["age_group", "gender", "htn", "diabetes", "charlson"], "VARCHAR"),
                          _BY_CAUSE(["charlson"], "DOUBLE"), ["charlson"], ["age_group"], None)
register("stratified_tests_exact", f"""
SELECT string_split(variable, '|')[1] AS period, string_split(variable, '|')[2] AS variable, test, statistic, df, p_value
FROM ({_CAUSE_TESTS})""", _TESTED)
_ADMITTED = """(SELECT a.period, v.group6 AS hosp_cause_groups, a.hosp_re,
                CAST(a.hosp_end - a.hosp_start AS INTEGER) AS hosp_length
                FROM adm_full a LEFT JOIN vocab v ON a.hosp_cause = v.code
                WHERE a.period IS NOT NULL AND a.hosp_start IS NOT NULL)"""
register("admission_tests_exact", _tests_sql(
    _long(_ADMITTED, "hosp_cause_groups", ["period", "hosp_length", "hosp_re"], "VARCHAR"),
    _long(_ADMITTED, "hosp_cause_groups", ["hosp_length"], "DOUBLE"), ["hosp_length"], ["period"], None), _TESTED)
_MC_CELLS = ("SELECT variable, level AS row_level, period AS col_level, count(*) AS n FROM ("
             + " UNION ALL ".join(f"SELECT '{v}' AS variable, CAST({v} AS VARCHAR) AS level, period FROM demo"
                                  for v in ["karnofsky", "age_group"])
             + ") WHERE level IS NOT NULL AND period IS NOT NULL GROUP BY ALL")
register("monte_carlo_independence_exact", f"""
SELECT variable, CAST(2000 AS BIGINT) AS replicates, statistic AS chisq_statistic, fisher_statistic
FROM ({_chi_sql(_MC_CELLS, "variable")})
JOIN (SELECT variable, -sum(lgamma(n + 1)) AS fisher_statistic FROM ({_MC_CELLS}) GROUP BY variable) USING (variable)""",
         ("chisq_statistic", "fisher_statistic"))
_PATIENTS = ("(SELECT DISTINCT id, period, hosp_cause_groups, charlson, age_group, gender, htn, diabetes FROM analysis "
             "WHERE hosp_cause_groups IS NOT NULL)")
register("patient_table", f"""
SELECT period, variable, 'continuous' AS kind, CAST(NULL AS VARCHAR) AS level, grp, n,
       CAST(NULL AS BIGINT) AS denom, CAST(NULL AS DOUBLE) AS pct, mean, sd, p25, median, p75
FROM ({_continuous_sql(_STRAT_LONG_C.replace("FROM analysis", "FROM " + _PATIENTS), "period")})
UNION ALL
SELECT period, variable, CASE WHEN variable IN ('htn', 'diabetes') THEN 'dichotomous' ELSE 'categorical' END,
       level, grp, n, denom, pct, NULL, NULL, NULL, NULL, NULL
FROM ({_categorical_sql(_STRAT_LONG_K.replace("FROM analysis", "FROM " + _PATIENTS), {"htn": "Si", "diabetes": "Si"},
                        "period")})""", ("pct", "mean", "sd", "p25", "median", "p75"))

# ------------------------------------------------------------------- models

_EXPO = (f"CASE period WHEN {_q(P1.label)} THEN {float(P1.days)} "
         f"WHEN {_q(P2.label)} THEN {float(P2.days)} END")
_BANDS = AGE_BANDS.labels
register("design_matrix", f"""
SELECT id, was_hospitalized, any_infection, hosp_count, ln({_EXPO}) AS log_exposure,
       CAST(period = {_q(P2.label)} AS DOUBLE) AS "period{P2.label}",
       {", ".join(f'CAST(age_group = {_q(b)} AS DOUBLE) AS "age_group{b}"' for b in _BANDS[1:])},
       CAST(gender = 'Hombre' AS DOUBLE) AS "genderHombre",
       CAST(htn = 'Si' AS DOUBLE) AS "htnSi", CAST(diabetes = 'Si' AS DOUBLE) AS "diabetesSi",
       CAST(charlson AS DOUBLE) AS charlson
FROM unpaired
WHERE period IN ({_q(P1.label)}, {_q(P2.label)}) AND age_group IN ({", ".join(_q(b) for b in _BANDS)})
  AND gender IN ('Mujer', 'Hombre') AND htn IN ('No', 'Si') AND diabetes IN ('No', 'Si')
  AND charlson IS NOT NULL""", ("log_exposure", "charlson"))

# Saturated logistic: intercept = ln odds of the reference period, slope = ln odds ratio,
# standard errors sqrt(1/a + 1/b [+ 1/c + 1/d]).
register("logit_period_only", f"""
WITH c AS (SELECT count(*) FILTER (WHERE period = {_q(P1.label)} AND was_hospitalized = 1) AS a,
                  count(*) FILTER (WHERE period = {_q(P1.label)} AND was_hospitalized = 0) AS b,
                  count(*) FILTER (WHERE period = {_q(P2.label)} AND was_hospitalized = 1) AS c,
                  count(*) FILTER (WHERE period = {_q(P2.label)} AND was_hospitalized = 0) AS d
           FROM unpaired WHERE period IN ({_q(P1.label)}, {_q(P2.label)})),
t AS (SELECT '(Intercept)' AS term, ln(a / b) AS estimate, sqrt(1.0 / a + 1.0 / b) AS std_error,
             a + b + c + d AS n_obs FROM c
      UNION ALL
      SELECT 'period{P2.label}', ln((c / d) / (a / b)), sqrt(1.0 / a + 1.0 / b + 1.0 / c + 1.0 / d),
             a + b + c + d FROM c),
dev AS (SELECT -2 * (a * ln(a / (a + b)) + b * ln(b / (a + b)) + c * ln(c / (c + d)) + d * ln(d / (c + d)))
               AS deviance FROM c)
SELECT term, estimate, std_error, estimate / std_error AS statistic,
       {norm_two_sided_sql('estimate / std_error')} AS p_value, exp(estimate) AS exp_estimate,
       CAST(n_obs AS BIGINT) AS n_obs, deviance FROM t, dev""",
         ("estimate", "std_error", "statistic", "p_value", "exp_estimate", "deviance"))

# Full fits: the same maximum by SQL alone. A recursive query holds the coefficients; every step sums gradient and
# information over the covariate patterns and eliminates the linear system, row operation by row operation.
_TERMS = ["(Intercept)", f"period{P2.label}", *[f"age_group{b}" for b in _BANDS[1:]], "genderHombre", "htnSi",
          "diabetesSi", "charlson"]
_FULL = ORACLES["design_matrix"].replace('round("log_exposure", 6)', '"log_exposure"').replace(
    'round("charlson", 6)', '"charlson"')


def _eliminate(p: int, inner: str) -> str:
    """Gauss-Jordan on column ``a`` (a list of p rows) of ``inner``; other columns stay."""
    for k in range(1, p + 1):
        inner = (f"SELECT * REPLACE (list_transform(a, lambda row, i: CASE WHEN i = {k} "
                 f"THEN list_transform(row, lambda v: v / row[{k}]) "
                 f"ELSE list_transform(row, lambda v, j: v - row[{k}] / a[{k}][{k}] * a[{k}][j]) END) AS a) "
                 f"FROM ({inner})")
    return inner


def _totals(state: str, cols: str, vec: str, rows: str = "pat") -> str:
    """``cols`` of the state and t, the sums over ``rows`` of the list ``vec``."""
    keep = ", ".join(f"any_value({c}) AS {c}" for c in cols.split(", "))
    return (f"SELECT {keep}, list(s ORDER BY i) AS t FROM (SELECT {keep}, i, sum(v) AS s FROM (SELECT {cols}, "
            f"unnest({vec}) AS v, unnest(range(1, len({vec}) + 1)) AS i FROM (SELECT {cols}, x, off, y, m, k, "
            f"list_sum(list_transform(b, lambda c, i: c * x[i])) + off AS eta FROM {state}, {rows})) GROUP BY i) "
            f"HAVING count(*) > 0")


def _products(p: int, weight: str) -> str:
    """p * p entries weight * x[j] * x[k], row by row."""
    return (f"list_transform(range({p * p}), lambda q: {weight} * x[CAST(q // {p} AS BIGINT) + 1] "
            f"* x[CAST(q % {p} AS BIGINT) + 1])")


def _system(p: int, extra: str = "") -> str:
    """Rows of the system from t = p * p information, then p gradient entries."""
    return (f"list_transform(range({p}), lambda j: list_concat(t[j * {p} + 1 : j * {p} + {p}], {extra}"
            f"[t[{p * p} + j + 1]]))")


def _newton_sql(p: int, name: str, mu: str, weight: str, start: str, max_iter: int) -> str:
    vec = f"list_concat({_products(p, weight)}, list_transform(x, lambda u: m * (y - {mu}) * u))"
    body = _eliminate(p, f"SELECT it, b, {_system(p)} AS a FROM ("
                      + _totals(f"(SELECT * FROM {name} WHERE step >= 1e-8 AND it < {max_iter})", "it, b", vec) + ")")
    return f"""{name}(it, b, step) AS (
  SELECT 0, {start}, 1e300::DOUBLE
  UNION ALL
  SELECT it + 1, list_transform(b, lambda c, i: c + d[i]), list_max(list_transform(d, lambda u: abs(u)))
  FROM (SELECT it, b, list_transform(range(1, {p + 1}), lambda j: a[j][{p + 1}]) AS d FROM ({body})))"""


def _inverse_diagonal(p: int, state: str) -> str:
    """(t of the totals, inverse information's diagonal v) at the state's coefficients."""
    return _eliminate(p, f"SELECT *, list_transform(range({p}), lambda j: list_concat(t[j * {p} + 1 : j * {p} + {p}], "
                         f"list_transform(range({p}), lambda k: CASE WHEN j = k THEN 1.0::DOUBLE ELSE 0.0 END))) AS a "
                         f"FROM ({state})")


def _coefficients(p: int, terms: list[str], last: str, theta: str, theta_se: str) -> str:
    names = ", ".join(f"({j}, {_q(t)})" for j, t in enumerate(terms, 1))
    return f"""
SELECT term, estimate, std_error, estimate / std_error AS statistic,
       {norm_two_sided_sql('estimate / std_error')} AS p_value, exp(estimate) AS exp_estimate,
       estimate - 1.959963984540054 * std_error AS ci_lower, estimate + 1.959963984540054 * std_error AS ci_upper,
       CAST(n AS BIGINT) AS n_obs, dev AS deviance, {theta} AS theta, {theta_se} AS theta_std_error,
       CAST(it AS INTEGER) AS iterations, step < 1e-8 AS converged
FROM (SELECT term, b[j] AS estimate, sqrt(a[j][{p} + j]) AS std_error, l.* FROM {last} l,
      (VALUES {names}) n(j, term))"""


def _pattern_sql(outcome: str, off: str, terms: list[str]) -> str:
    xs = ", ".join(["1.0::DOUBLE", *[f'CAST("{t}" AS DOUBLE)' for t in terms[1:]]])
    return f"""pat AS (SELECT x, off, y, CAST(count(*) AS DOUBLE) AS m, -1::BIGINT AS k FROM (
  SELECT [{xs}] AS x, {off} AS off, CAST({outcome} AS DOUBLE) AS y FROM design) GROUP BY x, off, y)"""


_COEF_DOUBLES = ("estimate", "std_error", "statistic", "p_value", "exp_estimate", "ci_lower", "ci_upper", "deviance",
                 "theta", "theta_std_error")


def _rounded(body: str) -> str:
    rep = ", ".join(f'round("{c}", 6) AS "{c}"' for c in _COEF_DOUBLES)
    return f"SELECT * REPLACE ({rep}) FROM ({body})"


def _logit_sql(outcome: str) -> str:
    p, mu = len(_TERMS), "(1 / (1 + exp(-eta)))"
    zero = "list_transform(range(%d), lambda j: 0.0::DOUBLE)" % p
    weight = f"m * {mu} * (1 - {mu})"
    vec = (f"list_concat({_products(p, weight)}, [2 * m * (greatest(eta, 0) + ln(1 + exp(-abs(eta))) - y * eta), m])")
    last = _totals("(SELECT * FROM fit ORDER BY it DESC LIMIT 1)", "it, b, step", vec)
    end = f"SELECT *, t[{p * p + 1}] AS dev, t[{p * p + 2}] AS n FROM ({_inverse_diagonal(p, last)})"
    return f"""WITH RECURSIVE design AS ({_FULL}),
{_pattern_sql(outcome, "0.0::DOUBLE", _TERMS)},
{_newton_sql(p, "fit", mu, weight, zero, 25)},
last AS ({end})
{_rounded(_coefficients(p, _TERMS, "last", "NULL::DOUBLE", "NULL::DOUBLE"))}"""


def _negbin_sql(outcome: str, terms: list[str], design: str) -> str:
    p, pp = len(terms), len(terms) ** 2
    mu, zeros = "exp(eta)", "list_transform(range(%d), lambda j: 0.0::DOUBLE)"
    start = (f"list_concat([(SELECT ln((sum(m * y) + 0.1) / sum(m * exp(off))) FROM pat)], {zeros % (p - 1)})")
    # a pattern (k = -1) gives its part of all sums; a row of the tail table N(Y > k) only that of theta
    seen = f"m * {mu} * th * (y + th) / pow(th + {mu}, 2)"
    want = f"m * {mu} * th / (th + {mu})"
    score = (f"CASE WHEN k < 0 THEN m * (1 - ln(1 + {mu} / th) - (y + th) / ({mu} + th)) ELSE m / (th + k) END")
    info = (f"CASE WHEN k < 0 THEN m * (2 / ({mu} + th) - 1 / th - (y + th) / pow({mu} + th, 2)) "
            f"ELSE m / pow(th + k, 2) END")
    one = lambda e: f"CASE WHEN k < 0 THEN {e} ELSE 0 END"     # noqa: E731
    vec = (f"list_concat({_products(p, one(seen))}, list_transform(x, lambda u: {one(f'm * (y - {mu}) * th / (th + {mu}) * u')}), "
           f"list_transform(x, lambda u: {one(f'-m * (y - {mu}) * {mu} / pow(th + {mu}, 2) * u')}), [{score}, {info}])")
    both = f"(SELECT * FROM pat UNION ALL SELECT {zeros % p}, 0.0::DOUBLE, 0.0::DOUBLE, m, k FROM tail)"
    going = "(SELECT * FROM nb WHERE step >= 1e-8 AND it < 100 AND th <= 1e6)"
    sums = _totals(going, "it, b, th", vec, both)
    s, i, cross = f"t[{pp + 2 * p + 1}]", f"t[{pp + 2 * p + 2}]", f"t[{pp + p} + j + 1]"
    rows = (f"list_concat({_system(p, f'[th * {cross}], ')}, [list_concat(list_transform(range({p}), "
            f"lambda j: th * {cross}), [th * th * {i} - th * {s}, th * {s}])])")
    body = _eliminate(p + 1, f"SELECT it, b, th, {rows} AS a FROM ({sums})")
    logdev = f"2 * m * (CASE WHEN y > 0 THEN y * ln(y / {mu}) ELSE 0 END"
    vec_end = (f"list_concat({_products(p, one(want))}, [{one(f'{logdev} - (y + th) * ln((y + th) / ({mu} + th)))')}, "
               f"{one('m')}, {info}])")
    vec_limit = f"list_concat({_products(p, f'm * {mu}')}, [{logdev} - (y - {mu})), m, m * pow(y / {mu} - 1, 2)])"
    end = f"t[{pp + 1}] AS dev, t[{pp + 2}] AS n, t[{pp + 3}] AS last"
    limit = _totals("(SELECT * FROM pois ORDER BY it DESC LIMIT 1)", "it, b, step", vec_limit)
    final = _totals("(SELECT * FROM nb ORDER BY it DESC LIMIT 1)", "it, b, step, th", vec_end, both)
    one_of = (f"SELECT it, b, step, dev, n, a, NULL::DOUBLE AS th, NULL::DOUBLE AS info FROM lim "
              f"WHERE n / last > 1e6 OR EXISTS (SELECT 1 FROM nb WHERE th > 1e6) UNION ALL "
              f"SELECT it, b, step, dev, n, a, th, last FROM fin WHERE NOT EXISTS (SELECT 1 FROM nb WHERE th > 1e6)")
    return f"""WITH RECURSIVE design AS ({design}),
{_pattern_sql(outcome, "log_exposure", terms)},
tail AS (SELECT CAST(r.k AS BIGINT) AS k, sum(pat.m) AS m FROM pat, range(0, (SELECT CAST(max(y) AS BIGINT) FROM pat)) r(k)
         WHERE pat.y > r.k GROUP BY r.k),
{_newton_sql(p, "pois", mu, f"m * {mu}", start, 100)},
lim AS (SELECT *, {end} FROM ({_inverse_diagonal(p, limit)})),
nb(it, b, th, step) AS (
  SELECT 0, b, n / last, 1e300::DOUBLE FROM lim WHERE n / last <= 1e6
  UNION ALL
  SELECT it + 1, list_transform(b, lambda c, i: c + d[i]), th * exp(tau),
         greatest(abs(tau), list_max(list_transform(d, lambda u: abs(u))))
  FROM (SELECT it, b, th, list_transform(range(1, {p + 1}), lambda j: a[j][{p + 2}]) AS d,
               least(greatest(a[{p + 1}][{p + 2}], -1.0), 1.0) AS tau FROM ({body}))),
fin AS (SELECT *, {end} FROM ({_inverse_diagonal(p, final)})),
chosen AS ({one_of})
{_rounded(_coefficients(p, terms, "chosen", "th", "1 / sqrt(info)"))}"""


ORACLES["logit_risk"] = _logit_sql("was_hospitalized")
ORACLES["logit_specific_event"] = _logit_sql("any_infection")
ORACLES["nb_count_model"] = _negbin_sql("hosp_count", _TERMS, _FULL)
ORACLES["nb_period_only"] = _negbin_sql(
    "hosp_count", _TERMS[:2], _with(f"""SELECT hosp_count, ln({_EXPO}) AS log_exposure,
  CAST(period = {_q(P2.label)} AS DOUBLE) AS "period{P2.label}" FROM unpaired
WHERE period IN ({_q(P1.label)}, {_q(P2.label)})"""))
