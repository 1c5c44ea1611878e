"""Study specification: layouts, level orders, periods and the cause vocabulary.

Everything study-specific lives here as data; operators take these objects as
arguments. Level order matters in three places: output grids, the reference
category of model contrasts, and which group is "first" in two-group tests.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RepeatedGroup:
    """Columns named ``<measure><sep><suffix>`` forming one repeated group."""

    measures: tuple[str, ...]
    suffixes: tuple[str, ...]
    sep: str = "_"

    def column(self, measure: str, suffix: str) -> str:
        return f"{measure}{self.sep}{suffix}"

    def columns(self) -> list[str]:
        return [self.column(m, s) for s in self.suffixes for m in self.measures]

    @staticmethod
    def from_columns(columns: list[str], pattern: str) -> "RepeatedGroup":
        """Split names by a two-group regex (prefix, suffix), like names_pattern."""
        rx = re.compile(pattern)
        measures: list[str] = []
        suffixes: list[str] = []
        for c in columns:
            m = rx.fullmatch(c)
            if not m:
                continue
            if m.group(1) not in measures:
                measures.append(m.group(1))
            if m.group(2) not in suffixes:
                suffixes.append(m.group(2))
        return RepeatedGroup(tuple(measures), tuple(suffixes))


@dataclass(frozen=True)
class FactorSpec:
    """Raw codes -> labels in level order; anything else becomes NULL."""

    levels: tuple[str, ...]
    labels: tuple[str, ...]

    def mapping(self) -> dict[str, str]:
        return dict(zip(self.levels, self.labels))


@dataclass(frozen=True)
class Period:
    label: str
    suffix: str
    start: dt.date
    end: dt.date

    @property
    def days(self) -> int:
        return (self.end - self.start).days


@dataclass(frozen=True)
class Bands:
    """Right-closed bands ``(b[i], b[i+1]]`` with one label each."""

    breaks: tuple[float, ...]
    labels: tuple[str, ...]
    right: bool = True


# ---------------------------------------------------------------------------
# These must equal the study's own values for equal results.
# Wide input layout, factor codes and labels, value maps, age bands and the
# cause vocabulary (code, label, 4-group taxonomy, 6-group taxonomy), each in
# the study's own order.
# ---------------------------------------------------------------------------

WIDE_SCALAR_COLUMNS = (
    "id", "status_date_p1", "clinic_p1", "status_p1", "substatus_p1",
    "status_date_p2", "clinic_p2", "status_p2", "substatus_p2", "birth_date",
    "gender", "charlson_p1", "charlson_p2", "karnofsky_p1", "karnofsky_p2",
    "diabetes_type", "diabetes_date", "va_p1", "va_p2", "htn", "death_date",
    "death_cause",
)
SLOT_MEASURES = ("hosp_start", "hosp_end", "hosp_re", "hosp_cause")
NUMERIC_COLUMNS = ("charlson_p1", "charlson_p2", "karnofsky_p1", "karnofsky_p2")

GENDER = FactorSpec(("F", "M"), ("Mujer", "Hombre"))
HTN = FactorSpec(("N", "Y"), ("No", "Si"))
READMISSION = FactorSpec(("No", "Yes"), ("No", "Si"))
DIABETES = FactorSpec(("FALSE", "TRUE"), ("No", "Si"))

DIABETES_TYPE_MAP = {"Type 1": "Tipo 1", "Type 2": "Tipo 2"}
VASCULAR_ACCESS_MAP = {
    "Autologous AV Fistula": "Fistula AV Nativa",
    "AV Graft": "Fistula Protésica",
    "Tunneled catheter": "Catéter Tunelizado",
}

AGE_BANDS = Bands((18.0, 50.0, 65.0, 75.0, float("inf")),
                  ("18-49", "50-64", "65-74", "≥ 75"))

GROUP4_LEVELS = ("Cardiovascular", "Infección",
                 "Acceso Vascular (excl. infección)", "Otras Causas")
GROUP6_LEVELS = ("Cardiovascular", "Infección",
                 "Acceso Vascular (excl. infección)", "Urológicas",
                 "Otras Causas", "Desconocido")

CAUSE_VOCABULARY = (
    # (code, label, group4, group6)
    ("Infection Respiratory", "Infección Respiratoria", "Infección", "Infección"),
    ("Cardiovascular Pulmonary Disease", "Enfermedad Pulmonar Cardiovascular", "Cardiovascular", "Cardiovascular"),
    ("Digestive System Disorder", "Trastorno del Sistema Digestivo", "Otras Causas", "Otras Causas"),
    ("Other", "Otras Causas", "Otras Causas", "Otras Causas"),
    ("Access Repair", "Reparación de Acceso Vascular", "Acceso Vascular (excl. infección)", "Acceso Vascular (excl. infección)"),
    ("Musculoskeletal System Disorder", "Trastorno del Sistema Musculoesquelético", "Otras Causas", "Otras Causas"),
    ("Infection Blood", "Bacteriemia", "Infección", "Infección"),
    ("Cardiovascular Vessel Disease", "Enfermedad Cardiovascular Periférica", "Cardiovascular", "Cardiovascular"),
    ("Genitourinary Disorder", "Trastorno Genitourinario", "Otras Causas", "Urológicas"),
    ("Cardiovascular Heart Disease", "Enfermedad Cardiovascular", "Cardiovascular", "Cardiovascular"),
    ("Access Infection", "Infección del Acceso Vascular", "Infección", "Infección"),
    ("Immune Disorder Other", "Otros Trastornos Inmunológicos", "Otras Causas", "Otras Causas"),
    ("Unknown", "Desconocido", "Otras Causas", "Desconocido"),
    ("Infection Other", "Otras Infecciones", "Infección", "Infección"),
    ("Nervous System Disorder", "Trastorno del Sistema Nervioso", "Otras Causas", "Otras Causas"),
    ("Access Other", "Otras Causas - Acceso Vascular", "Acceso Vascular (excl. infección)", "Acceso Vascular (excl. infección)"),
    ("Circulatory Disease", "Enfermedad Circulatoria", "Cardiovascular", "Cardiovascular"),
    ("Infection Wound", "Infección de la Herida", "Infección", "Infección"),
    ("Respiratory System Other Cause", "Otras Causas Respiratorias", "Otras Causas", "Otras Causas"),
    ("Infection COVID19 (SARS-CoV2 infection)", "Infección COVID19 (Infección por SARS-CoV2)", "Infección", "Infección"),
    ("Access Placement", "Colocación de Acceso Vascular", "Acceso Vascular (excl. infección)", "Acceso Vascular (excl. infección)"),
    ("Blood Disorder Anemia", "Anemia", "Otras Causas", "Otras Causas"),
    ("Cerebrovascular Disease", "Enfermedad Cerebrovascular", "Cardiovascular", "Cardiovascular"),
    ("Injury/Accident", "Lesión/Accidente", "Otras Causas", "Otras Causas"),
    ("Cardiovascular Other", "Otros Trastornos Cardiovasculares", "Cardiovascular", "Cardiovascular"),
    ("Blood Disorder Clotting", "Trastorno de la Coagulación", "Otras Causas", "Otras Causas"),
    ("Blood Disorder Other", "Otros Trastornos Hematológicos", "Otras Causas", "Otras Causas"),
    ("Endocrine Disorder Diabetes", "Diabetes Mellitus", "Otras Causas", "Otras Causas"),
    ("Cancer/Neoplasms", "Cáncer/Neoplasmas", "Otras Causas", "Otras Causas"),
    ("Metabolic Disorder", "Trastorno Metabólico", "Otras Causas", "Otras Causas"),
    ("Respiratory System COPD", "Enfermedad Pulmonar Obstructiva Crónica (EPOC)", "Otras Causas", "Otras Causas"),
    ("Mental Disorder", "Trastorno Mental", "Otras Causas", "Otras Causas"),
    ("Infection Peritonitis (PD Related Peritonitis Excluded)", "Peritonitis (Excluyendo Peritonitis Relacionada con PD)", "Infección", "Infección"),
    ("Skin Disorder", "Trastorno de la Piel", "Otras Causas", "Otras Causas"),
    ("Infection Tunnel/Cuff", "Infección de Túnel/Cuff", "Infección", "Infección"),
    ("PD Catheter Replacement", "Reemplazo de Catéter PD", "Otras Causas", "Otras Causas"),
    ("Other PD Related Cause", "Otras Causas Relacionadas con PD", "Otras Causas", "Otras Causas"),
    ("PD Catheter Placement", "Colocación de Catéter PD", "Otras Causas", "Otras Causas"),
)

# Labels of the chart and the admission table, where they differ from those above.
CHART_LABELS = {
    "Access Infection": "Infección de Acceso Vascular",
    "Infection Wound": "Infección de Herida",
    "Endocrine Disorder Diabetes": "Diabetes",
}

# Display labels of the tables.
DEMO_LABELS = {"age": "Edad", "age_group": "Edad (Categórica)", "gender": "Mujeres", "htn": "Hipertensión",
               "diabetes": "Diabetes Mellitus", "diabetes_type": "Tipo de Diabetes",
               "charlson": "Índice de Charlson", "karnofsky": "Karnofsky", "va": "Acceso Vascular"}
CAUSE_LABELS = {"age_group": "Grupo Etario", "gender": "Género", "htn": "Hipertensión Arterial",
                "diabetes": "Diabetes Mellitus", "charlson": "Índice de Charlson"}
ADMISSION_LABELS = {"period": "Periodo", "hosp_length": "Días de hospitalización", "hosp_re": "Reingreso"}

# ---------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------


def taxonomy_rows(vocabulary=CAUSE_VOCABULARY) -> list[tuple[str, str, str, str, int]]:
    """The vocabulary as rows (taxonomy, code, label, group, place of the group from 1).

    ``four`` is the analysis' taxonomy, ``six`` that of the chart and the admission table, with its own labels.
    """
    four = [("four", c, label, g, GROUP4_LEVELS.index(g) + 1) for c, label, g, _ in vocabulary]
    six = [("six", c, CHART_LABELS.get(c, label), g, GROUP6_LEVELS.index(g) + 1) for c, label, _, g in vocabulary]
    return four + six

# Windows of the synthetic cohort derived from the TPC-H-like tables.
FIXTURE_PERIODS = (
    Period("Pre", "p1", dt.date(1996, 10, 28), dt.date(1997, 2, 28)),
    Period("Post", "p2", dt.date(1997, 10, 28), dt.date(1998, 2, 28)),
)


def wide_columns(n_slots: int = 9) -> list[str]:
    """The 58 positional names of the raw wide file (22 + 9 slots x 4)."""
    cols = list(WIDE_SCALAR_COLUMNS)
    for k in range(1, n_slots + 1):
        cols += [f"{m}_{k}" for m in SLOT_MEASURES]
    return cols


@dataclass(frozen=True)
class StudySpec:
    """All parameters of one before/after study."""

    periods: tuple[Period, ...] = FIXTURE_PERIODS
    n_slots: int = 9
    period_pattern: str = "(.+)_(p[0-9]+)"       # repeated columns are found by name: measure, then period suffix
    slot_pattern: str = "(.+)_([0-9]+)"          # and measure, then slot number
    bounds: str = "exclusive"          # period containment of a stay
    age_bands: Bands = AGE_BANDS
    vocabulary: tuple[tuple[str, str, str, str], ...] = CAUSE_VOCABULARY
    group4_levels: tuple[str, ...] = GROUP4_LEVELS
    group6_levels: tuple[str, ...] = GROUP6_LEVELS

    @property
    def period_labels(self) -> list[str]:
        return [p.label for p in self.periods]

    def suffix_to_label(self) -> dict[str, str]:
        return {p.suffix: p.label for p in self.periods}


def literal_map(mapping: dict) -> Column:
    """A map literal; look up with ``F.try_element_at`` (missing key -> NULL)."""
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)
