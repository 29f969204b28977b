"""Activity translation, categorisation and story text (J1, J1b-d, J2, T1-T6b, T8, T13).

All text is built with JVM-side expressions; the translation dictionary is a small
table joined with a size-checked broadcast, the category table is a literal ``CASE``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casestory.functions.text import capitalize_first, english_list, italian_list, thousands

# Activity categories and their English templates, in the reference's
# order (order decides which category wins when several are contained in a name).
ACTIVITY_TEMPLATES = [
    ("VISIT", "The patient underwent {activity}"),
    ("FIRST VISIT", "The patient had {activity}"),
    ("VISIT CONTROL", "{activity} was performed"),
    ("VISIT ANESTHESIOLOGICAL", "The patient underwent {activity}"),
    ("RX", "{activity} was performed"),
    ("TC", "{activity} was performed"),
    ("RM", "{activity} was performed"),
    ("ULTRASOUND", "{activity} was performed"),
    ("ANGIO", "{activity} was performed"),
    ("SCINTIGRAPHY", "{activity} was performed"),
    ("MAMMOGRAPHY", "{activity} was performed"),
    ("BIOPSY", "{activity} was performed"),
    ("AGOBIOPSY", "{activity} was performed"),
    ("ENDOSCOPY", "{activity} was performed"),
    ("COLONOSCOPY", "{activity} was performed"),
    ("GASTROSCOPY", "{activity} was performed"),
    ("EGDS", "{activity} was performed"),
    ("BRONCHOSCOPY", "{activity} was performed"),
    ("CYSTOSCOPY", "{activity} was performed"),
    ("RADIOTHERAPY", "The patient received {activity}"),
    ("HEMODIALYSIS", "{activity} was performed"),
    ("DIALYSIS", "{activity} was performed"),
    ("HEMOFILTRATION", "{activity} was performed"),
    ("THERAPY", "The patient received {activity}"),
    ("REHABILITATION", "{activity} was performed"),
    ("COUNSELING", "{activity} was provided"),
    ("POSITIONING", "{activity} was performed"),
    ("CATHETERIZATION", "{activity} was performed"),
    ("DRAINAGE", "{activity} was performed"),
    ("VERTEBROPLASTY", "{activity} was performed"),
    ("EMBOLIZATION", "{activity} was performed"),
    ("STENT", "{activity} was positioned"),
    ("ELECTROCARDIOGRAM", "{activity} was performed"),
    ("HEMOGASANALYSIS", "{activity} was performed"),
    ("SPIROMETRY", "{activity} was performed"),
    ("TEST", "{activity} was performed"),
    ("EVOKED POTENTIALS", "{activity} was performed"),
    ("ELECTROENCEPHALOGRAM", "{activity} was performed"),
    ("CONTROL", "{activity} was performed"),
    ("MONITORING", "{activity} was performed"),
    ("EVALUATION", "{activity} was performed"),
    ("CONSULTATION", "{activity} was provided"),
    ("ADVICE", "{activity} was provided"),
    ("TSRM IN OPERATING ROOM", "Multislice tomosynthesis (TSRM) was performed in operating room"),
    ("DEFAULT", "{activity} was performed"),
]

# Verb phrases removed from a filled template, tried in this order; the
# first one found at the end (or else at the start) is removed and the search stops.
TEMPLATE_AFFIXES = [
    " was performed",
    " was executed",
    "The patient underwent ",
    "The patient had ",
    "The patient received ",
    " was provided",
    " was positioned",
]

# Story sentences.
INTRO_TAIL = "underwent a series of examinations and interventions during hospitalization."
EMPTY_CASE_TEXT = "No specific clinical events were recorded."
FALLBACK_TEXT = "Error generating narrative for patient {case_id}."


# ------------------------------------------------------------------ J1: translation

def _by_source(d: DataFrame) -> DataFrame:
    """One target per source: of a repeated key the last entry holds, as in a JSON object."""
    return d.groupBy(F.col("src").alias("__k1")).agg(F.max_by("dst", "pos").alias("__d1"))


def translate(df: DataFrame, dictionary: DataFrame, col: str = "activity",
              out: str = "activity_en", mode: str = "exact_ci") -> DataFrame:
    """Translate ``col`` through ``dictionary(pos, src, dst)``.

    mode ``exact_ci`` (J1):   exact key; else case-insensitive, first key in order; else unchanged
    mode ``upper_ci`` (J1b):  upper-cased name as key; else case-insensitive first; else unchanged
    mode ``exact``    (J1c):  exact key only; else unchanged
    """
    d = dictionary.select("pos", "src", "dst")
    res = df
    parts = []
    if mode in ("exact_ci", "exact"):
        ex = _by_source(d)
        res = res.join(ex, res[col] == ex["__k1"], "left")
        parts.append(F.col("__d1"))
    elif mode == "upper_ci":
        ex = _by_source(d)
        res = res.join(ex, F.upper(res[col]) == ex["__k1"], "left")
        parts.append(F.when(F.col("__d1") != "", F.col("__d1")))  # empty text is "not found"
    else:
        raise ValueError(f"unknown mode {mode}")
    if mode in ("exact_ci", "upper_ci"):
        ci = d.groupBy(F.upper("src").alias("__k2")).agg(F.min_by("dst", "pos").alias("__d2"))
        res = res.join(ci, F.upper(res[col]) == ci["__k2"], "left")
        parts.append(F.col("__d2"))
    res = res.withColumn(out, F.coalesce(*parts, F.col(col)))
    return res.drop("__k1", "__d1", "__k2", "__d2")


def english_vocabulary(dictionary: DataFrame) -> DataFrame:
    """J1d: case-folded English name -> English name, the last entry winning."""
    return dictionary.groupBy(F.lower("dst").alias("key")).agg(F.max_by("dst", "pos").alias("dst"))


# ---------------------------------------------------------- J2 / T1: activity phrase

def activity_category(name: Column) -> Column:
    """Exact upper-case category; else first category in template order contained
    in the upper-cased name; else DEFAULT."""
    u = F.upper(name)
    cats = [c for c, _ in ACTIVITY_TEMPLATES]
    expr = F.when(u.isin(*cats), u)
    for c in cats:
        if c != "DEFAULT":
            expr = expr.when(F.contains(u, F.lit(c)), F.lit(c))
    return expr.otherwise(F.lit("DEFAULT"))


def template_of(category: Column) -> Column:
    """Template text of a category (one literal map lookup)."""
    m = F.create_map(*[F.lit(x) for pair in ACTIVITY_TEMPLATES for x in pair])
    return F.element_at(m, category)


def strip_affix(desc: Column) -> Column:
    """Remove the first verb phrase (in list order) found at the end, or else the start."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for a in TEMPLATE_AFFIXES:
        n = len(a)
        out = (out.when(F.endswith(desc, F.lit(a)), desc.substr(F.lit(1), F.length(desc) - n))
                  .when(F.startswith(desc, F.lit(a)), desc.substr(F.lit(n + 1), F.length(desc))))
    return out.otherwise(desc)


def with_activity_phrase(df: DataFrame, name: str = "activity_en", out: str = "phrase") -> DataFrame:
    """Fill the category template with the (translated) name, then remove the first
    verb phrase found at the end or the start.

    Built in three projections (category, filled template, phrase) so the category CASE
    is evaluated once per row rather than copied into every later branch.
    """
    d = df.withColumn("__cat", activity_category(F.col(name)))
    d = d.withColumn("__desc", F.replace(template_of(F.col("__cat")), F.lit("{activity}"), F.col(name)))
    return d.withColumn(out, strip_affix(F.col("__desc"))).drop("__cat", "__desc")


# ----------------------------------------------------------------- T2: introduction

def patient_intro(gender: Column, age: Column) -> Column:
    """T2: 'M' -> male, anything else -> female; age 0 or null counts as absent."""
    has_g = gender.isNotNull() & (gender != "")
    has_a = age.isNotNull() & (age != 0)
    g = F.when(gender == "M", F.lit("male")).otherwise(F.lit("female"))
    a = age.cast("string")
    head = (F.when(has_g & has_a, F.concat(F.lit("The patient, a "), a, F.lit("-year-old "), g, F.lit(",")))
            .when(has_g, F.concat(F.lit("The patient, "), g, F.lit(",")))
            .when(has_a, F.concat(F.lit("The patient, "), a, F.lit(" years old,")))
            .otherwise(F.lit("The patient")))
    return F.concat(head, F.lit(" " + INTRO_TAIL))


# ----------------------------------------------------------- T3 / T4 / T5: bodies

def narrative_sentence(delta: Column, items: Column) -> Column:
    """One sentence for a group of simultaneous events, ``delta`` seconds after the
    previous group (0 for the first group)."""
    n = F.size(items)
    first = F.element_at(items, 1)
    return (F.when((n == 1) & (delta == 0),
                   F.concat(F.lit("The "), first,
                            F.lit(" was performed at the beginning of hospitalization, after 0 seconds.")))
            .when(n == 1, F.concat(F.lit("After "), thousands(delta), F.lit(" seconds, "), first,
                                   F.lit(" was performed.")))
            .otherwise(F.concat(F.lit("After "), thousands(delta),
                                F.lit(" seconds, the following examinations were performed simultaneously: "),
                                english_list(items), F.lit("."))))


def bullet_lines(delta: Column, items: Column) -> Column:
    """T4: '- After N seconds: X', or a header line with '    - X' sub-lines and
    '(concurrent)' after the first one."""
    n = F.size(items)
    d = delta.cast("string")
    sub = F.array_join(F.transform(items, lambda x, i: F.concat(
        F.lit("    - "), capitalize_first(x),
        F.when(i > 0, F.lit(" (concurrent)")).otherwise(F.lit("")))), "\n")
    return (F.when(n == 1, F.concat(F.lit("- After "), d, F.lit(" seconds: "),
                                    capitalize_first(F.element_at(items, 1))))
            .otherwise(F.concat(F.lit("- After "), d, F.lit(" seconds:\n"), sub)))


def italian_group_phrase(since_start: Column, items: Column) -> Column:
    """T5: 'X dopo N secondi' with N measured from the case start."""
    return F.concat(italian_list(items), F.lit(" dopo "), since_start.cast("string"), F.lit(" secondi"))


STYLE_SEPARATORS = {"narrative": ("\n\n", "\n\n"), "bullet_points": ("\n", "\n")}


def group_text(style: str, delta: Column, items: Column) -> Column:
    if style == "narrative":
        return narrative_sentence(delta, items)
    if style == "bullet_points":
        return bullet_lines(delta, items)
    raise ValueError(f"unknown style {style}")
